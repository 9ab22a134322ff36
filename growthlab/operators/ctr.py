"""Click-through / conversion by category and model rank, A/B comparison,
top-k allocation (SURVEY §2.11 CT1-CT7, AB1-AB4, AL1).

Per-day loops of the reference become one job keyed by ``dt``; shares of a
total divide by a small aggregate joined back (broadcast), not by an empty
window.  Score arrays are ranked with array expressions (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlab.functions.arrays import rank_of, top_ids
from growthlab.functions.columns import ratio
from growthlab.functions.ordered import discrete_quantiles, edges_array


def banner_customer_category(events: DataFrame, category_map: DataFrame) -> DataFrame:
    """CT1 ``load_banner_events``: null → 0, keep mapped categories, sums per
    (day, customer, category)."""
    e = events.select("dt", "customer_id", "cma_id", "impressions", "banner_clicks", "sales").fillna(0)
    e = e.join(category_map.select("cma_id"), "cma_id")
    return e.groupBy("dt", "customer_id", "cma_id").agg(
        F.sum("impressions").alias("impressions"), F.sum("banner_clicks").alias("clicks"),
        F.sum("sales").alias("sales"))


def banner_rank_base(daily: DataFrame, scores_by_day: DataFrame, n: int = 10, ties: str = "stable") -> DataFrame:
    """CT2 ``join_df``: each day's counters joined to the previous day's top-n
    list of the customer; ``rank`` = position of the category, or n'+1 when
    absent (n' = list length)."""
    top = scores_by_day.select(F.date_add("dt", 1).alias("dt"), "customer_id",
                               top_ids("category_trend_scores", n, ties).alias("topn"))
    j = daily.join(top, ["dt", "customer_id"])
    return j.withColumn("rank", rank_of("cma_id", "topn")).drop("topn")


def ctr_by_category_rank(base: DataFrame) -> DataFrame:
    """CT3: per (category, rank): totals, ctr, cvr (sales / impressions as in the
    reference), and the rank's share of the category's impressions."""
    a = base.groupBy("cma_id", "rank").agg(F.sum("impressions").alias("impressions_total"),
                                           F.sum("clicks").alias("clicks_total"),
                                           F.sum("sales").alias("category_sales_total"))
    cat = a.groupBy("cma_id").agg(F.sum("impressions_total").alias("__cat"))
    return (a.join(cat, "cma_id")
             .withColumn("ctr", ratio("clicks_total", "impressions_total"))
             .withColumn("cvr", ratio("category_sales_total", "impressions_total"))
             .withColumn("cvr_click", ratio("category_sales_total", "clicks_total"))
             .withColumn("impression_rate", ratio("impressions_total", "__cat")).drop("__cat"))


def ctr_by_rank(base: DataFrame) -> DataFrame:
    """CT4: per rank: totals, ``ctra``, share of all impressions."""
    a = base.groupBy("rank").agg(F.sum("impressions").alias("impressions_total"),
                                 F.sum("clicks").alias("clicks_total"))
    tot = a.agg(F.sum("impressions_total").alias("__tot"))
    return (a.join(F.broadcast(tot)).withColumn("ctra", ratio("clicks_total", "impressions_total"))
             .withColumn("impression_rate", ratio("impressions_total", "__tot")).drop("__tot"))


def impression_click_gap(base: DataFrame) -> DataFrame:
    """CT5: mean(impressions − clicks) per (category, rank)."""
    return base.groupBy("cma_id", "rank").agg(F.avg(F.col("impressions") - F.col("clicks")).alias("avg_diff"))


def category_factor(base: DataFrame) -> DataFrame:
    """CT6: per category: impression share ``ratio``, ``ctr``, ``factor`` = ctr / ratio."""
    a = base.groupBy("cma_id").agg(F.sum("impressions").alias("impressions_total"),
                                   F.sum("clicks").alias("clicks_total"))
    tot = a.agg(F.sum("impressions_total").alias("__tot"))
    return (a.join(F.broadcast(tot)).withColumn("ratio", ratio("impressions_total", "__tot"))
             .withColumn("ctr", ratio("clicks_total", "impressions_total"))
             .withColumn("factor", F.try_divide(F.col("ctr"), F.col("ratio"))).drop("__tot"))


def factor_decile(factor: DataFrame, n: int = 10) -> DataFrame:
    """CT7 ``QuantileDiscretizer(numBuckets=n)`` on ``factor``: element-quantile
    edges, ``[lo, hi)`` buckets, tied edges merged; ``result`` = bucket."""
    e = edges_array(discrete_quantiles(factor, "factor", [i / n for i in range(1, n)]))
    b = F.size(F.filter(F.col("edges"), lambda x: x <= F.col("factor")))
    return factor.join(F.broadcast(e)).withColumn(
        "result", F.when(F.col("factor").isNull(), F.lit(None)).otherwise(b).cast("int")).drop("edges")


def factor_deciles(factor: DataFrame) -> DataFrame:
    """AG14: ``approx_percentile(factor, [0.1 … 1.0])`` as exact element quantiles."""
    return discrete_quantiles(factor, "factor", [i / 10 for i in range(1, 11)], "value")


# ---------------------------------------------------------------- A/B

def ab_event_base(events: DataFrame, experiment: DataFrame, category_map: DataFrame,
                  affected: DataFrame | None = None) -> DataFrame:
    """AB1: banner counters of affected customers with their experiment group
    (join on customer, banner, day, category) and the category name."""
    exp = experiment.select("customer_id", "banner_id", "dt", "cma_id", "experiment_group_name")
    if affected is not None:
        exp = exp.join(affected.select("customer_id").distinct(), "customer_id", "left_semi")
    e = events.join(exp, ["customer_id", "banner_id", "dt", "cma_id"])
    return e.join(category_map, "cma_id")


def ab_category_metrics(base: DataFrame) -> DataFrame:
    """AB2: per (category, day, group): totals, ctr, cvr, gmv per impression / click."""
    a = base.groupBy("category_name", "cma_id", "dt", "experiment_group_name").agg(
        F.sum("impressions").alias("impressions_total"), F.sum("banner_clicks").alias("clicks_total"),
        F.sum("sales").alias("category_sales_total"), F.sum("gmv").alias("category_gmv_total"))
    return (a.withColumn("ctr", ratio("clicks_total", "impressions_total"))
             .withColumn("cvr", ratio("category_sales_total", "impressions_total"))
             .withColumn("gmv_per_impression", ratio("category_gmv_total", "impressions_total"))
             .withColumn("gmv_per_click", ratio("category_gmv_total", "clicks_total")))


def _group_shares(m: DataFrame) -> DataFrame:
    tot = m.groupBy("dt", "experiment_group_name").agg(F.sum("impressions_total").alias("__ti"),
                                                       F.sum("clicks_total").alias("__tc"))
    return (m.join(tot, ["dt", "experiment_group_name"])
             .withColumn("impression_ratio", ratio("impressions_total", "__ti"))
             .withColumn("clicks_ratio", ratio("clicks_total", "__tc")).drop("__ti", "__tc"))


def ab_comparison(metrics: DataFrame, valid: DataFrame, a: str = "raw", b: str = "rt") -> DataFrame:
    """AB3: per day, group ``a`` vs group ``b`` side by side (``_raw`` / ``_rt``
    suffixes): full outer join on the category name, each side with the valid-category
    id (``sale_category_id``, null when not valid).  A name with several ids gives a
    row per pair of ids, and a name seen by one group only gets nulls on the other
    side.  Both sides are small: a row per day and category."""
    v = valid.select("dt", "cma_id").distinct().withColumn("sale_category_id", F.col("cma_id"))
    s = _group_shares(metrics).join(v, ["dt", "cma_id"], "left")
    g = F.col("experiment_group_name")
    vals = [c for c in s.columns if c not in ("dt", "experiment_group_name")]
    left = s.where(g == a).select("dt", F.col("category_name").alias("__name"), *[F.col(c).alias(c + "_raw") for c in vals])
    right = s.where(g == b).select("dt", F.col("category_name").alias("__name"),
                                   *[F.col(c).alias(c + "_rt") for c in vals if c != "cma_id"])
    return left.join(right, ["dt", "__name"], "full").drop("__name")


def ab_entropy(metrics: DataFrame) -> DataFrame:
    """AB4 ``get_entropy``: −Σ p ln p of each group's impression and click
    shares per day (a zero share contributes 0)."""
    s = _group_shares(metrics)

    def h(c):
        return F.sum(F.when(F.col(c) > 0, -F.col(c) * F.log(F.col(c))).otherwise(F.lit(0.0)))

    return s.groupBy("dt", "experiment_group_name").agg(h("impression_ratio").alias("impression_entropy"),
                                                         h("clicks_ratio").alias("clicks_entropy"))


def topk_allocation(scores_by_day: DataFrame, k: int, category: str, ties: str = "asc") -> DataFrame:
    """AL1: per day, customers whose first k categories contain ``category``."""
    top = scores_by_day.select("dt", top_ids("category_trend_scores", k, ties).alias("topk"))
    return (top.where(F.array_contains("topk", F.lit(category))).groupBy("dt")
               .agg(F.count(F.lit(1)).alias("n_customers"))
               .withColumn("category_id", F.lit(category)).withColumn("k", F.lit(k)))
