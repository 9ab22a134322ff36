"""Recommendation diversity.

Inputs are top-k rows (customer, rank, cma_id); everything after the first
aggregate works on (category, rank) rows, a table bounded by categories × k,
so the per-rank windows below are small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def topk_category_counts(topk: DataFrame) -> DataFrame:
    """DV1 ``unique_categories_in_top_k``: recommendations per (category, rank)."""
    return (topk.select(F.col("cma_id").alias("top_cat"), "rank").groupBy("top_cat", "rank")
                .agg(F.count("top_cat").alias("total_model_rec_cnt")))


def topk_cumulative_share(counts: DataFrame, category_map: DataFrame | None = None) -> DataFrame:
    """DV2: running count of each category over ranks 1..r and its share among
    all categories' running counts at r (a category absent at r has no row)."""
    w = Window.partitionBy("top_cat").orderBy("rank").rangeBetween(Window.unboundedPreceding, 0)
    c = counts.withColumn("category_rec_count", F.sum("total_model_rec_cnt").over(w))
    tot = c.groupBy("rank").agg(F.sum("category_rec_count").alias("__t"))
    out = (c.join(tot, "rank").withColumn("percentage", F.col("category_rec_count") / F.col("__t"))
            .select(F.col("rank").alias("k"), "top_cat", "category_rec_count", "percentage"))
    if category_map is not None:
        out = out.join(category_map.select(F.col("cma_id").alias("top_cat"), "category_name"),
                       "top_cat", "left")
    return out


def category_coverage(topk: DataFrame, servable: DataFrame, max_k: int) -> DataFrame:
    """DV3 ``coverage_calculation``: |categories recommended within k ∩ servable| / |servable|."""
    sv = servable.select(F.col("cma_id").alias("top_cat")).distinct()
    n = sv.agg(F.count(F.lit(1)).alias("__n"))
    first = topk.groupBy(F.col("cma_id").alias("top_cat")).agg(F.min("rank").alias("first_rank"))
    hit = first.join(sv, "top_cat")
    ks = n.select(F.explode(F.sequence(F.lit(1), F.lit(max_k))).alias("k"), "__n")
    return (ks.join(hit, F.col("first_rank") <= F.col("k"), "left")
              .groupBy("k", "__n").agg(F.count("top_cat").alias("covered"))
              .select("k", (F.col("covered") / F.col("__n")).alias("coverage")))


def topk_entropy(shares: DataFrame) -> DataFrame:
    """DV4: entropy of the category shares at each k (normalised first)."""
    p = F.col("percentage")
    return shares.groupBy("k").agg(
        (F.log(F.sum(p)) - F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0)) / F.sum(p)).alias("entropy"))


def topk_gini(shares: DataFrame) -> DataFrame:
    """DV5 ``gini_index``: shares sorted ascending, Σ(2j − n − 1)·w / (n − 1);
    null for a single category."""
    w = Window.partitionBy("k").orderBy("percentage", "top_cat")
    j = shares.withColumn("j", F.row_number().over(w))
    return j.groupBy("k").agg(F.count(F.lit(1)).alias("n"),
                              F.sum((2 * F.col("j")) * F.col("percentage")).alias("a"),
                              F.sum("percentage").alias("s")).select(
        "k", F.try_divide(F.col("a") - (F.col("n") + 1) * F.col("s"), (F.col("n") - 1).cast("double")).alias("gini"))
