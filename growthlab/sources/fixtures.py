"""Canonical inputs of the analyses, derived from the driver tables.

The mapping (FIXTURES.md §2) turns the TPC-H-like tables and the ``events``
stream into the shapes the analyses expect:

* ``sales``            customer_id, category_id, dt, selling_price
* ``banner_events``    customer_id, dt, cma_id, banner_id, impressions, banner_clicks,
                       icon_clicks, sales, gmv
* ``category_map``     cma_id, category_name
* ``scores``           customer_id, category_trend_scores array<struct<category_id, probability>>
* ``push_campaigns``   campaign_id, customer_id, scheduler
* ``campaign_metadata``campaign_id, campaign_name, phase_id, phase_name
* ``experiment``       customer_id, banner_id, dt, cma_id, experiment_group_name,
                       final_serving_strategy

Date bounds are applied to the raw timestamp columns so that they reach the
Parquet scan as pushed filters; category filters reach the ``part`` scan.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from growthlab.sources.io import table


def _ts_bounds(col, start, end):
    """``start <= to_date(col) <= end`` written on the raw timestamp (pushable)."""
    # literals are built from strings: independent of the Python and session time zones
    cond = F.lit(True)
    if start is not None:
        cond = cond & (col >= F.lit(f"{start.isoformat()} 00:00:00").cast("timestamp_ntz"))
    if end is not None:
        nxt = end + _dt.timedelta(days=1)
        cond = cond & (col < F.lit(f"{nxt.isoformat()} 00:00:00").cast("timestamp_ntz"))
    return cond


def sales(spark: SparkSession, sf_dir: str, start=None, end=None, category=None) -> DataFrame:
    """Sales lines: brand is the category, order date the sale day."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount")
    o = (table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
         .where(_ts_bounds(F.col("o_orderdate"), start, end)))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    if category is not None:
        p = p.where(F.col("p_brand") == category)
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .join(p, li.l_partkey == p.p_partkey)
              .select(F.col("o_custkey").alias("customer_id"),
                      F.col("p_brand").alias("category_id"),
                      F.to_date("o_orderdate").alias("dt"),
                      (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("selling_price")))


def banner_events(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    """Daily banner counters per (customer, day, category, banner).

    view = impression, click = banner click, signup = icon click, purchase = sale.
    Pre-aggregated with a map-side partial aggregate before the shuffle."""
    ev = (table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value", "props")
          .where(_ts_bounds(F.col("ts"), start, end)))
    k = F.get_json_object("props", "$.k").cast("int")
    et = F.col("event_type")

    def n(kind):
        return F.sum(F.when(et == kind, 1).otherwise(0)).cast("long")

    return (ev.select(F.col("user_id").alias("customer_id"), F.to_date("ts").alias("dt"),
                      (k % 12 + 1).cast("string").alias("cma_id"),
                      (k % 30 + 1).cast("string").alias("banner_id"), et, "value")
              .groupBy("customer_id", "dt", "cma_id", "banner_id")
              .agg(n("view").alias("impressions"), n("click").alias("banner_clicks"),
                   n("signup").alias("icon_clicks"), n("purchase").alias("sales"),
                   F.sum(F.when(et == "purchase", F.col("value")).otherwise(F.lit(0.0))).alias("gmv")))


def category_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category id to name, a row per nation."""
    return (table(spark, sf_dir, "nation")
            .select((F.col("n_nationkey") + 1).cast("string").alias("cma_id"),
                    F.col("n_name").alias("category_name")))


def _within(events: DataFrame, start, end) -> DataFrame:
    """Banner rows already at hand, cut to a range of days (either end may be open)."""
    dt = F.col("dt")
    events = events if start is None else events.where(dt >= F.lit(start).cast("date"))
    return events if end is None else events.where(dt <= F.lit(end).cast("date"))


def scores_long(spark: SparkSession, sf_dir: str, score_day, start=None, events: DataFrame | None = None) -> DataFrame:
    """Model scores in long form: share of a customer's banner rows per category,
    up to ``score_day``.  ``events``: the banner rows, when the caller already has them."""
    be = banner_events(spark, sf_dir, start, score_day) if events is None else _within(events, start, score_day)
    c = be.groupBy("customer_id", "cma_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("customer_id")
    return c.select("customer_id", F.col("cma_id").alias("category_id"),
                    (F.col("n") / F.sum("n").over(w)).alias("probability"))


def scores(spark: SparkSession, sf_dir: str, score_day, start=None, events: DataFrame | None = None) -> DataFrame:
    """Scores collected per customer into ``category_trend_scores`` (sorted by
    category id, the input order the "stable" tie rule relies on)."""
    lg = scores_long(spark, sf_dir, score_day, start, events)
    return (lg.groupBy("customer_id")
              .agg(F.array_sort(F.collect_list(F.struct("category_id", "probability")))
                   .alias("category_trend_scores")))


def scores_by_day(spark: SparkSession, sf_dir: str, first_day, last_day) -> DataFrame:
    """Daily score snapshots for a rolling evaluation: the snapshot of day ``d``
    uses banner rows up to ``d``.  One job keyed by ``dt`` (no per-day loop).

    Rows are counted per customer, category and day, all earlier history as the first
    day, and gathered per customer (at most categories x days entries).  Each day's scores
    are read off that array as of the day, after the last shuffle: what is shuffled does
    not grow with the number of snapshots."""
    day = F.greatest(F.col("dt"), F.lit(first_day).cast("date")).alias("dt")
    counts = banner_events(spark, sf_dir, None, last_day).groupBy("customer_id", "cma_id", day).agg(F.count(F.lit(1)).alias("n"))
    seen = counts.groupBy("customer_id").agg(F.collect_list(F.struct("cma_id", "dt", "n")).alias("seen"))
    days = seen.select("customer_id", "seen", F.explode(F.sequence(F.lit(first_day), F.lit(last_day))).alias("day"))
    as_of = days.select(F.col("day").alias("dt"), "customer_id", F.filter("seen", lambda e: e["dt"] <= F.col("day")).alias("now")).where(F.size("now") > 0)
    count = lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda acc, e: acc + e["n"])
    categories = F.array_sort(F.array_distinct(F.transform("now", lambda e: e["cma_id"])))
    return as_of.withColumn("total", count(F.col("now"))).select("dt", "customer_id", F.transform(categories, lambda c: F.struct(
        c.alias("category_id"), (count(F.filter("now", lambda e: e["cma_id"] == c)) / F.col("total")).alias("probability"))).alias("category_trend_scores"))


def push_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(campaign, customer, scheduler): a campaign is a supplier; urgent/high
    priority orders are scheduled by the classic rule, the rest by the model."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .select(F.col("l_suppkey").alias("campaign_id"), F.col("o_custkey").alias("customer_id"),
                      F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("classic"))
                       .otherwise(F.lit("model")).alias("scheduler"))
              .distinct())


def campaign_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
              .select(F.col("s_suppkey").alias("campaign_id"), F.col("s_name").alias("campaign_name"),
                      F.col("n_regionkey").alias("phase_id"), F.col("r_name").alias("phase_name")))


def experiment(spark: SparkSession, sf_dir: str, start=None, end=None, events: DataFrame | None = None) -> DataFrame:
    be = banner_events(spark, sf_dir, start, end) if events is None else _within(events, start, end)
    cid = F.col("customer_id")
    return (be.select("customer_id", "banner_id", "dt", "cma_id",
                      F.when(cid % 2 == 0, F.lit("raw")).otherwise(F.lit("rt")).alias("experiment_group_name"),
                      F.when(cid % 3 == 0, F.lit("manual")).otherwise(F.lit("autopilot"))
                       .alias("final_serving_strategy"))
              .distinct())


def customer_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (customer, phase) of classic-scheduled campaigns."""
    pc = push_campaigns(spark, sf_dir).where(F.col("scheduler") == "classic")
    md = campaign_metadata(spark, sf_dir).select("campaign_id", "phase_id")
    return pc.join(md, "campaign_id").select("customer_id", "phase_id").distinct()
