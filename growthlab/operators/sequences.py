"""Category sequences and next-category n-grams.

The sequence of a customer is kept in long form (customer, position, category)
instead of one collected array.  Positions and predecessors come from a restarting
count over range partitions (``functions.ordered.group_positions``), so a customer
with a third of all events is spread over many tasks and nothing is joined on the
customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlab.functions.ordered import group_positions


def _ordered(events: DataFrame) -> DataFrame:
    """(customer_id, seq_pos, cma_id, pre): events with a click, icon click or sale, ordered
    per customer by (day, category id as a number, banner id), with the category before."""
    e = events.where((F.coalesce("banner_clicks", F.lit(0)) + F.coalesce("icon_clicks", F.lit(0))
                      + F.coalesce("sales", F.lit(0))) > 0)
    e = e.select("customer_id", "dt", "cma_id", "banner_id", F.col("cma_id").cast("int").alias("__c"))
    return group_positions(e, "customer_id", ["dt", "__c", "banner_id"], "seq_pos", ("cma_id", "pre"))


def category_sequence(events: DataFrame) -> DataFrame:
    """NG1: (customer_id, seq_pos, cma_id)."""
    return _ordered(events).select("customer_id", "seq_pos", "cma_id")


def category_bigrams(events: DataFrame) -> DataFrame:
    """NG2: consecutive pairs (``NGram(n=2)``) at the position of the first; a sequence of
    one item gives none."""
    return _ordered(events).where(F.col("seq_pos") > 1).select(
        "customer_id", (F.col("seq_pos") - 1).alias("seq_pos"), "pre", F.col("cma_id").alias("nxt"))


def next_category_share(bigrams: DataFrame) -> DataFrame:
    """NG3: bigram counts and each next category's share among bigrams with the
    same first category (all first categories at once)."""
    c = bigrams.groupBy("pre", "nxt").agg(F.count(F.lit(1)).alias("count"))
    t = c.groupBy("pre").agg(F.sum("count").alias("__t"))
    return c.join(t, "pre").withColumn("share", F.col("count") / F.col("__t")).drop("__t")


def repeat_share(bigrams: DataFrame) -> DataFrame:
    """NG4: share of self-transitions (``nxt = pre``) per first category."""
    return bigrams.groupBy("pre").agg(F.count(F.lit(1)).alias("n_bigrams"),
                                      F.avg((F.col("nxt") == F.col("pre")).cast("double")).alias("repeat_share"))
