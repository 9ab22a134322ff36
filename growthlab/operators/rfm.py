"""RFM tables and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlab.functions.columns import mean_units, money_units, units_to_money
from growthlab.functions.ordered import discrete_quantiles, edges_array, exact_quantiles, global_cumsum, materialize
from growthlab.operators.summaries import quantile_trim


def rfm(sales: DataFrame, start, end, customers: DataFrame | None = None,
        date_col: str = "dt", price_col: str = "selling_price") -> DataFrame:
    """RF1: per customer over [start, end]: ``frequency`` = distinct purchase days
    (no −1), ``monetary_value`` mean price, ``total_value`` sum,
    ``recency`` = (end + 1) − last purchase day.  ``customers`` restricts the
    population (semi join, replaces the reference's inner join on a distinct list)."""
    s = sales.where(F.col(date_col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if customers is not None:
        s = s.join(customers.select("customer_id"), "customer_id", "left_semi")
    daily = s.groupBy("customer_id", date_col).agg(F.sum(money_units(price_col)).alias("v"),
                                                   F.count(F.lit(1)).alias("n"))
    a = daily.groupBy("customer_id").agg(F.count(F.lit(1)).alias("frequency"), F.sum("v").alias("tv"),
                                         F.sum("n").alias("tn"), F.max(date_col).alias("max_dt"))
    return a.select("customer_id", "frequency",
                    F.datediff(F.date_add(F.lit(end).cast("date"), 1), F.col("max_dt")).alias("recency"),
                    mean_units("tv", "tn").alias("monetary_value"), units_to_money("tv").alias("total_value"))


def trim_rfm(df: DataFrame, q: float = 0.99) -> DataFrame:
    """Drop the top 1 % of frequency, then of total value (strict, in that order; the
    thresholds are elements of the columns, as ``approxQuantile`` gives)."""
    return quantile_trim(quantile_trim(df, "frequency", q, element=True), "total_value", q, element=True)


def _bucket_lower_closed(x: Column, edges: Column) -> Column:
    # [lo, hi) bins: number of edges <= x
    return F.size(F.filter(edges, lambda e: e <= x.cast("double")))


def _bucket_upper_closed(x: Column, edges: Column) -> Column:
    # (lo, hi] bins over the inner edges: number of edges < x
    return F.size(F.filter(edges, lambda e: e < x.cast("double")))


def quantile_buckets(df: DataFrame, col: str, n: int, out: str, right_closed: bool = False,
                     interpolate: bool = False) -> DataFrame:
    """Add ``out`` = 0-based quantile bucket of ``col`` with ``n`` buckets.

    * default: ``QuantileDiscretizer``-style, element-quantile edges, ``[lo, hi)``
    * ``right_closed=True, interpolate=True``: pandas ``qcut`` (interpolated edges,
      ``(lo, hi]``, the minimum in the first bin).
    Tied edges merge into one (fewer buckets).  Null stays null.  The edge array
    is one broadcast row."""
    qs = [i / n for i in range(1, n)]
    e = exact_quantiles(df, col, qs) if interpolate else discrete_quantiles(df, col, qs)
    edges = edges_array(e).withColumnRenamed("edges", "__edges_" + out)
    fn = _bucket_upper_closed if right_closed else _bucket_lower_closed
    b = F.when(F.col(col).isNull(), F.lit(None)).otherwise(fn(F.col(col), F.col("__edges_" + out)))
    return df.join(F.broadcast(edges)).withColumn(out, b.cast("int")).drop("__edges_" + out)


def rfm_quantile_score(df: DataFrame, n: int = 4) -> DataFrame:
    """RF2: F = 1 + b(frequency), M = 1 + b(total_value), R = n − b(recency),
    ``rfm`` = R + F + M, with ``[lo, hi)`` element-quantile buckets."""
    out = quantile_buckets(df, "recency", n, "bR")
    out = quantile_buckets(out, "frequency", n, "bF")
    out = quantile_buckets(out, "total_value", n, "bM")
    return (out.withColumn("R", F.lit(n) - F.col("bR")).withColumn("F", F.col("bF") + 1)
               .withColumn("M", F.col("bM") + 1).withColumn("rfm", F.col("R") + F.col("F") + F.col("M"))
               .drop("bR", "bF", "bM"))


def rfm_qcut_score(df: DataFrame, n: int = 4) -> DataFrame:
    """RF3 ``compute_rfm_value``: pandas ``qcut`` buckets; R reversed;
    ``rfm`` = the digits R, F, M read as one integer; ``rfm_score`` = R + F + M."""
    out = quantile_buckets(df, "recency", n, "bR", right_closed=True, interpolate=True)
    out = quantile_buckets(out, "frequency", n, "bF", right_closed=True, interpolate=True)
    out = quantile_buckets(out, "total_value", n, "bM", right_closed=True, interpolate=True)
    out = (out.withColumn("R", F.lit(n) - F.col("bR")).withColumn("F", F.col("bF") + 1)
              .withColumn("M", F.col("bM") + 1).drop("bR", "bF", "bM"))
    return (out.withColumn("rfm", F.concat(F.col("R").cast("string"), F.col("F").cast("string"),
                                            F.col("M").cast("string")).cast("int"))
               .withColumn("rfm_score", F.col("R") + F.col("F") + F.col("M")))


def describe(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """AG16 ``summary()``: count, mean, std (sample), min, quartiles (elements), max per
    column.  Long form: (``by``…, ``column``, stats).  Quartiles come from running counts of
    the distinct values over all groups at once, each group's share cut out by its offset."""
    by = list(by or [])
    sel = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    long = materialize(sel.unpivot(by, cols, "column", "value"))
    keys = [*by, "column"]
    out = long.groupBy(*keys).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    counts = long.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("cnt"))
    run = global_cumsum(counts, [*keys, "value"], ["cnt"])
    start = run.groupBy(*keys).agg(F.min(F.col("cum_cnt") - F.col("cnt")).alias("__start"), F.sum("cnt").alias("__n"))
    hi = F.col("cum_cnt") - F.col("__start")
    place = lambda q: F.greatest(F.ceil(F.col("__n") * q) - 1, F.lit(0))
    quartiles = run.join(start, keys).groupBy(*keys).agg(*[
        F.max(F.when((hi - F.col("cnt") <= place(q)) & (place(q) < hi), F.col("value"))).alias(name)
        for name, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))])
    return out.join(quartiles, keys, "left")
