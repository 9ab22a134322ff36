"""Customer summaries and table-wide statistics on them
(quantile trim, quantiles, tail describe, correlation, percentile ranks).

Per-customer summaries aggregate in two steps, (customer, day) then customer:
both steps combine map-side, the second shuffle carries at most one row per
customer-day, and a customer with a third of all rows is split across its days
in the first step.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlab.functions.columns import hash_sample, mean_units, money_units, units_to_money
from growthlab.functions.ordered import exact_quantiles, materialize, quantile_value, value_counts_cum


def _window(df: DataFrame, start, end, category=None, date_col="dt", cat_col="category_id") -> DataFrame:
    out = df.where(F.col(date_col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if category is not None:
        out = out.where(F.col(cat_col) == F.lit(category))
    return out


def history_summary(sales: DataFrame, start, end, category=None, keys=("customer_id",),
                    price_col="selling_price", with_money=True, with_total=True,
                    price_as_int=False, include_first=True) -> DataFrame:
    """CS1 / CS2 / CS6: per key, over the inclusive window [start, end]:

    * ``frequency`` = distinct purchase days − 1
    * ``recency``   = last day − first day (0 for a single day)
    * ``T``         = window end − first day
    * ``monetary_value`` = mean price over all rows, ``total_value`` = sum.
      With ``include_first=False`` the library convention instead: mean of the
      daily totals of the repeat days (first day excluded), 0 without repeats."""
    keys = list(keys)
    s = _window(sales, start, end, category)
    price = F.col(price_col).cast("int").cast("double") if price_as_int else F.col(price_col)
    daily = (s.groupBy(*keys, "dt")
               .agg(F.sum(money_units(price)).alias("v"), F.count(F.lit(1)).alias("n")))
    aggs = [F.count(F.lit(1)).alias("tx_cnt"), F.min("dt").alias("min_dt"), F.max("dt").alias("max_dt")]
    if with_money:
        aggs += [F.sum("v").alias("tv"), F.sum("n").alias("tn")]
        if not include_first:
            aggs.append(F.min_by("v", "dt").alias("v_first"))
    a = daily.groupBy(*keys).agg(*aggs)
    cols = [*keys, (F.col("tx_cnt") - 1).alias("frequency"),
            F.datediff("max_dt", "min_dt").alias("recency")]
    if with_money and include_first:
        cols.append(mean_units("tv", "tn").alias("monetary_value"))
    elif with_money:
        cols.append(F.when(F.col("tx_cnt") > 1, mean_units(F.col("tv") - F.col("v_first"), F.col("tx_cnt") - 1))
                    .otherwise(F.lit(0.0)).alias("monetary_value"))
    cols.append(F.datediff(F.lit(end).cast("date"), F.col("min_dt")).alias("T"))
    if with_money and with_total:
        cols.append(units_to_money("tv").alias("total_value"))
    return a.select(*cols)


def customer_summary(sales: DataFrame, start, end, category=None, price_as_int=False) -> DataFrame:
    """CS1 ``history_by_category``."""
    return history_summary(sales, start, end, category, price_as_int=price_as_int)


def customer_category_summary(sales: DataFrame, start, end) -> DataFrame:
    """CS2: per (customer, category), no ``total_value``."""
    return history_summary(sales, start, end, None, keys=("customer_id", "category_id"), with_total=False)


def transaction_summary(txn: DataFrame, end, start=None, id_col="customer_id", date_col="dt") -> DataFrame:
    """CS6 ``summary_data_from_transaction_data``: frequency, recency, T up to ``end``."""
    t = txn.select(F.col(id_col).alias("customer_id"), F.col(date_col).alias("dt"))
    lo = start if start is not None else "0001-01-01"
    return history_summary(t.withColumn("selling_price", F.lit(0.0)), lo, end, with_money=False)


def calibration_holdout(txn: DataFrame, cal_start, cal_end, obs_end, category=None) -> DataFrame:
    """CS7 ``calibration_and_holdout_data``: ``*_cal`` summary up to ``cal_end``;
    ``frequency_holdout`` = purchase days in (cal_end, obs_end]; ``duration_holdout``
    = obs_end − cal_end days.  Customers first seen in the hold-out are not included."""
    cal = history_summary(txn, cal_start, cal_end, category, with_money=False)
    cal = cal.select("customer_id", F.col("frequency").alias("frequency_cal"),
                     F.col("recency").alias("recency_cal"), F.col("T").alias("T_cal"))
    hold = _window(txn, F.date_add(F.lit(cal_end).cast("date"), 1), obs_end, category)
    hold = (hold.select("customer_id", "dt").distinct()
                .groupBy("customer_id").agg(F.count(F.lit(1)).alias("frequency_holdout")))
    dur = F.datediff(F.lit(obs_end).cast("date"), F.lit(cal_end).cast("date"))
    return (cal.join(hold, "customer_id", "left")
               .select("customer_id", "frequency_cal", "recency_cal", "T_cal",
                       F.coalesce("frequency_holdout", F.lit(0).cast("long")).alias("frequency_holdout"),
                       dur.alias("duration_holdout")))


def quantile_trim(df: DataFrame, col: str, q: float = 0.99, element: bool = False) -> DataFrame:
    """FLT8: keep rows with ``col`` strictly below its exact q-quantile (linear
    interpolation, or an element of the column).  The threshold is a one-row table
    joined by broadcast."""
    thr = quantile_value(df, col, q, element)
    return df.join(F.broadcast(thr), F.col(col) < F.col("qv"), "left_semi")


def value_quantiles(df: DataFrame, col: str, qs=(0.25, 0.5, 0.75, 0.85, 0.95, 0.99)) -> DataFrame:
    """AG15: exact quantiles of one column, (q, value) rows."""
    return exact_quantiles(df, col, list(qs), "value")


def value_sketches(df: DataFrame, keys: list[str], col: str, error: float = 0.01) -> DataFrame:
    """A mergeable quantile sketch (KLL) of ``col`` per key, column ``sketch``: a few kilobytes
    whatever the number of rows.  ``error`` bounds the rank error, as a share of the rows; the
    sketch's size is chosen for a quarter of it, so that even the worst of very many
    quantiles stays within."""
    k = min(65535, max(200, math.ceil((2.296 / (error / 4)) ** (1 / 0.9021))))  # published error of size k: 2.296 / k^0.9021
    return df.where(F.col(col).isNotNull()).groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(col).cast("double"), k).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer keys united to coarser ones; the rows themselves are not needed."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, keys: list[str], qs) -> DataFrame:
    """(keys, q, value) rows of the sketches."""
    each = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias("value")) for q in qs]))
    return sketches.select(*keys, each.alias("s")).select(*keys, "s.q", "s.value")


def sketch_quantile_errors(df: DataFrame, key: str, part: str, col: str, qs, error: float) -> DataFrame:
    """(key, q, n, within): quantiles from sketches per (key, part) merged per key, checked
    against the exact ranks of the found values in one more pass: within means that the
    ranks the value holds come within ``error`` of q."""
    found = sketch_quantiles(merge_sketches(value_sketches(df, [key, part], col, error), [key]), [key], qs)
    wide = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("q", "value"))).alias("at"))  # a row per key
    v = F.col(col)
    at = lambda q: F.col("at")[F.lit(float(q))]
    ranks = [F.struct(F.lit(float(q)).alias("q"), F.count(F.when(v < at(q), 1)).alias("below"), F.count(F.when(v <= at(q), 1)).alias("upto")) for q in qs]
    counted = df.where(v.isNotNull()).select(key, col).join(wide, key).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array(*ranks).alias("r"))
    within = (F.col("s.below") / F.col("n") <= F.col("s.q") + error) & (F.col("s.upto") / F.col("n") >= F.col("s.q") - error)
    return counted.select(key, "n", F.explode("r").alias("s")).select(key, "s.q", "n", within.alias("within"))


def train_test_summary(sales: DataFrame, train, test, category=None, sample_ratio=1.0) -> DataFrame:
    """CS3: summaries of a train and a test window; with ``sample_ratio`` < 1 a
    deterministic hash sample of the train customers, and the test summary
    restricted to them.  One table with a ``part`` column."""
    tr = customer_summary(sales, train[0], train[1], category)
    te = customer_summary(sales, test[0], test[1], category)
    if sample_ratio < 1.0:
        tr = hash_sample(tr, "customer_id", sample_ratio)
        te = te.join(tr.select("customer_id"), "customer_id", "left_semi")
    return (tr.withColumn("part", F.lit("train"))
              .unionByName(te.withColumn("part", F.lit("test"))))


def two_window_summary(sales: DataFrame, cal, hold, category=None) -> DataFrame:
    """CS1 of a calibration and a hold-out window in one pass over the sales: per customer
    ``frequency``, ``recency``, ``T``, ``monetary_value``, ``total_value`` of the first and
    ``frequency_holdout``, ``money_holdout``, ``total_holdout`` of the second; the columns of
    a window without a purchase are null."""
    day = lambda d: F.lit(d).cast("date")
    within = lambda w: F.col("dt").between(day(w[0]), day(w[1]))
    s = sales.where(within(cal) | within(hold))
    s = s if category is None else s.where(F.col("category_id") == F.lit(category))
    daily = s.groupBy("customer_id", "dt").agg(F.sum(money_units(F.col("selling_price"))).alias("v"), F.count(F.lit(1)).alias("n"))
    of = lambda w, c: F.when(within(w), F.col(c))
    aggs = [f.alias(name + part) for w, part in ((cal, "_c"), (hold, "_h"))
            for f, name in ((F.count(of(w, "dt")), "days"), (F.sum(of(w, "v")), "v"), (F.sum(of(w, "n")), "n"))]
    a = daily.groupBy("customer_id").agg(*aggs, F.min(of(cal, "dt")).alias("first"), F.max(of(cal, "dt")).alias("last"))
    bought = lambda part, c: F.when(F.col("days" + part) > 0, c)
    return a.select(
        "customer_id", bought("_c", F.col("days_c") - 1).alias("frequency"), F.datediff("last", "first").alias("recency"),
        F.datediff(day(cal[1]), F.col("first")).alias("T"), bought("_c", mean_units("v_c", "n_c")).alias("monetary_value"),
        bought("_c", units_to_money("v_c")).alias("total_value"), bought("_h", F.col("days_h") - 1).alias("frequency_holdout"),
        bought("_h", mean_units("v_h", "n_h")).alias("money_holdout"), bought("_h", units_to_money("v_h")).alias("total_holdout"))


def pre_post_table(sales: DataFrame, cal, hold, category=None, q: float = 0.99,
                   weeks: bool = False) -> DataFrame:
    """CS8: calibration and hold-out summaries, each trimmed at the q-quantile of
    ``frequency``, renamed, left-joined on the customer, nulls → 0, plus
    ``duration_holdout`` (days, or weeks).

    Both windows come from one conditional aggregate, written once (``materialize``), so the
    sales are read once; the two thresholds are narrow passes over it, and no join of the
    windows is needed."""
    both = materialize(two_window_summary(sales, cal, hold, category))
    limits = quantile_value(both, "frequency", q).withColumnRenamed("qv", "q_cal").join(
        F.broadcast(quantile_value(both, "frequency_holdout", q).withColumnRenamed("qv", "q_hold")), F.lit(True), "left")
    kept = both.join(F.broadcast(limits), F.col("frequency") < F.col("q_cal"))
    stays = F.col("frequency_holdout") < F.col("q_hold")
    post = lambda c, zero: F.coalesce(F.when(stays, F.col(c)), zero).alias(c)
    days = F.datediff(F.lit(hold[1]).cast("date"), F.lit(cal[1]).cast("date")).cast("double")
    dur = days / 7.0 if weeks else days
    return kept.select(
        F.col("customer_id").alias("id"), F.col("frequency").alias("frequency_cal"), F.col("recency").alias("recency_cal"),
        F.col("T").alias("T_cal"), "monetary_value", "total_value", post("frequency_holdout", F.lit(0).cast("long")),
        post("money_holdout", F.lit(0.0)), post("total_holdout", F.lit(0.0)), dur.alias("duration_holdout"))


def example_histories(sales: DataFrame, start, end, category, frequencies=(2, 10)) -> DataFrame:
    """CS4: for each wanted frequency the smallest customer id with it, and all
    that customer's rows in the window."""
    summ = customer_summary(sales, start, end, category)
    pick = (summ.where(F.col("frequency").isin(list(frequencies)))
                .groupBy("frequency").agg(F.min("customer_id").alias("customer_id")))
    rows = _window(sales, start, end, category)
    return rows.join(pick, "customer_id").select(
        "frequency", "customer_id", "category_id", "dt", "selling_price")


def category_popularity(sales: DataFrame, start=None, end=None) -> DataFrame:
    """CS5: rows per category, most popular first."""
    s = sales if start is None else _window(sales, start, end)
    return s.groupBy("category_id").agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), "category_id")


def tail_describe(df: DataFrame, col: str, top_share: float = 0.4) -> DataFrame:
    """AG17: describe the top ``top_share`` of the sorted values: rows with
    0-based ascending position ≥ ⌊(1-top_share)·n⌋."""
    vc = value_counts_cum(df, col)
    n = vc.agg(F.max("cum_cnt").alias("n"))
    cut = n.select("n", F.floor(F.col("n") * F.lit(1.0 - top_share)).cast("long").alias("cut"))
    # a value block [cum-cnt, cum) contributes its rows with position >= cut
    tail = (vc.join(F.broadcast(cut), F.col("cum_cnt") > F.col("cut"))
              .select(F.col(col).cast("double").alias("x"), F.greatest(F.col("cum_cnt") - F.col("cnt"), F.col("cut")).alias("lo"),
                      F.col("cum_cnt").alias("hi"), "n", "cut")
              .withColumn("w", F.col("hi") - F.col("lo")))
    mean = tail.agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"))

    def at(place):  # the value whose block holds a position
        return F.max(F.when((F.col("lo") <= place) & (place < F.col("hi")), F.col("x")))

    quartiles = {}
    for name, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        h = F.col("cut") + (F.col("n") - F.col("cut") - 1) * q
        part = F.max(h - F.floor(h))
        quartiles[name] = (at(F.floor(h)) + part * (at(F.ceil(h)) - at(F.floor(h)))).alias(name)
    # deviations from the mean, not a difference of large squares
    square = F.sum(F.col("w") * F.pow(F.col("x") - F.col("mean"), 2))
    return tail.join(F.broadcast(mean)).agg(
        F.sum("w").alias("count"), F.first("mean").alias("mean"), F.min("x").alias("min"), *quartiles.values(),
        F.max("x").alias("max"), F.sqrt(square / (F.sum("w") - 1)).alias("std"))


def freq_money_corr(df: DataFrame, f="frequency", m="monetary_value") -> DataFrame:
    """AG18: Pearson correlation of frequency and money over repeat buyers."""
    r = df.where((F.col(f) > 0) & (F.col(m) > 0))
    return r.agg(F.corr(F.col(f).cast("double"), F.col(m)).alias("corr"), F.count(F.lit(1)).alias("n"))


def dense_pct_rank(df: DataFrame, col: str, ascending: bool = False, id_col="customer_id") -> DataFrame:
    """WN5: pandas ``rank(method='dense', pct=True)``: dense rank / number of
    distinct values (nulls keep a null rank)."""
    vc = value_counts_cum(df, col, ascending)
    nd = vc.agg(F.max("dense_rank").alias("nd"))
    r = vc.join(F.broadcast(nd)).select(col, (F.col("dense_rank") / F.col("nd")).alias("pct_rank"))
    return df.select(id_col, col).join(r, col, "left")


def avg_pct_rank(df: DataFrame, col: str, ascending: bool = True, id_col="customer_id") -> DataFrame:
    """WN6: pandas ``rank(pct=True)`` (average method): (#before + (ties+1)/2) / n."""
    vc = value_counts_cum(df, col, ascending)
    n = vc.agg(F.max("cum_cnt").alias("n"))
    r = vc.join(F.broadcast(n)).select(
        col, ((F.col("cum_cnt") - F.col("cnt") + (F.col("cnt") + 1) / 2.0) / F.col("n")).alias("pct_rank"))
    return df.select(id_col, col).join(r, col, "left")
