"""Agreement statistics: Kendall τ-b, Spearman, Jaccard,
category shares per source.

Kendall τ-b compares two arrays of equal, bounded length (one entry per
category) with an array expression; no pair rows are produced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthlab.functions.arrays import let, top_ids
from growthlab.functions.ordered import discrete_quantiles, materialize, value_at, value_counts_cum


def kendall_tau_b(x: Column, y: Column) -> Column:
    """τ-b = (C − D) / √((n0 − n1)(n0 − n2)); null when either side is constant, holds a null,
    or the lengths differ.  Knight's method: the pairs are sorted by x, then y; D is the number
    of inversions of y in that order, counted by merging blocks of doubling length, and the
    tied pairs are run lengths, so the work grows as n log² n of the array's length."""
    idx = F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)))
    pairs = F.array_sort(F.transform(idx, lambda i: F.struct(F.get(x, i).cast("double").alias("a"), F.get(y, i).cast("double").alias("b"))))
    usable = (F.size(x) == F.size(y)) & (F.size(x) > 1) & ~F.exists(x, lambda v: v.isNull()) & ~F.exists(y, lambda v: v.isNull())
    return F.when(usable, let(_kendall_core, p=pairs))


def _tied_pairs(rows: Column, same) -> Column:
    """Pairs of neighbours, and so on, that are equal in a sorted array: Σ t (t − 1) / 2."""
    zero = F.struct(F.element_at(rows, 1).alias("last"), F.lit(-1).cast("long").alias("run"), F.lit(0).cast("long").alias("n"))

    def step(acc, e):
        run = F.when(same(acc["last"], e), acc["run"] + 1).otherwise(F.lit(0).cast("long"))
        return F.struct(e.alias("last"), run.alias("run"), (acc["n"] + run).alias("n"))
    return F.aggregate(rows, zero, step)["n"]


def _inversions(values: Column) -> Column:
    """Pairs of an array in falling order."""
    n = F.size(values)
    zero = F.lit(0).cast("long")

    def across(width, start):  # of a left and a right block of ``width``: right values below a left one
        sides = F.transform(F.slice(values, start + 1, 2 * width), lambda v, i: F.struct(v.alias("v"), (i >= width).alias("right")))
        none = F.struct(zero.alias("seen"), zero.alias("n"))
        return F.aggregate(F.array_sort(sides), none, lambda acc, e: F.struct(
            (acc["seen"] + e["right"].cast("long")).alias("seen"), (acc["n"] + F.when(e["right"], zero).otherwise(acc["seen"])).alias("n")))["n"]

    widths = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int") - 1), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.aggregate(widths, zero, lambda acc, w: acc + F.aggregate(
        F.sequence(F.lit(0), n - 1, 2 * w), zero, lambda sub, start: sub + across(w, start)))


def _kendall_core(p: Column) -> Column:
    n = F.size(p).cast("long")
    all_pairs = n * (n - 1) / 2
    ys = F.transform(p, lambda e: e["b"])
    n1 = _tied_pairs(p, lambda s, t: s["a"] == t["a"])
    n2 = _tied_pairs(F.array_sort(ys), lambda s, t: s == t)
    n3 = _tied_pairs(p, lambda s, t: (s["a"] == t["a"]) & (s["b"] == t["b"]))
    den = F.sqrt((all_pairs - n1) * (all_pairs - n2))
    return F.when(den > 0, (all_pairs - n1 - n2 + n3 - 2 * let(_inversions, ys=ys)) / den)


def category_rank_arrays(scores: DataFrame, categories: list[str], missing_rank: int | None = None) -> DataFrame:
    """Rank arrays: for each listed category its rank in the customer's scores
    (descending, ties by id), ``missing_rank`` (default len+1) when unscored."""
    miss = missing_rank if missing_rank is not None else len(categories) + 1
    cats = F.array(*[F.lit(c) for c in categories])
    ranks = let(lambda ids: F.transform(cats, lambda c: F.when(F.array_position(ids, c) > 0, F.array_position(ids, c))
                                        .otherwise(F.lit(miss).cast("long"))),
                ids=top_ids("category_trend_scores", None, "asc"))
    return scores.select("customer_id", ranks.alias("ranks"))


def kendall_per_customer(rank_arrays: DataFrame, expected: list[int]) -> DataFrame:
    """RK1: τ-b of each customer's rank array against ``expected``."""
    e = F.array(*[F.lit(v).cast("long") for v in expected])
    return rank_arrays.select("customer_id", kendall_tau_b(F.col("ranks"), e).alias("tau"))


def kendall_quantiles(taus: DataFrame, qs=(0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99)) -> DataFrame:
    """RK2: element quantiles of τ (nulls skipped)."""
    return discrete_quantiles(taus, "tau", list(qs), "value")


def category_share(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """RK3 / RK4: rows per category (within ``by``) and their share, rounded to
    6 digits as in the reference."""
    by = list(by or [])
    c = rows.groupBy(*by, "cma_id").agg(F.count(F.lit(1)).alias("count"))
    t = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__t"))
    j = c.join(t, by) if by else c.join(F.broadcast(t))
    return j.withColumn("percent", F.round(F.col("count") / F.col("__t"), 6)).drop("__t")


def topk_agreement(pred_counts: DataFrame, sales_counts: DataFrame, steps: int = 10) -> DataFrame:
    """RK5 ``evaluate``: for cut-offs k = 10 %, …, 100 %: the top ⌊n·k⌋−1 sold
    categories (n = sold categories; ties by id) left-joined to the same number
    of top predicted categories; Kendall τ-b of the two counts (a missing
    prediction counts 0) and the Jaccard similarity of the two id sets.

    Both inputs have one row per category (bounded by the category dimension),
    so the ordering windows and the per-cut-off arrays below are small."""
    w_s = Window.orderBy(F.desc("test_count"), "cma_id")
    w_p = Window.orderBy(F.desc("pred_count"), "cma_id")
    s = sales_counts.select("cma_id", F.col("count").alias("test_count")).withColumn("rs", F.row_number().over(w_s))
    p = pred_counts.select("cma_id", F.col("count").alias("pred_count")).withColumn("rp", F.row_number().over(w_p))
    n = s.agg(F.count(F.lit(1)).alias("n"))
    cut = n.select(F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("i"), "n").select(
        (F.col("i") / F.lit(float(steps)) * 100.0).alias("top_percent_category"),
        F.greatest(F.floor(F.col("n") * (F.col("i") / F.lit(float(steps)))).cast("long") - 1, F.lit(0).cast("long"))
        .alias("c"))
    st = F.broadcast(cut).join(s, F.col("rs") <= F.col("c"))
    pt = F.broadcast(cut).join(p, F.col("rp") <= F.col("c")).select("top_percent_category", "cma_id", "pred_count")
    joined = (st.join(pt, ["top_percent_category", "cma_id"], "left")
                .withColumn("pred_count", F.coalesce("pred_count", F.lit(0).cast("long"))))
    arrs = joined.groupBy("top_percent_category").agg(
        F.array_sort(F.collect_list(F.struct("rs", "pred_count", "test_count", "cma_id"))).alias("a"))
    pid = pt.groupBy("top_percent_category").agg(F.collect_set("cma_id").alias("pid"))
    res = (cut.join(arrs, "top_percent_category", "left").join(pid, "top_percent_category", "left")
              .select("top_percent_category",
                      kendall_tau_b(F.transform("a", lambda e: e["pred_count"]),
                                    F.transform("a", lambda e: e["test_count"])).alias("kendall"),
                      F.try_divide(F.size(F.array_intersect(F.coalesce("pid", F.array().cast("array<string>")),
                                                            F.transform(F.coalesce("a", F.array()), lambda e: e["cma_id"]))),
                                   F.size(F.array_union(F.coalesce("pid", F.array().cast("array<string>")),
                                                        F.transform(F.coalesce("a", F.array()), lambda e: e["cma_id"])))
                                   .cast("double")).alias("jc_similarity")))
    return res


def spearman(df: DataFrame, c1: str, c2: str) -> DataFrame:
    """RK6 ``spearman_cor``: nulls → 0, rows where both are 0 dropped, Pearson
    correlation of average ranks (distributed ranks, no one-task window)."""
    d = df.select(F.coalesce(F.col(c1).cast("double"), F.lit(0.0)).alias("a"),
                  F.coalesce(F.col(c2).cast("double"), F.lit(0.0)).alias("b"))
    d = d.where((F.col("a") != 0) | (F.col("b") != 0))
    d = materialize(d)

    def avg_rank(col):
        vc = value_counts_cum(d, col)
        return vc.select(col, (F.col("cum_cnt") - F.col("cnt") + (F.col("cnt") + 1) / 2.0).alias("r_" + col))

    r = d.join(avg_rank("a"), "a").join(avg_rank("b"), "b")
    return r.agg(F.corr("r_a", "r_b").alias("spearman"), F.count(F.lit(1)).alias("n"))


def first_rows(df: DataFrame, id_col: str, value_col: str, top: int) -> DataFrame:
    """One row (``limit``, ``last_id``) that describes the first ``top`` rows by ``value_col``
    descending, ties by the numeric ``id_col``: the rows above ``limit``, and of those equal
    to it the ids up to ``last_id``.  The n-th value and the cut among its ties are selected by
    counting, so no task sorts or holds the first rows."""
    place = df.agg(F.greatest(F.count(value_col) - top, F.lit(0)).alias("place"))
    limit = value_at(df, value_col, place).withColumnRenamed("value", "limit")
    above = df.join(F.broadcast(limit)).agg(F.count(F.when(F.col(value_col) > F.col("limit"), 1)).alias("above"))
    ties = df.join(F.broadcast(limit), F.col(value_col) == F.col("limit"), "left_semi")
    last = value_at(ties, id_col, above.select((F.lit(top) - F.col("above") - 1).alias("place")))
    # fewer ties than places: all of them
    most = ties.agg(F.max(id_col).alias("most"))
    return limit.join(F.broadcast(most)).join(F.broadcast(last), F.lit(True), "left").select(
        "limit", F.coalesce("value", "most").alias("last_id"))


def topn_jaccard(df: DataFrame, id_col: str, c1: str, c2: str, top: int) -> DataFrame:
    """RK7 ``jaccard``: Jaccard similarity of the first ``top`` ids by ``c1`` and
    by ``c2`` (descending, nulls as 0, ties by the numeric, distinct id)."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rows = materialize(df.select(F.col(id_col).alias("id"), zero(c1).alias("a"), zero(c2).alias("b")))
    held = {}
    for c in ("a", "b"):
        cut = first_rows(rows, "id", c, top).select(F.col("limit").alias(f"limit_{c}"), F.col("last_id").alias(f"last_{c}"))
        rows = rows.join(F.broadcast(cut))
        held[c] = (F.col(c) > F.col(f"limit_{c}")) | ((F.col(c) == F.col(f"limit_{c}")) & (F.col("id") <= F.col(f"last_{c}")))
    counts = rows.agg(F.count(F.when(held["a"] & held["b"], 1)).alias("i"), F.count(F.when(held["a"] | held["b"], 1)).alias("u"))
    return counts.select(F.try_divide(F.col("i"), F.col("u")).alias("jaccard"), F.lit(top).alias("top"))
