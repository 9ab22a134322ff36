"""Customer lifetime value.

Scoring is a set of closed-form Column expressions (BG/NBD expected purchases
and P(alive), Gamma-Gamma expected profit, discounted CLV) evaluated on the
per-customer summary table.  The Gauss hypergeometric series of the expected
purchases is an ``aggregate`` over a bounded number of terms, near z = 1 an integral
with a bounded number of nodes.  Fits (LV1, LV2) sum the likelihood and its analytic
gradient at a few step lengths as one Spark aggregate per optimiser step (BFGS), over
distinct (x, t_x, T) rows with counts or over sufficient statistics for each x; only the
parameter vector lives on the driver.

Formulas: Fader, Hardie & Lee (2005) for BG/NBD; Fader & Hardie (2013) for
Gamma-Gamma; textbook retention CLV m·r/(1+d−r)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthlab.functions.arrays import let
from growthlab.functions.ordered import exact_quantiles, materialize, value_counts_cum
from growthlab.functions.special import digamma, lgamma


@dataclass(frozen=True)
class BGNBD:
    r: float
    alpha: float
    a: float
    b: float


@dataclass(frozen=True)
class GammaGamma:
    p: float
    q: float
    v: float


def _c(x):
    return F.col(x) if isinstance(x, str) else x


#: Up to this z the power series is summed; beyond it the integral takes over.
SERIES_LIMIT = 0.9
#: Terms of the power series: z^n < 1e-14 at SERIES_LIMIT.
SERIES_TERMS = 360
#: Step of the integral's nodes, and the logarithm of what its tails may leave out.
NODE_STEP, TAIL = 0.25, 36.0


def _term_index(z: Column, tol: float = 1e-14) -> Column:
    """0, 1, ... up to where z^n < tol, at most SERIES_TERMS."""
    n_terms = F.when(z <= 0, F.lit(1)).otherwise(F.greatest(F.lit(1), (F.ceil(F.log(F.lit(tol)) / F.log(
        F.greatest(F.least(z, F.lit(SERIES_LIMIT)), F.lit(1e-300)))) + 50).cast("int")))
    return F.sequence(F.lit(0), F.least(n_terms, F.lit(SERIES_TERMS)) - 1)


def hyp2f1_series(A: float, B: float, Cc: Column, z: Column) -> Column:
    """Σ_n (A)_n (B)_n / ((C)_n n!) zⁿ for 0 ≤ z ≤ SERIES_LIMIT, summed until zⁿ < 1e-14."""
    idx = _term_index(z)
    init = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s"))
    res = F.aggregate(idx, init, lambda acc, n: F.struct(
        (acc["t"] * (F.lit(A) + n) * (F.lit(B) + n) / ((Cc + n) * (n + 1.0)) * z).alias("t"),
        (acc["s"] + acc["t"]).alias("s")))
    return res["s"]


def purchase_integral(m: BGNBD, tau: Column, x: Column) -> Column:
    """The same factor as an integral over the dropout probability p ~ Beta(a, b+x):

        1/B(a, b+x) · ∫ p^(a−2) (1−p)^(b+x−1) · [1 − (1 + p·τ)^−(r+x)] dp,   τ = t/(α+T)

    With p = 1/(1+e^−s) the integrand is smooth on the whole line and falls off exponentially
    on both sides, so the trapezoid rule is exact to rounding; the number of nodes depends on
    a and b and on ln τ only.  It holds for every a > 0 (a = 1 included) and for z up to 1."""
    bx, k = F.lit(m.b) + x, F.lit(m.r) + x
    low = F.greatest(F.lit(-690.0), -F.log1p(tau) - F.log1p(k) - F.lit(TAIL / m.a))
    high = F.lit(TAIL) / F.least(bx, F.lit(1.0)) + F.lit(1.0)
    nodes = F.sequence(F.floor(low / NODE_STEP).cast("int"), F.ceil(high / NODE_STEP).cast("int"))

    def at(i):
        s = i * F.lit(NODE_STEP)
        log_p, log_q = -F.log1p(F.exp(-s)), -F.log1p(F.exp(s))
        return F.exp(F.lit(m.a - 1.0) * log_p + bx * log_q) * -F.expm1(-k * F.log1p(F.exp(log_p) * tau))
    total = F.aggregate(nodes, F.lit(0.0), lambda acc, i: acc + at(i))
    log_beta = F.lit(math.lgamma(m.a)) + lgamma(bx) - lgamma(F.lit(m.a) + bx)
    return total * F.lit(NODE_STEP) * F.exp(-log_beta)


def bg_inv_d(m: BGNBD, x, t_x, T) -> Column:
    """1 / D with D = 1 + 1{x>0}·a/(b+x−1)·((α+T)/(α+t_x))^(r+x): P(alive)."""
    x, t_x, T = _c(x).cast("double"), _c(t_x).cast("double"), _c(T).cast("double")
    d = F.lit(1.0) + F.when(x > 0, F.lit(m.a) / (F.lit(m.b) + x - 1.0)
                            * F.pow((F.lit(m.alpha) + T) / (F.lit(m.alpha) + t_x), F.lit(m.r) + x)).otherwise(0.0)
    return F.lit(1.0) / d


def probability_alive(m: BGNBD, x, t_x, T) -> Column:
    """LV4."""
    return bg_inv_d(m, x, t_x, T)


def purchase_factor(m: BGNBD, t, x, T) -> Column:
    """The part of the expected purchases that does not depend on recency:
    (a+b+x−1)/(a−1) · [1 − (1−z)^(a−1) · 2F1(a+b−1−r, a−1; a+b+x−1; z)],
    z = t/(α+T+t) (Euler-transformed series, stable for large t).  At a = 1 its limit
    (b+x) · [−ln(1−z) − Σ_{n≥1} (b−r)_n / (b+x)_n · zⁿ/n].  Beyond SERIES_LIMIT, where the
    series would need ever more terms, it is ``purchase_integral``."""
    x, T = _c(x).cast("double"), _c(T).cast("double")
    tt = t if isinstance(t, Column) else F.lit(float(t))
    z = tt / (F.lit(m.alpha) + T + tt)
    cc = F.lit(m.a + m.b - 1.0) + x
    if abs(m.a - 1.0) < 1e-9:
        start = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s"))
        ratio = lambda acc, n: acc["t"] * (F.lit(m.b - m.r) + n) / (cc + n) * z
        res = F.aggregate(_term_index(z), start, lambda acc, n: F.struct(
            ratio(acc, n).alias("t"), (acc["s"] + ratio(acc, n) / (n + 1.0)).alias("s")))
        series = cc * (-F.log(F.lit(1.0) - z) - res["s"])
    else:
        h = hyp2f1_series(m.a + m.b - 1.0 - m.r, m.a - 1.0, cc, z)
        series = cc / F.lit(m.a - 1.0) * (F.lit(1.0) - F.pow(F.lit(1.0) - z, F.lit(m.a - 1.0)) * h)
    return F.when(z <= SERIES_LIMIT, series).otherwise(purchase_integral(m, tt / (F.lit(m.alpha) + T), x))


def expected_purchases(m: BGNBD, t, x, t_x, T) -> Column:
    """LV3 conditional expected number of purchases in (T, T + t]:
    ``purchase_factor`` · P(alive)."""
    tt = t if isinstance(t, Column) else F.lit(float(t))
    return F.when(tt <= 0, F.lit(0.0)).otherwise(purchase_factor(m, tt, x, T) * bg_inv_d(m, x, t_x, T))


def expected_avg_profit(g: GammaGamma, x, money) -> Column:
    """LV5 conditional expected average profit: w = px/(px+q−1);
    (1−w)·v·p/(q−1) + w·m (x = 0 gives the population mean), i.e. p·(v + x·m)/(px+q−1).
    Null where that mean is infinite (px + q ≤ 1, as for new customers of a model with
    q ≤ 1)."""
    x, mv = _c(x).cast("double"), _c(money).cast("double")
    den = F.lit(g.p) * x + F.lit(g.q) - F.lit(1.0)
    return F.when(den > 0, F.lit(g.p) * (F.lit(g.v) + x * mv) / den)


_FACTOR = {"W": 4.345, "M": 1.0, "D": 30.0, "H": 30.0 * 24}


def clv(m: BGNBD, g: GammaGamma, x, t_x, T, money, time: int = 6, discount: float = 0.1,
        freq: str = "D", floor: float | None = None) -> Column:
    """LV6 / LV7: Σ_{i=1..time} profit · ΔE_i / (1+d)^i, ΔE_i = E(i·f) − E((i−1)·f).
    With ``floor`` (LV7 / ``adjust_frequency_prediction``) a period with ΔE below
    the floor (or NaN) counts 0."""
    f = _FACTOR[freq]
    profit = expected_avg_profit(g, x, money)
    ends = F.transform(F.array(*[F.lit(float(i * f)) for i in range(0, time + 1)]), lambda t: expected_purchases(m, t, x, t_x, T))

    def summed(es):
        total = F.lit(0.0)
        for i in range(1, time + 1):
            d = es[i] - es[i - 1]
            if floor is not None:
                d = F.when(F.isnan(d) | d.isNull() | (d < F.lit(floor)), F.lit(0.0)).otherwise(d)
            total = total + profit * d / F.lit((1.0 + discount) ** i)
        return total
    return let(summed, es=ends)


def rule_based_clv(margin, retention: float, discount: float) -> Column:
    """LV9: constant-margin retention CLV m·r/(1+d−r)."""
    return _c(margin).cast("double") * F.lit(retention / (1.0 + discount - retention))


def score(pre_post: DataFrame, m: BGNBD, g: GammaGamma, t: float, time: int = 6, discount: float = 0.1,
          freq: str = "D", floor: float | None = None) -> DataFrame:
    """Scored table: predicted purchases over t, P(alive), expected profit
    (``avenue``), CLV (and ``clv_adjusted`` with ``floor``), ``alive_status``
    (P(alive) ≥ 0.5).  Each period's expectation is computed once (a column)
    and shared by both CLV variants."""
    x, tx, T, mv = "frequency_cal", "recency_cal", "T_cal", "monetary_value"
    f = _FACTOR[freq]
    horizons = {"predicted_purchases": float(t), **{f"__e{i}": i * f for i in range(1, time + 1)}}
    # the series depends on (x, T) only: evaluate it once per distinct pair (at most
    # max frequency × window days rows, however many customers) and join it back
    pairs = pre_post.select(F.col(x).alias("__x"), F.col(T).alias("__T")).distinct()
    factors = F.transform(F.array(*[F.lit(h) for h in horizons.values()]), lambda h: purchase_factor(m, h, "__x", "__T"))
    pairs = pairs.select("__x", "__T", factors.alias("__f")).select("__x", "__T", *[F.col("__f")[i].alias("__f" + k) for i, k in enumerate(horizons)])
    out = pre_post.join(pairs, (F.col(x) == F.col("__x")) & (F.col(T) == F.col("__T")))
    inv_d = bg_inv_d(m, x, tx, T)
    out = out.select(*pre_post.columns, *[(F.col("__f" + k) * inv_d).alias(k) for k in horizons])
    out = (out.withColumn("palive", probability_alive(m, x, tx, T))
              .withColumn("avenue", expected_avg_profit(g, x, mv)))
    out = out.select(*pre_post.columns, "predicted_purchases", "palive", "avenue",
                     *[f"__e{i}" for i in range(1, time + 1)])
    total, adj = F.lit(0.0), F.lit(0.0)
    for i in range(1, time + 1):
        d = F.col(f"__e{i}") - (F.col(f"__e{i - 1}") if i > 1 else F.lit(0.0))
        total = total + F.col("avenue") * d / F.lit((1.0 + discount) ** i)
        if floor is not None:
            dd = F.when(F.isnan(d) | d.isNull() | (d < F.lit(floor)), F.lit(0.0)).otherwise(d)
            adj = adj + F.col("avenue") * dd / F.lit((1.0 + discount) ** i)
    out = out.withColumn("clv", total)
    if floor is not None:
        out = out.withColumn("clv_adjusted", adj)
    return (out.withColumn("alive_status", F.when(F.col("palive") >= 0.5, 1).otherwise(0))
               .drop(*[f"__e{i}" for i in range(1, time + 1)]))


def frequency_recency_grid(m: BGNBD, max_freq: int, T, steps: int = 20, t: float = 1.0) -> DataFrame:
    """LV10: frequency 0..max_freq × recency = T·j/steps, j = 0..steps, scored by
    expected purchases over ``t`` and P(alive).  ``T`` is a one-row DataFrame
    with column ``T`` (e.g. the largest customer age)."""
    g = T.select(F.col("T").cast("double").alias("T"),
                 F.explode(F.sequence(F.lit(0), F.lit(max_freq))).alias("frequency"))
    g = g.select("T", "frequency", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("j"))
    g = g.withColumn("recency", F.col("T") * F.col("j") / F.lit(float(steps)))
    return g.select("frequency", "recency",
                    expected_purchases(m, t, "frequency", "recency", "T").alias("expected_purchases"),
                    probability_alive(m, "frequency", "recency", "T").alias("p_alive"))


def repeat_histogram(summary: DataFrame, cap: int = 20, col: str = "frequency_cal") -> DataFrame:
    """LV12: customers per number of repeat purchases, capped."""
    return summary.groupBy(F.least(F.col(col), F.lit(cap)).alias("repeat_purchases")).agg(
        F.count(F.lit(1)).alias("customers"))


# ------------------------------------------------------------------ evaluation

def clip_prediction(col, threshold: float | None = None) -> Column:
    """``pred``: below 0.5 → 0; above ``threshold`` → threshold (when given)."""
    c = _c(col)
    out = F.when(c < 0.5, F.lit(0.0))
    if threshold is not None:
        out = out.when(c > F.lit(float(threshold)), F.lit(float(threshold)))
    return out.otherwise(c)


def frequency_eval(scored: DataFrame, interval: float, threshold: float = 40, adjusted: bool = False) -> DataFrame:
    """EV1 ``perf_trax_freq_by_interval``: MAE / MSE of the clipped prediction vs
    hold-out purchases, share within ``interval``, alive agreement at 0.3, and the
    same for the calibration-frequency baseline."""
    pred = clip_prediction("predicted_purchases", threshold if adjusted else None)
    fh = F.col("frequency_holdout").cast("double")
    fc = F.col("frequency_cal").cast("double")
    alive = F.when(((F.col("palive") < 0.3) & (fh == 0)) | ((F.col("palive") >= 0.3) & (fh > 0)), 1.0).otherwise(0.0)
    return scored.agg(F.avg(F.abs(fh - pred)).alias("mae"), F.avg(F.pow(fh - pred, 2)).alias("mse"),
                      F.avg(F.when(F.abs(fh - pred) < interval, 1.0).otherwise(0.0)).alias("pred_in"),
                      F.avg(alive).alias("alive_acc"), F.avg(F.abs(fh - fc)).alias("base_mae"),
                      F.avg(F.when(F.abs(fh - fc) < interval, 1.0).otherwise(0.0)).alias("base_in"),
                      F.count(F.lit(1)).alias("n"))


def frequency_eval_capped(scored: DataFrame, cap: float = 25) -> DataFrame:
    """EV2 ``perf_trax_freq``: MAE and MSE of the prediction clipped to [0.5 → 0, cap]."""
    pred = clip_prediction("predicted_purchases", cap)
    fh = F.col("frequency_holdout").cast("double")
    return scored.agg(F.avg(F.abs(fh - pred)).alias("mae"), F.avg(F.pow(fh - pred, 2)).alias("mse"))


def money_eval(scored: DataFrame) -> DataFrame:
    """EV3: expected average profit vs hold-out money of repeat buyers with a
    hold-out purchase: MAE, RMSE, both means."""
    s = scored.where((F.col("frequency_cal") > 0) & (F.col("money_holdout") > 0))
    e = F.col("avenue") - F.col("money_holdout")
    return s.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                 F.avg("avenue").alias("mean_expected"), F.avg("money_holdout").alias("mean_actual"),
                 F.count(F.lit(1)).alias("n"))


def clv_variant_eval(scored: DataFrame, actual_col: str, threshold: float) -> DataFrame:
    """EV4 ``clv_perf``: rows with clv ≤ threshold; MAE against ``actual_col``
    (null → 0) of clv, clv·alive, avenue·pred·alive and avenue·pred (each ≥ 0)."""
    s = scored.where(F.col("clv") <= threshold)
    a = F.coalesce(F.col(actual_col).cast("double"), F.lit(0.0))
    pred = clip_prediction("predicted_purchases")
    alive = F.col("alive_status").cast("double")
    v1 = F.greatest(F.col("clv") * alive, F.lit(0.0))
    v2 = F.greatest(F.col("avenue") * pred * alive, F.lit(0.0))
    v3 = F.greatest(F.col("avenue") * pred, F.lit(0.0))
    return s.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("clv") - a)).alias("mae_clv"),
                 F.avg(F.abs(v1 - a)).alias("mae_clv_alive"), F.avg(F.abs(v2 - a)).alias("mae_ave_pred_alive"),
                 F.avg(F.abs(v3 - a)).alias("mae_ave_pred"))


def total_value_eval(scored: DataFrame) -> DataFrame:
    """EV6 ``perf``: actual total = money_holdout·(frequency_holdout+1); RMSE and
    MAE of clv·alive and of avenue·pred·alive against it."""
    tot = F.col("money_holdout") * (F.col("frequency_holdout") + 1)
    alive = F.col("alive_status").cast("double")
    e1 = F.col("clv") * alive - tot
    e2 = F.col("avenue") * clip_prediction("predicted_purchases") * alive - tot
    return scored.agg(F.sqrt(F.avg(e1 * e1)).alias("rmse_clv_alive"), F.avg(F.abs(e1)).alias("mae_clv_alive"),
                      F.sqrt(F.avg(e2 * e2)).alias("rmse_ave_pred_alive"), F.avg(F.abs(e2)).alias("mae_ave_pred_alive"))


def calibration_curve(scored: DataFrame, n: int) -> DataFrame:
    """AG20: mean hold-out and predicted purchases per calibration frequency,
    first ``n`` frequencies (the plot's data; ``n`` is the feature's cut)."""
    return (scored.groupBy("frequency_cal").agg(F.avg("frequency_holdout").alias("frequency_holdout"),
                                                F.avg("predicted_purchases").alias("predicted_purchases"))
                  .orderBy("frequency_cal").limit(n))


def decile_bins(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """EV7 ``get_bins``: qcut edges (interpolated quantiles 0, 1/n, …, 1) of the
    positive values, first edge 0, rounded to 3 digits: (bin, edge) rows."""
    pos = df.where(F.col(col) > 0)
    e = exact_quantiles(pos, col, [i / n for i in range(0, n + 1)], "edge")
    return e.select(F.round(F.col("q") * n).cast("int").alias("bin"),
                    F.when(F.col("q") == 0, F.lit(0.0)).otherwise(F.round("edge", 3)).alias("edge"))


def assign_bucket(df: DataFrame, col: str, bins: DataFrame, out: str) -> DataFrame:
    """EV8 ``bucket``: first bin index i with value ≤ edge_i, else the last index.
    The edge list is one broadcast row."""
    arr = bins.agg(F.array_sort(F.collect_list(F.struct("bin", "edge"))).alias("__e"))
    b = F.aggregate(F.col("__e"), F.lit(None).cast("int"), lambda acc, e: F.when(
        acc.isNull() & (F.col(col) <= e["edge"]), e["bin"]).otherwise(acc))
    return (df.join(F.broadcast(arr)).withColumn(out, F.coalesce(b, F.size("__e") - 1).cast("int")).drop("__e"))


def bucket_mean(df: DataFrame, bucket_col: str, cols: list[str], bins: DataFrame) -> DataFrame:
    """EV8 ``bucket_mean``: mean and count of each column per bucket of
    ``bucket_col`` (nulls → 0); every bin has a row."""
    d = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in dict.fromkeys([bucket_col, *cols])])
    d = assign_bucket(d, bucket_col, bins, "bucket")
    aggs = [F.count(F.lit(1)).alias("count")] + [F.avg(c).alias("mean_" + c) for c in cols]
    m = d.groupBy("bucket").agg(*aggs)
    return bins.select(F.col("bin").alias("bucket"), F.col("edge").alias("bins")).join(m, "bucket", "left")


def bucket_tpr_fpr(df: DataFrame, bucket_col: str, pred_col: str, bins: DataFrame) -> DataFrame:
    """EV8 "TPR"/"FPR": bucket 0 of the actual column (churned) is the positive
    class; TPR = share of churned with prediction exactly 0, FPR = share of the
    rest with prediction 0."""
    d = df.select(F.coalesce(F.col(bucket_col).cast("double"), F.lit(0.0)).alias(bucket_col),
                  F.coalesce(F.col(pred_col).cast("double"), F.lit(0.0)).alias("__p"))
    d = assign_bucket(d, bucket_col, bins, "bucket")
    z = (F.col("__p") == 0).cast("double")
    return d.agg(F.try_divide(F.sum(F.when(F.col("bucket") == 0, z)), F.count(F.when(F.col("bucket") == 0, 1)))
                 .alias("tpr"),
                 F.try_divide(F.sum(F.when(F.col("bucket") != 0, z)), F.count(F.when(F.col("bucket") != 0, 1)))
                 .alias("fpr"))


def bucket_mape(m1: DataFrame, m2: DataFrame, c1: str, c2: str) -> DataFrame:
    """EV9 ``mape``: per bucket (g1, g2, |g1−g2|/g2, or g1−g2 when g2 = 0)."""
    j = m1.select("bucket", F.col(c1).alias("g1")).join(m2.select("bucket", F.col(c2).alias("g2")), "bucket")
    return j.withColumn("mape", F.when(F.col("g2") != 0, F.abs(F.col("g1") - F.col("g2")) / F.col("g2"))
                        .otherwise(F.col("g1") - F.col("g2")))


def value_concentration(df: DataFrame, col: str, id_col: str, q: float = 0.99) -> DataFrame:
    """EV10 ``plot_percentile_cltv``: values below their q-quantile, sorted
    descending (ties by id); cumulative value share, cumulative share of the row
    index sum (``index_share``, as the reference plots) and of rows (``row_share``)."""
    from growthlab.functions.ordered import global_cumsum, quantile_value
    d = df.select(id_col, F.coalesce(F.col(col).cast("double"), F.lit(0.0)).alias("value"))
    d = d.join(F.broadcast(quantile_value(d, "value", q)), F.col("value") < F.col("qv"), "left_semi")
    d = materialize(d.withColumn("one", F.lit(1).cast("long")))
    c = global_cumsum(d, [F.desc("value"), F.asc(id_col)], ["value", "one"])
    tot = d.agg(F.sum("value").alias("__v"), F.count(F.lit(1)).alias("__n"))
    nid = F.col("cum_one") - 1
    return (c.join(F.broadcast(tot))
             .select(id_col, nid.alias("nid"), "value", (F.col("cum_value") / F.col("__v")).alias("value_share"),
                     ((nid * (nid + 1) / 2.0) / (F.col("__n") * (F.col("__n") - 1) / 2.0)).alias("index_share"),
                     (F.col("cum_one") / F.col("__n")).alias("row_share")))


def percentile_curve(df: DataFrame, col: str, id_col: str, q: float = 0.99) -> DataFrame:
    """EV11 ``plot_percentile_cltv_1``: x = row percentile (descending order),
    y = dense percentile rank of the value, descending."""
    from growthlab.functions.ordered import quantile_value, row_positions
    d = df.select(id_col, F.coalesce(F.col(col).cast("double"), F.lit(0.0)).alias("value"))
    d = materialize(d.join(F.broadcast(quantile_value(d, "value", q)), F.col("value") < F.col("qv"), "left_semi"))
    pos = row_positions(d, [F.desc("value"), F.asc(id_col)], "pos")
    vc = value_counts_cum(d, "value", ascending=False)
    nd = vc.agg(F.max("dense_rank").alias("__nd"), F.sum("cnt").alias("__n"))
    dr = vc.join(F.broadcast(nd)).select("value", (F.col("dense_rank") / F.col("__nd")).alias("y"), "__n")
    return pos.join(dr, "value").select(id_col, (F.col("pos") - 1).alias("nid"), "value",
                                        (F.col("pos") / F.col("__n")).alias("x"), "y")


def gini(df: DataFrame, col: str) -> DataFrame:
    """EV12 ``arary_gini``: values shifted to ≥ 0, + 1e-7, sorted ascending;
    Σ(2i − n − 1)·x / (n·Σx).  Ties are aggregated (a value held by c rows at
    ranks s+1..s+c contributes x·(2(c·s + c(c+1)/2) − c(n+1)))."""
    d = df.select(F.coalesce(F.col(col).cast("double"), F.lit(0.0)).alias("x"))
    mn = d.agg(F.least(F.min("x"), F.lit(0.0)).alias("__m"))
    d = d.join(F.broadcast(mn)).select((F.col("x") - F.col("__m") + F.lit(1e-7)).alias("x"))
    vc = value_counts_cum(d, "x")
    s = F.col("cum_cnt") - F.col("cnt")
    c = F.col("cnt").cast("double")
    tot = vc.agg(F.sum("cnt").alias("__n"))
    return (vc.join(F.broadcast(tot)).agg(
        (F.sum(F.col("x") * (2.0 * (c * s + c * (c + 1) / 2.0) - c * (F.col("__n") + 1)))
         / (F.first("__n") * F.sum(F.col("x") * c))).alias("gini")))


# ------------------------------------------------------------------ fitting

def bgnbd_loglik_terms(m: BGNBD) -> Column:
    """Per-row BG/NBD log-likelihood on columns x, t_x, T."""
    x, tx, T = F.col("x").cast("double"), F.col("t_x").cast("double"), F.col("T").cast("double")
    r, al, a, b = (v if isinstance(v, Column) else F.lit(v) for v in (m.r, m.alpha, m.a, m.b))
    a1 = lgamma(r + x) - lgamma(r) + r * F.log(al)
    a2 = lgamma(a + b) + lgamma(b + x) - lgamma(b) - lgamma(a + b + x)
    a3 = -(r + x) * F.log(al + T)
    a4 = F.when(x > 0, F.log(a) - F.log(b + x - 1.0) - (r + x) * F.log(al + tx)).otherwise(F.lit(None))
    # log(exp(a3) + exp(a4)) without overflow
    mx = F.greatest(a3, F.coalesce(a4, a3))
    lse = mx + F.log(F.exp(a3 - mx) + F.when(a4.isNotNull(), F.exp(a4 - mx)).otherwise(0.0))
    return a1 + a2 + lse


#: Log-parameters are tried within this range.
LOG_LIMIT = 30.0
#: Step lengths along a search direction that one job evaluates, and the longest step.
STEPS = (1.0, 0.3, 0.05)
LONGEST_STEP = 2.0


def _minimise(evaluate, x0, tol: float, iters: int):
    """Quasi-Newton (BFGS) minimisation.  ``evaluate`` takes a list of points and returns a
    (value, gradient) for each from one Spark aggregate; every iteration is one such job over
    ``STEPS``, more only where none of them descends.  It has converged when no entry of the
    gradient exceeds ``tol``.  Returns the point, its value and a report."""
    import numpy as np

    x = np.array(x0, dtype=float)
    (fx, g), = evaluate([x])
    n, inverse, used = len(x), None, 0
    while used < iters and np.abs(g).max() >= tol:
        used += 1
        d = -g / max(1.0, np.abs(g).max()) if inverse is None else -inverse.dot(g)
        if g.dot(d) >= 0:  # no descent direction: start again from the steepest one
            inverse, d = None, -g / max(1.0, np.abs(g).max())
        d = d * min(1.0, LONGEST_STEP / np.abs(d).max())
        best = None
        for shrink in (1.0, 0.01, 1e-4):
            lengths = [shrink * a for a in STEPS]
            found = evaluate([x + a * d for a in lengths])
            fits = [(f, i) for i, (a, (f, _)) in enumerate(zip(lengths, found)) if f <= fx + 1e-4 * a * g.dot(d) + 1e-13 * abs(fx)]
            if fits:
                fnew, i = min(fits)
                best = x + lengths[i] * d, fnew, found[i][1]
                break
        if best is None:
            if inverse is None:
                break
            inverse = None
            continue
        s_, y_ = best[0] - x, best[2] - g
        sy = s_.dot(y_)
        if sy > 1e-14:
            inverse = np.eye(n) * sy / y_.dot(y_) if inverse is None else inverse
            left = np.eye(n) - np.outer(s_, y_) / sy
            inverse = left.dot(inverse).dot(left.T) + np.outer(s_, s_) / sy
        x, fx, g = best
    ok = np.abs(g).max() < tol and not np.any(np.abs(x) >= LOG_LIMIT)
    return x.tolist(), fx, {"converged": bool(ok), "iterations": used, "gradient": float(np.abs(g).max())}


def _checked(report: dict, into: dict | None, what: str) -> None:
    """Hands the optimiser's report to the caller; without a place for it, a fit that did
    not converge is an error."""
    if into is not None:
        into.update(report)
    elif not report["converged"]:
        raise RuntimeError(f"the {what} fit did not converge: {report}")


def _evaluator(likelihood, names: list[str], lows: list[float], penalizer: float):
    """``evaluate`` for ``_minimise``: the mean negative log-likelihood (+ ridge penalty on the
    fitted parameters, each exp(log-parameter)) and its gradient by the log-parameters.
    ``likelihood`` takes rows (pid, a value a parameter, each its ``low`` + exp) and returns
    {pid: (number of customers, log-likelihood, [derivative by each parameter])}."""
    import numpy as np

    def evaluate(points):
        points = [np.clip(p, -LOG_LIMIT, LOG_LIMIT) for p in points]
        got = likelihood([(i, *[float(low + math.exp(v)) for low, v in zip(lows, p)]) for i, p in enumerate(points)])
        out = []
        for i, p in enumerate(points):
            w, ll, grads = got.get(i, (1, math.nan, [math.nan] * len(p)))
            e = np.exp(p)
            if not all(map(math.isfinite, [ll, *grads])):
                out.append((1e100, np.zeros(len(p))))
            else:
                out.append((-ll / w + penalizer * float((e * e).sum()), -np.array(grads) / w * e + 2 * penalizer * e * e))
        return out
    return evaluate


def bgnbd_likelihood(comp: DataFrame):
    """``likelihood`` of BG/NBD over rows (x, t_x, T, w) with x an integer number of repeat days.

    What depends on a customer by x alone, with its gamma functions, is summed over the number
    of customers of each x: one small table, at most the days of the window, collected once.
    A step sums the rest, a mixture of staying and dropping out, and its derivatives in one
    aggregate over the rows."""
    by_x = [(float(r["x"]), r["w"]) for r in comp.groupBy("x").agg(F.sum("w").alias("w")).collect()]
    customers = sum(w for _, w in by_x)
    mixture = """SELECT /*+ BROADCAST(p) */ pid, SUM(w * (stay + LN(1 + odds))) AS ll,
          SUM(w * (-LN(alpha + T) + gone * (LN(alpha + T) - LN(alpha + t_x)))) AS d_r,
          SUM(-w * (r + x) * ((1 - gone) / (alpha + T) + gone / (alpha + t_x))) AS d_alpha,
          SUM(w * gone) AS gone, SUM(CASE WHEN x > 0 THEN w * gone / (b + x - 1) ELSE 0 END) AS per_b
        FROM (SELECT *, -(r + x) * LN(alpha + T) AS stay, odds / (1 + odds) AS gone
              FROM (SELECT /*+ BROADCAST(p) */ *, CASE WHEN x > 0 THEN a / (b + x - 1) * EXP((r + x) * (LN(alpha + T) - LN(alpha + t_x))) ELSE 0D END AS odds
                    FROM {comp} CROSS JOIN {p} AS p)) GROUP BY pid"""

    def likelihood(points):
        table = comp.sparkSession.createDataFrame(points, "pid int, r double, alpha double, a double, b double")
        out = {}
        for s in comp.sparkSession.sql(mixture, comp=comp, p=table).collect():
            _, r, alpha, a, b = points[s["pid"]]
            ll, d_r, d_a, d_b = s["ll"], s["d_r"], s["gone"] / a, -s["per_b"]
            for x, w in by_x:
                ll += w * (math.lgamma(r + x) - math.lgamma(r) + r * math.log(alpha)
                           + math.lgamma(a + b) + math.lgamma(b + x) - math.lgamma(b) - math.lgamma(a + b + x))
                both = digamma(a + b) - digamma(a + b + x)
                d_r += w * (digamma(r + x) - digamma(r) + math.log(alpha))
                d_a += w * both
                d_b += w * (both + digamma(b + x) - digamma(b))
            out[s["pid"]] = customers, ll, [d_r, s["d_alpha"] + customers * r / alpha, d_a, d_b]
        return out
    return likelihood


def fit_bgnbd(summary: DataFrame, x="frequency_cal", t_x="recency_cal", T="T_cal", penalizer: float = 0.0,
              iters: int = 200, tol: float = 1e-6, report: dict | None = None) -> BGNBD:
    """LV1: maximum likelihood (optionally ridge-penalised on the parameters) of
    BG/NBD, until no entry of the gradient by the log-parameters exceeds ``tol``.  ``report``
    receives converged, iterations and gradient; without it a fit that does not converge
    raises.  Customers are compressed to distinct (x, t_x, T) with counts and checkpointed;
    every optimiser step is one aggregate over them.  Times are fitted in tenths of the
    longest age, so that the penalty does not depend on their unit; alpha comes back in days."""
    comp = materialize(summary.groupBy(F.col(x).cast("double").alias("x"), F.col(t_x).alias("t_x"), F.col(T).alias("T"))
                       .agg(F.count(F.lit(1)).alias("w")))
    age, oldest = comp.agg(F.sum(F.col("T") * F.col("w")) / F.sum("w"), F.max("T")).first()
    unit = float(oldest or 1.0) / 10.0 or 1.0
    scaled = comp.select("x", (F.col("t_x") / F.lit(unit)).alias("t_x"), (F.col("T") / F.lit(unit)).alias("T"), "w")
    names = ["r", "alpha", "a", "b"]
    start = [0.0, math.log(max(float(age or 1.0) / unit, 1e-3)), 0.0, 0.0]
    best, _, found = _minimise(_evaluator(bgnbd_likelihood(scaled), names, [0.0] * 4, penalizer), start, tol, iters)
    _checked(found, report, "BG/NBD")
    r, alpha, a, b = (math.exp(v) for v in best)
    return BGNBD(r, alpha * unit, a, b)


def gg_loglik_terms(g: GammaGamma) -> Column:
    x, mv = F.col("x").cast("double"), F.col("m").cast("double")
    p, q, v = (t if isinstance(t, Column) else F.lit(t) for t in (g.p, g.q, g.v))
    return (lgamma(p * x + q) - lgamma(p * x) - lgamma(q) + q * F.log(v) + (p * x - 1.0) * F.log(mv)
            + p * x * F.log(x) - (p * x + q) * F.log(v + x * mv))


def gg_likelihood(rows: DataFrame):
    """``likelihood`` of Gamma-Gamma over rows (x, m).  All but one term depends on a customer
    by x and Σ ln m alone.  So a step sums ln(v + x·m) and 1/(v + x·m) over the customers of
    each x, beside their number and Σ ln m; the few sums of each x (at most the days of the
    window) meet the gamma functions on the driver."""
    sums = """SELECT /*+ BROADCAST(p) */ pid, x, COUNT(*) AS w, SUM(LN(m)) AS lm, SUM(LN(v + x * m)) AS li, SUM(1 / (v + x * m)) AS ri
              FROM {rows} CROSS JOIN {p} AS p GROUP BY pid, x"""

    def likelihood(points):
        table = rows.sparkSession.createDataFrame(points, "pid int, p double, q double, v double")
        out = {}
        for s in rows.sparkSession.sql(sums, rows=rows, p=table).collect():
            _, p, q, v = points[s["pid"]]
            x, w, lm, li = s["x"], s["w"], s["lm"], s["li"]
            n, ll, (d_p, d_q, d_v) = out.get(s["pid"], (0, 0.0, (0.0, 0.0, 0.0)))
            ll += (w * (math.lgamma(p * x + q) - math.lgamma(p * x) - math.lgamma(q) + q * math.log(v) + p * x * math.log(x))
                   + (p * x - 1) * lm - (p * x + q) * li)
            psi = digamma(p * x + q)
            d_p += x * (w * (psi - digamma(p * x) + math.log(x)) + lm - li)
            d_q += w * (psi - digamma(q) + math.log(v)) - li
            d_v += w * q / v - (p * x + q) * s["ri"]
            out[s["pid"]] = n + w, ll, (d_p, d_q, d_v)
        return out
    return likelihood


def fit_gamma_gamma(summary: DataFrame, x="frequency_cal", money="monetary_value", penalizer: float = 0.0,
                    iters: int = 200, finite_mean: bool = False, tol: float = 1e-6, report: dict | None = None) -> GammaGamma:
    """LV2: Gamma-Gamma fit on customers with x > 0 and money > 0.  ``finite_mean`` keeps
    q above 1, without which the expected profit of a new customer is infinite.  Money is
    fitted in units of its mean, where the search starts, so that the penalty does not depend
    on the currency; v comes back in money."""
    low = 1.0 if finite_mean else 0.0
    paid = materialize(summary.where((F.col(x) > 0) & (F.col(money) > 0)).select(F.col(x).cast("double").alias("x"), F.col(money).cast("double").alias("m")))
    mean = float(paid.agg(F.avg("m")).first()[0] or 1.0)
    rows = paid.select("x", (F.col("m") / F.lit(mean)).alias("m"))
    start = [math.log(2.0), math.log(3.0 - low), 0.0]  # p·v/(q−1) is the mean
    best, _, found = _minimise(_evaluator(gg_likelihood(rows), ["p", "q", "v"], [0.0, low, 0.0], penalizer), start, tol, iters)
    _checked(found, report, "Gamma-Gamma")
    p, q, v = (math.exp(t) for t in best)
    return GammaGamma(p, low + q, v * mean)


def log_likelihood(summary: DataFrame, terms: Column, x="frequency_cal", t_x="recency_cal", T="T_cal",
                   money="monetary_value") -> DataFrame:
    """Sum of the per-customer log-likelihood ``terms`` (``bgnbd_loglik_terms`` or
    ``gg_loglik_terms`` of a model) and the number of customers."""
    rows = summary.select(F.col(x).alias("x"), F.col(t_x).alias("t_x"), F.col(T).alias("T"), F.col(money).alias("m"))
    return rows.agg(F.sum(terms).alias("log_likelihood"), F.count(F.lit(1)).alias("n"))


def params_frame(spark, m: BGNBD, g: GammaGamma | None = None) -> DataFrame:
    """LV13: fitted parameters as a one-row DataFrame."""
    row = {"r": m.r, "alpha": m.alpha, "a": m.a, "b": m.b}
    if g is not None:
        row.update({"p": g.p, "q": g.q, "v": g.v})
    return spark.createDataFrame([row], ", ".join(f"{k} double" for k in row))


def save_params(spark, path: str, m: BGNBD, g: GammaGamma | None = None) -> None:
    """LV13: writes the parameters as Parquet."""
    params_frame(spark, m, g).write.mode("overwrite").parquet(path)


def load_params(spark, path: str) -> tuple[BGNBD, GammaGamma | None]:
    """LV13: the models that ``save_params`` wrote."""
    r = spark.read.parquet(path).first().asDict()
    return BGNBD(*(r[k] for k in ("r", "alpha", "a", "b"))), GammaGamma(r["p"], r["q"], r["v"]) if "p" in r else None


def alive_history(txn: DataFrame, customers: DataFrame, first_day, last_day, m: BGNBD) -> DataFrame:
    """LV11: P(alive) of the given customers on every day of [first_day, last_day],
    each day scored on the summary as of that day (purchase days up to it).

    The summary changes on purchase days only: each of them, with its number and the first
    one, holds until the day before the next, and is exploded over its own days of the grid.
    So a customer gives one row a day, however many purchase days there are."""
    first, last = F.lit(first_day).cast("date"), F.lit(last_day).cast("date")
    days = (txn.join(customers.select("customer_id").distinct(), "customer_id", "left_semi")
               .where(F.col("dt") <= last).select("customer_id", "dt").distinct())
    w = Window.partitionBy("customer_id").orderBy("dt")
    held = days.select("customer_id", "dt", F.min("dt").over(w).alias("since"), (F.row_number().over(w) - 1).cast("long").alias("frequency"),
                       F.coalesce(F.date_sub(F.lead("dt").over(w), 1), last).alias("until"))
    held = held.where(F.col("until") >= first)
    s = held.select("customer_id", F.explode(F.sequence(F.greatest(F.col("dt"), first), F.col("until"))).alias("day"), "frequency",
                    F.datediff("dt", "since").alias("recency"), "since")
    s = s.withColumn("T", F.datediff("day", "since"))
    return s.select("customer_id", "day", "frequency", "recency", "T",
                    probability_alive(m, "frequency", "recency", "T").alias("p_alive"))
