"""Order statistics by counting, fits, the limit of the purchase series, stores."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from growthlab.functions import ordered as O
from growthlab.functions.special import digamma
from growthlab.operators import agreement as AG
from growthlab.operators import clv as L
from growthlab.operators import ranking as RK
from growthlab.operators import summaries as S
from growthlab.plans import q_sources as QS
from growthlab.plans import q_summaries as Q
from growthlab.plans import params as P
from growthlab.sources import fixtures as X
from growthlab.sources import io as IO

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


# ---------------------------------------------------------------- order statistics

@pytest.mark.parametrize("sketch", [100_000, 50])
def test_order_statistics_are_exact_with_a_coarse_sketch(spark, monkeypatch, sketch):
    """Also where the sketch errs by many rows, with ties, negative values and nulls."""
    monkeypatch.setattr(O, "SKETCH", sketch)
    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 100), float(rng.randint(0, 5)), -7.0]) for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 30, "x double")
    qs = [0.0, 0.001, 0.01, 0.3, 0.5, 0.5001, 0.99, 1.0]
    got = {r["q"]: r["quantile"] for r in O.exact_quantiles(df, "x", qs).collect()}
    assert all(abs(got[q] - np.quantile(values, q)) < 1e-9 for q in qs)
    disc = {r["q"]: r["quantile"] for r in O.discrete_quantiles(df, "x", qs).collect()}
    ordered = sorted(values)
    assert all(disc[q] == ordered[max(math.ceil(len(values) * q) - 1, 0)] for q in qs)


def test_quantiles_of_few_values(spark):
    for n in (1, 2, 3, 7, 10, 19):
        df = spark.range(n).select((F.col("id") * F.col("id")).cast("double").alias("x"))
        qs = [i / 12 for i in range(13)]
        got = {r["q"]: r["quantile"] for r in O.exact_quantiles(df, "x", qs).collect()}
        assert all(abs(got[q] - np.quantile([i * i for i in range(n)], q)) < 1e-9 for q in qs), n


@pytest.mark.parametrize("place", [-1, 0, 7, 4999, 9999, 10_000])
def test_value_at_a_position_from_the_data(spark, place):
    values = [i * 7919 % 10_007 // 3 for i in range(10_000)]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    got = O.value_at(df, "x", spark.createDataFrame([(place,)], "place long")).first()
    want = sorted(values)[place] if 0 <= place < len(values) else None
    assert (got["value"] if got else None) == want


def test_quantiles_of_nothing_and_nothing_runs_early(spark):
    empty = spark.createDataFrame([], "x double")
    assert O.exact_quantiles(empty, "x", [0.5]).collect() == []
    assert S.quantile_trim(empty, "x").collect() == []
    plan = plan_of(O.exact_quantiles(spark.range(10).select(F.col("id").alias("x")), "x", [0.5]))
    assert "ExistingRDD" not in plan and "rangepartitioning" not in plan  # no checkpoint and no sort of the column


def test_pre_post_table_reads_the_sales_once(spark):
    plan = plan_of(Q.pre_post(spark, SF))
    assert plan.count("Scan parquet") == 0  # the one read is behind the written aggregate
    sales = X.sales(spark, SF, P.CAL_START, P.HOLD_END, P.CATEGORY)
    both = S.two_window_summary(sales, (P.CAL_START, P.CAL_END), (P.HOLD_START, P.HOLD_END), P.CATEGORY)
    tree = both._jdf.queryExecution().executedPlan().toString()
    assert tree.count("FileScan parquet") <= 3


@pytest.mark.parametrize("top", [1, 5, 40, 1000])
def test_topn_jaccard_with_ties(spark, top):
    rng = random.Random(top)
    rows = [(i, rng.choice([None, 0.0, 1.0, 2.0, rng.random()]), rng.choice([None, 0.0, 1.0, rng.random()])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    first = lambda k: {r[0] for r in sorted(rows, key=lambda r: (-(r[k] or 0.0), r[0]))[:top]}
    a, b = first(1), first(2)
    found = AG.topn_jaccard(df, "id", "a", "b", top)
    assert abs(found.first()["jaccard"] - len(a & b) / len(a | b)) < 1e-12
    assert "TakeOrdered" not in plan_of(found)


def test_positions_of_rows_without_a_group(spark):
    rows = [(None, i) for i in range(40)] + [(c, i) for c in (1, 2) for i in range(30)]
    found = O.group_positions(spark.createDataFrame(rows, "g long, i long").repartition(7), "g", ["i"])
    assert all(r["pos"] == r["i"] + 1 for r in found.collect()) and found.count() == 100


def test_sketches_merge(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 11).alias("part"), F.col("id").cast("double").alias("v"))
    found = S.sketch_quantile_errors(df, "k", "part", "v", (0.01, 0.5, 0.999), 0.02).collect()
    assert len(found) == 9 and all(r["within"] for r in found) and {r["n"] for r in found} <= {6666, 6667}


# ---------------------------------------------------------------- expected purchases near z = 1

def _connected(A, B, C, y):
    """2F1(A, B; C; 1 - y) by the 1 - z connection formula, C - A - B no integer."""
    g = math.gamma

    def series(a, b, c):
        total, term = 0.0, 1.0
        for n in range(200):
            total += term
            term *= (a + n) * (b + n) / ((c + n) * (n + 1)) * y
        return total
    s = C - A - B
    return g(C) * g(s) / (g(C - A) * g(C - B)) * series(A, B, 1 - s) + y ** s * g(C) * g(-s) / (g(A) * g(B)) * series(C - A, C - B, 1 + s)


@pytest.mark.parametrize("m", [L.BGNBD(0.243, 30.9, 0.793, 2.426), L.BGNBD(1.7, 4.0, 1.35, 0.6), L.BGNBD(0.55, 12.0, 0.3, 1.9)])
def test_purchase_factor_near_one(spark, m):
    rows = [(x, y) for x in (0.0, 1.0, 4.0, 30.0) for y in (1e-9, 1e-6, 1e-3, 0.09)]
    # T = 0: z = t / (alpha + t) = 1 - y
    df = spark.createDataFrame([(x, y, m.alpha * (1 - y) / y) for x, y in rows], "x double, y double, t double")
    got = df.select("x", "y", L.purchase_factor(m, F.col("t"), "x", F.lit(0.0)).alias("f")).collect()
    for r in got:
        c = m.a + m.b - 1 + r["x"]
        want = c / (m.a - 1) * (1 - r["y"] ** (m.a - 1) * _connected(c - r["x"] - m.r, m.a - 1, c, r["y"]))
        assert abs(r["f"] - want) < 1e-9 * abs(want), (r, want)


def test_integral_meets_the_series(spark):
    for m in (L.BGNBD(0.243, 30.9, 0.793, 2.426), L.BGNBD(0.9, 20.0, 1.0, 1.5), L.BGNBD(2.0, 9.0, 3.2, 0.2)):
        df = spark.createDataFrame([(x, t) for x in (0.0, 2.0, 50.0) for t in (1.0, 30.0, 100.0)], "x double, t double")
        both = df.select(L.purchase_factor(m, F.col("t"), "x", F.lit(20.0)).alias("a"),
                         L.purchase_integral(m, F.col("t") / (m.alpha + 20.0), F.col("x")).alias("b")).collect()
        assert all(abs(r["a"] - r["b"]) < 1e-9 * abs(r["a"]) for r in both)


# ---------------------------------------------------------------- fits

def test_digamma():
    assert abs(digamma(1.0) + 0.5772156649015329) < 1e-12
    assert all(abs(digamma(x + 1) - digamma(x) - 1 / x) < 1e-11 * max(1, 1 / x) for x in (0.01, 0.5, 3.3, 80.0))


def _numeric(evaluate, at, h=1e-5):
    out = []
    for i in range(len(at)):
        up, down = np.array(at, float), np.array(at, float)
        up[i] += h
        down[i] -= h
        (a, _), (b, _) = evaluate([up, down])
        out.append((a - b) / (2 * h))
    return np.array(out)


def test_gradients_are_those_of_the_likelihoods(spark):
    rng = random.Random(2)
    rows = [(float(x := rng.choice([0, 0, 1, 2, 5])), float(rng.randint(1, 40)) if x else 0.0, float(rng.randint(41, 90)), rng.randint(1, 4)) for _ in range(60)]
    comp = spark.createDataFrame(rows, "x double, t_x double, T double, w long")
    evaluate = L._evaluator(L.bgnbd_likelihood(comp), ["r", "alpha", "a", "b"], [0.0] * 4, 0.01)
    at = [0.2, 1.5, -0.4, 0.7]
    (value, grad), = evaluate([np.array(at)])
    assert np.abs(grad - _numeric(evaluate, at)).max() < 1e-6
    m = L.BGNBD(*[math.exp(v) for v in at])  # the value is the one of the Column form
    ll = comp.agg(F.sum(L.bgnbd_loglik_terms(m) * F.col("w")) / F.sum("w")).first()[0]
    assert abs(value - (-ll + 0.01 * sum(math.exp(2 * v) for v in at))) < 1e-9

    paid = spark.createDataFrame([(float(rng.randint(1, 6)), rng.random() * 3 + 0.1) for _ in range(80)], "x double, m double")
    evaluate = L._evaluator(L.gg_likelihood(paid), ["p", "q", "v"], [0.0, 1.0, 0.0], 0.02)
    at = [0.5, 0.3, -0.2]
    (value, grad), = evaluate([np.array(at)])
    assert np.abs(grad - _numeric(evaluate, at)).max() < 1e-6
    ll = paid.agg(F.avg(L.gg_loglik_terms(L.GammaGamma(math.exp(0.5), 1 + math.exp(0.3), math.exp(-0.2))))).first()[0]
    assert abs(value - (-ll + 0.02 * sum(math.exp(2 * v) for v in at))) < 1e-9


# ---------------------------------------------------------------- ranking checks, snapshots, histories

def test_map_refuses_repeated_predictions(spark):
    preds = spark.createDataFrame([(1, ["a", "a", "b"])], "customer_id long, pred array<string>")
    labels = spark.createDataFrame([(1, ["a", "b"])], "customer_id long, labels array<string>")
    with pytest.raises(Exception, match="more than once"):
        RK.mean_average_precision(preds, labels).collect()


def test_repeated_predictions_are_counted(spark):
    preds = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["c"])], "customer_id long, pred array<string>")
    labels = spark.createDataFrame([(1, ["a", "b"], 2), (2, ["d"], 1)], "customer_id long, labels array<string>, relevant_cat_cnt int")
    per = RK.precision_recall_per_user_k(labels, preds, 3)
    assert {(r["customer_id"], r["k"], r["cnt_pred_lab_k"]) for r in per.collect()} == {(1, 1, 1), (1, 2, 1), (1, 3, 2), (2, 1, 0), (2, 2, 0), (2, 3, 0)}
    quality = RK.prediction_quality_check(RK.precision_recall_at_k(per)).first()
    assert quality["tlt_dup_pred_category"] == 3 and not quality["ok"]


def test_snapshots_are_those_of_each_day(spark):
    days = [dt.date(2024, 1, 20) + dt.timedelta(days=i) for i in range(4)]
    rows = lambda df: sorted((r["customer_id"], [(s["category_id"], round(s["probability"], 12)) for s in r["category_trend_scores"]]) for r in df.collect())
    snaps = X.scores_by_day(spark, SF, days[0], days[-1])
    for d in days:
        assert rows(snaps.where(F.col("dt") == F.lit(d))) == rows(X.scores(spark, SF, d))
    shuffled = lambda n: plan_of(X.scores_by_day(spark, SF, days[0], days[0] + dt.timedelta(days=n))).count("Exchange")
    assert shuffled(1) == shuffled(300)


def test_alive_history_equals_daily_summaries(spark):
    rng = random.Random(3)
    first = dt.date(2020, 1, 1)
    txn = [(c, first + dt.timedelta(days=rng.randint(0, 60))) for c in (1, 2, 3) for _ in range(12)] + [(4, first + dt.timedelta(days=50))]
    days = [first + dt.timedelta(days=i) for i in range(20, 56)]
    m = L.BGNBD(0.5, 10.0, 0.8, 2.0)
    got = {(r["customer_id"], r["day"]): (r["frequency"], r["recency"], r["T"]) for r in L.alive_history(
        spark.createDataFrame(txn, "customer_id long, dt date"), spark.createDataFrame([(c,) for c in (1, 2, 3, 4, 5)], "customer_id long"), days[0], days[-1], m).collect()}
    want = {}
    for c in (1, 2, 3, 4):
        for d in days:
            own = sorted({x for k, x in txn if k == c and x <= d})
            if own:
                want[c, d] = (len(own) - 1, (own[-1] - own[0]).days, (d - own[0]).days)
    assert got == want


# ---------------------------------------------------------------- stores

def test_store_scans_open_only_the_days_asked_for(spark):
    from growthlab.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    path = QS.banner_store(spark, SF)
    store = IO.read_parquet(spark, path)
    for df in (IO.day_range(store, P.ROLL_FIRST, P.ROLL_LAST), IO.days_in(store, [P.SCORE_DAY]), IO.latest_snapshot(store)):
        plan = plan_of(df)
        filters = [line for line in plan.splitlines() if "PartitionFilters" in line]
        assert filters and any("dt" in line for line in filters)
    newest = IO.latest_snapshot(store)
    assert newest.select("dt").distinct().count() == 1 and newest.first()["dt"] == store.agg(F.max("dt")).first()[0]


# ---------------------------------------------------------------- rank agreement

def _tau_b(x, y):
    sign = lambda v: (v > 0) - (v < 0)
    s = tx = ty = 0
    for i in range(len(x)):
        for j in range(i):
            a, b = sign(x[i] - x[j]), sign(y[i] - y[j])
            s, tx, ty = s + a * b, tx + (a == 0), ty + (b == 0)
    n0 = len(x) * (len(x) - 1) / 2
    den = math.sqrt((n0 - tx) * (n0 - ty))
    return s / den if den else None


def test_kendall_equals_the_count_of_pairs(spark):
    rng = random.Random(6)
    rows = [([rng.randint(0, k) for _ in range(n)], [rng.randint(0, k) for _ in range(n)]) for n in (1, 2, 3, 5, 8, 12, 33, 100) for k in (0, 1, 3, 50)]
    got = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(rows)], "i int, x array<long>, y array<long>").select(
        "i", AG.kendall_tau_b(F.col("x"), F.col("y")).alias("t")).collect()
    for r in got:
        want = _tau_b(*rows[r["i"]])
        assert (r["t"] is None) == (want is None) and (want is None or abs(r["t"] - want) < 1e-12), (rows[r["i"]], r, want)
    odd = spark.createDataFrame([([1, 2], [1]), ([1, None], [1, 2]), (None, [1, 2]), ([], [])], "x array<long>, y array<long>")
    assert [r[0] for r in odd.select(AG.kendall_tau_b(F.col("x"), F.col("y"))).collect()] == [None] * 4
