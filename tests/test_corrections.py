"""Cases that the driver's tables do not hold, each computed by hand or by a plain sum."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from growthlab.functions.ordered import discrete_quantiles, exact_quantiles
from growthlab.operators import clv as L
from growthlab.operators import ctr as C
from growthlab.operators import ranking as R
from growthlab.operators import regress as RG
from growthlab.operators import sequences as SQ
from growthlab.operators.rfm import trim_rfm
from growthlab.session import ensure_checkpoint_dir
from growthlab.sources import fixtures as X


def test_checkpoint_folder_is_set_once(spark):
    first = ensure_checkpoint_dir(spark)
    assert {ensure_checkpoint_dir(spark) for _ in range(300)} == {first}


@pytest.mark.parametrize("n", [10, 200_000])
def test_quantiles_use_one_method_at_any_size(spark, n):
    df = spark.range(n).select((F.col("id") * 7919 % n).cast("double").alias("x"))
    got = {r["q"]: r["quantile"] for r in exact_quantiles(df, "x", [0.25, 0.99]).collect()}
    assert got == {q: pytest.approx((n - 1) * q) for q in (0.25, 0.99)}
    disc = {r["q"]: r["quantile"] for r in discrete_quantiles(df, "x", [0.25, 0.99]).collect()}
    assert disc == {q: math.ceil(n * q) - 1 for q in (0.25, 0.99)}


def test_rfm_trim_takes_an_element(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 101)], "frequency long, total_value double")
    # the 99th of 100 values is 99: strictly below stay 98, of which the 98th (ceil(97.02)) goes
    assert trim_rfm(df).count() == 97


def expected(m, t, x, tx, T):
    """Expected purchases with 400,000 terms of the series, far more than are taken."""
    a, b, r, al = m.a, m.b, m.r, m.alpha
    z = t / (al + T + t)
    n = np.arange(1, 400_000)
    terms = np.exp(np.cumsum(np.log((a + b - 1 - r + n - 1) * abs(a - 1 + n - 1) / ((a + b + x - 1 + n - 1) * n) * z)))
    h = 1 + math.copysign(1, a - 1) * terms.sum()
    inv = 1 / (1 + (a / (b + x - 1) * ((al + T) / (al + tx)) ** (r + x) if x > 0 else 0))
    return (a + b + x - 1) / (a - 1) * (1 - (1 - z) ** (a - 1) * h) * inv


def test_series_has_no_cap(spark):
    m = L.BGNBD(0.243, 0.5, 0.793, 2.426)
    v = spark.range(1).select(L.expected_purchases(m, 578.0, F.lit(0), F.lit(0), F.lit(0))).first()[0]
    assert v == pytest.approx(expected(m, 578.0, 0, 0, 0), rel=1e-7)
    assert v == pytest.approx(12.0703, abs=1e-3)


def test_limit_at_a_equal_one(spark):
    at = [(x, tx, T) for x, tx, T in ((0, 0.0, 40.0), (3, 20.0, 40.0))]
    df = spark.createDataFrame(at, "x long, tx double, T double")
    value = lambda a: [r[0] for r in df.select(L.expected_purchases(L.BGNBD(0.3, 4.0, a, 2.4), 39.0, "x", "tx", "T")).collect()]
    below, limit, above = value(1 - 1e-5), value(1.0), value(1 + 1e-5)
    for lo, v, hi in zip(below, limit, above):
        assert v == pytest.approx((lo + hi) / 2, rel=1e-6)


def test_profit_without_a_finite_mean_is_null(spark):
    df = spark.createDataFrame([(0, 0.0), (4, 30.0)], "x long, m double")
    got = [r[0] for r in df.orderBy("x").select(L.expected_avg_profit(L.GammaGamma(2.0, 0.5, 10.0), "x", "m")).collect()]
    assert got[0] is None and got[1] == pytest.approx(2.0 * (10 + 4 * 30) / (8 - 0.5))
    edge = df.orderBy("x").select(L.expected_avg_profit(L.GammaGamma(2.0, 1.0, 10.0), "x", "m")).collect()
    assert edge[0][0] is None and edge[1][0] == pytest.approx(10 / 4 + 30)


def test_bgnbd_parameters_are_recovered(spark):
    rng, true = np.random.default_rng(3), L.BGNBD(0.8, 10.0, 0.9, 2.5)
    rows = []
    for i in range(6000):
        lam, p, T = rng.gamma(true.r, 1 / true.alpha), rng.beta(true.a, true.b), float(rng.integers(60, 200))
        x, last, at = 0, 0.0, 0.0
        while True:
            at += rng.exponential(1 / lam)
            if at > T:
                break
            x, last = x + 1, at
            if rng.random() < p:
                break
        rows.append((x, last, T))
    df = spark.createDataFrame(rows, "frequency_cal long, recency_cal double, T_cal double")
    report = {}
    m = L.fit_bgnbd(df, report=report)
    assert report["converged"] and report["gradient"] < 1e-2
    assert m.r == pytest.approx(true.r, rel=0.15) and m.alpha == pytest.approx(true.alpha, rel=0.2)
    assert m.a / (m.a + m.b) == pytest.approx(true.a / (true.a + true.b), rel=0.15)


def test_gamma_gamma_parameters_are_recovered(spark, tmp_path):
    rng, true = np.random.default_rng(4), L.GammaGamma(6.0, 4.0, 15.0)
    rows = []
    for _ in range(4000):
        x = int(rng.integers(1, 8))
        rows.append((x, float(rng.gamma(true.p * x, 1 / (rng.gamma(true.q, 1 / true.v) * x)))))
    df = spark.createDataFrame(rows, "frequency_cal long, monetary_value double")
    report = {}
    g = L.fit_gamma_gamma(df, finite_mean=True, report=report)
    assert report["converged"] and g.q > 1
    assert g.p * g.v / (g.q - 1) == pytest.approx(true.p * true.v / (true.q - 1), rel=0.05)
    assert g.q == pytest.approx(true.q, rel=0.2)
    m = L.BGNBD(0.1, 2.0, 0.3, 0.4)
    L.save_params(spark, str(tmp_path / "both"), m, g)
    L.save_params(spark, str(tmp_path / "one"), m)
    assert L.load_params(spark, str(tmp_path / "both")) == (m, g) and L.load_params(spark, str(tmp_path / "one")) == (m, None)


def test_a_fit_that_does_not_converge_says_so(spark):
    df = spark.createDataFrame([(random.Random(i).choice([0, 1, 4]), 5.0 * (i % 4), 40.0) for i in range(60)],
                               "frequency_cal long, recency_cal double, T_cal double")
    with pytest.raises(RuntimeError, match="did not converge"):
        L.fit_bgnbd(df, iters=1)


def test_ab_names_with_two_ids_keep_their_rows(spark):
    day = dt.date(2024, 1, 1)
    rows = [("X", "1", day, "raw", 100, 1, 0, 0.0), ("X", "2", day, "raw", 10, 9, 0, 0.0), ("X", "1", day, "rt", 50, 5, 1, 2.0),
            ("Y", "3", day, "rt", 7, 0, 0, 0.0)]
    m = spark.createDataFrame(rows, "category_name string, cma_id string, dt date, experiment_group_name string, impressions_total long,"
                              " clicks_total long, category_sales_total long, category_gmv_total double")
    m = m.withColumn("ctr", F.col("clicks_total") / F.col("impressions_total"))
    out = C.ab_comparison(m, spark.createDataFrame([(day, "1")], "dt date, cma_id string")).collect()
    got = sorted((r.cma_id_raw or "", r.impressions_total_raw or 0, r.clicks_total_raw or 0, r.sale_category_id_raw or "",
                  r.impressions_total_rt or 0, r.category_name_rt) for r in out)
    assert got == [("", 0, 0, "", 7, "Y"), ("1", 100, 1, "1", 50, "X"), ("2", 10, 9, "", 50, "X")]


def test_duplicate_predictions_fail(spark):
    labels = spark.createDataFrame([(1, ["a", "b"], 2)], "customer_id long, labels array<string>, relevant_cat_cnt int")
    preds = lambda p: spark.createDataFrame([(1, p)], "customer_id long, pred array<string>")
    r = R.ranking_metrics_at_k(preds(["b", "c"]), labels, [2]).first()
    assert r.precision_at_k == pytest.approx(0.5) and r.mean_avg_precision == pytest.approx(0.5)
    with pytest.raises(Exception, match="more than once: a,a,b"):
        R.ranking_metrics_at_k(preds(["a", "a", "b"]), labels, [2]).collect()
    per_k = R.precision_recall_at_k(R.precision_recall_per_user_k(labels, preds(["a", "a"]), 2))
    assert per_k.first().dup_pred_category_at_k == 1
    with pytest.raises(ValueError, match="repeat an earlier one"):
        R.assert_prediction_quality(per_k)


def test_removed_customers_and_label_restriction(spark):
    sales = spark.createDataFrame([(1, "a"), (2, "z"), (3, "a"), (3, "z")], "customer_id long, cma_id string")
    cats = spark.createDataFrame([("a",)], "cma_id string")
    assert R.removed_customer_count(sales, cats).first()[0] == 1
    assert {r.customer_id: r.labels for r in R.label_sets(R.restrict_labels(sales, cats)).collect()} == {1: ["a"], 3: ["a"]}


def test_only_four_columns_are_scaled(spark):
    rows = [(i, float(f), float(2 * f), 40.0 + i, 5.0 + i * i) for i, f in enumerate([0, 1, 3, 8])]
    pp = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "id long, frequency_cal double, recency_cal double, T_cal double,"
                               " monetary_value double, frequency_holdout long, money_holdout double")
    f = RG.ml_features(pp).withColumn("is_train", F.lit(True))
    out = {r.id: r for r in RG.standardise(f, RG.SCALED).collect()}
    x = np.array([r[1] for r in rows])
    for i, r in out.items():
        assert r.frequency_cal == pytest.approx((x[i] - x.mean()) / x.std())
        assert r.f_sqrt == pytest.approx(math.sqrt(x[i] + 1)) and r.f_log == pytest.approx(math.log(x[i] + 1))


def test_ridge_solves_the_normal_equations(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 2))
    y = x @ [2.0, -1.0] + 3 + rng.normal(scale=0.1, size=60)
    df = spark.createDataFrame([(*map(float, a), float(b), True) for a, b in zip(x, y)], "p double, q double, label double, is_train boolean")
    c = x - x.mean(0)
    want = np.linalg.solve(c.T @ c + 0.5 * np.eye(2), c.T @ (y - y.mean()))
    got = {r.feature: r.coefficient for r in RG.ridge_coefficients(df, ["p", "q"], 0.5).collect()}
    assert [got["p"], got["q"]] == pytest.approx(want.tolist(), rel=1e-6)


def test_score_snapshots_fold_earlier_history(spark):
    days = [dt.date(2024, 1, d) for d in (1, 5, 9, 10)]
    be = [(1, "a", days[0]), (1, "b", days[1]), (1, "a", days[2]), (2, "c", days[3])]
    old = X.banner_events
    try:
        X.banner_events = lambda s, *_: spark.createDataFrame(be, "customer_id long, cma_id string, dt date")
        got = {(r.dt.day, r.customer_id): {s.category_id: s.probability for s in r.category_trend_scores}
               for r in X.scores_by_day(spark, "", dt.date(2024, 1, 8), dt.date(2024, 1, 10)).collect()}
    finally:
        X.banner_events = old
    assert got == {(8, 1): {"a": 0.5, "b": 0.5}, (9, 1): {"a": pytest.approx(2 / 3), "b": pytest.approx(1 / 3)},
                   (10, 1): {"a": pytest.approx(2 / 3), "b": pytest.approx(1 / 3)}, (10, 2): {"c": 1.0}}


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_sequences_of_a_customer_with_half_of_all_events(spark, partitions):
    rng = random.Random(6)
    rows = [(1 if i % 2 else rng.randint(2, 9), dt.date(2024, 1, 1) + dt.timedelta(days=i % 50), str(rng.randint(1, 12)), f"b{i}", 1, 0, 0)
            for i in range(600)]
    events = spark.createDataFrame(rows, "customer_id long, dt date, cma_id string, banner_id string, banner_clicks long, icon_clicks long, sales long")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        seq = sorted(map(tuple, SQ.category_sequence(events).collect()))
        pairs = sorted(map(tuple, SQ.category_bigrams(events).collect()))
        plan = SQ.category_bigrams(events)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for c in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], int(r[2]), r[3]))
        want += [(c, i + 1, r[2]) for i, r in enumerate(own)]
    assert seq == want
    assert pairs == [(a[0], a[1], a[2], b[2]) for a, b in zip(want, want[1:]) if a[0] == b[0]]
    assert "customer_id" not in "".join(x for x in plan.splitlines() if "Join" in x)
