import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from growthlab.functions.arrays import rank_of, top_ids
from growthlab.functions.ordered import exact_quantiles, global_cumsum, discrete_quantiles
from growthlab.functions.special import lgamma
from growthlab.operators.agreement import kendall_tau_b

SCHEMA = "customer_id long, category_trend_scores array<struct<category_id:string, probability:double>>"


def test_top_ids_tie_rules(spark):
    df = spark.createDataFrame([(1, [("a", .5), ("c", .5), ("b", .1)])], SCHEMA)
    r = df.select(top_ids("category_trend_scores", None, "asc").alias("asc"),
                  top_ids("category_trend_scores", None, "desc").alias("desc"),
                  top_ids("category_trend_scores", None, "stable").alias("stable"),
                  top_ids("category_trend_scores", 5, "asc").alias("short")).first()
    assert r["asc"] == ["a", "c", "b"]
    assert r["desc"] == ["c", "a", "b"]
    assert r["stable"] == ["a", "c", "b"]
    assert r["short"] == ["a", "c", "b"]  # k larger than the array: shorter list


def test_rank_of_missing(spark):
    df = spark.createDataFrame([(["x", "y"], "y"), (["x", "y"], "z")], "arr array<string>, c string")
    assert [r[0] for r in df.select(rank_of("c", "arr")).collect()] == [2, 3]


def test_lgamma(spark):
    xs = [0.01, 0.2, 0.793, 1.0, 2.5, 7.3, 50.0, 1234.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(lgamma(F.col("x"))).collect()]
    for x, g in zip(xs, got):
        assert abs(g - math.lgamma(x)) < 1e-9


def test_kendall(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 3, 4]), ([1, 2, 3, 4], [4, 3, 2, 1]),
                                ([2, 2, 2, 2], [1, 2, 3, 4]), ([1, 2, 2, 3], [1, 3, 2, 4])],
                               "x array<long>, y array<long>")
    t = [r[0] for r in df.select(kendall_tau_b(F.col("x"), F.col("y"))).collect()]
    assert t[0] == pytest.approx(1.0) and t[1] == pytest.approx(-1.0) and t[2] is None
    # hand value: C=5, D=0, one pair tied in x -> 5 / sqrt(5 * 6)
    assert t[3] == pytest.approx(5 / math.sqrt(5 * 6))


def test_global_cumsum_matches_local(spark):
    rng = np.random.default_rng(0)
    vals = rng.integers(0, 50, 500).tolist()
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(vals)], "id long, v long")
    out = global_cumsum(df, ["v", "id"], ["v"]).orderBy("v", "id").collect()
    exp = np.cumsum(sorted(vals))
    assert [r["cum_v"] for r in out] == exp.tolist()


def test_exact_and_discrete_quantiles(spark):
    vals = [float(v) for v in [5, 1, 9, 3, 3, 7, 2, 8]]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    qs = [0.25, 0.5, 0.75, 0.99]
    got = {r["q"]: r["quantile"] for r in exact_quantiles(df, "x", qs).collect()}
    for q in qs:
        assert got[q] == pytest.approx(float(np.percentile(vals, q * 100)))
    d = {r["q"]: r["quantile"] for r in discrete_quantiles(spark.range(1, 9).select(F.col("id").cast("double").alias("x")),
                                                             "x", [0.25, 0.5, 0.75]).collect()}
    assert [d[0.25], d[0.5], d[0.75]] == [2.0, 4.0, 6.0]


def test_distributed_quantiles_on_continuous_values(spark):
    """One method at any number of distinct values, against numpy."""
    rng = np.random.default_rng(5)
    vals = rng.normal(100, 30, 2000).round(3).tolist()
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    qs = [0.01, 0.1, 0.5, 0.9, 0.99]
    got = {r["q"]: r["quantile"] for r in exact_quantiles(df, "x", qs).collect()}
    for q in qs:
        assert got[q] == pytest.approx(float(np.percentile(vals, q * 100)))
    srt = sorted(vals)
    disc = {r["q"]: r["quantile"] for r in discrete_quantiles(df, "x", qs).collect()}
    for q in qs:
        assert disc[q] == srt[max(math.ceil(len(srt) * q) - 1, 0)]
