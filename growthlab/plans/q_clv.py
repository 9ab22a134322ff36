"""Queries: lifetime value scoring and evaluation (LV3-LV12, EV1-EV12, AG20, RK6-RK7), regression (MLR1-MLR5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from growthlab.functions.columns import round_doubles
from growthlab.functions.ordered import materialize
from growthlab.operators import agreement as AG
from growthlab.operators import clv as L
from growthlab.operators import regress as RG
from growthlab.plans import params as P
from growthlab.plans.catalogue import query
from growthlab.plans.q_summaries import pre_post

BG = L.BGNBD(P.BG_R, P.BG_ALPHA, P.BG_A, P.BG_B)
GG = L.GammaGamma(P.GG_P, P.GG_Q, P.GG_V)


def scored(spark, sf):
    pp = materialize(pre_post(spark, sf))
    return materialize(L.score(pp, BG, GG, P.HOLDOUT_T, P.CLV_MONTHS, P.CLV_DISCOUNT, P.CLV_FREQ,
                               floor=P.CLV_ADJ_FLOOR))


def _ids(spark, sf, *cols):
    return round_doubles(scored(spark, sf).select("id", *cols))


@query("expected_purchases")
def expected_purchases(spark, sf):
    return _ids(spark, sf, "predicted_purchases")


@query("probability_alive")
def probability_alive(spark, sf):
    return _ids(spark, sf, "palive")


@query("expected_avg_profit")
def expected_avg_profit(spark, sf):
    return _ids(spark, sf, "avenue")


@query("clv")
def q_clv(spark, sf):
    return _ids(spark, sf, "clv")


@query("clv_adjusted")
def clv_adjusted(spark, sf):
    return _ids(spark, sf, "clv_adjusted")


@query("rule_based_clv")
def rule_based_clv(spark, sf):
    s = scored(spark, sf)
    return round_doubles(s.select("id", L.rule_based_clv("monetary_value", 0.8, 0.1).alias("clv_rule"),
                                  (F.col("predicted_purchases") * F.col("monetary_value")).alias("ltv")))


@query("frequency_recency_grid")
def frequency_recency_grid(spark, sf):
    t = pre_post(spark, sf).agg(F.max("T_cal").alias("T"))
    return round_doubles(L.frequency_recency_grid(BG, 20, t, 20, 1.0), 6)


@query("alive_history")
def alive_history(spark, sf):
    """Two customers (smallest ids with 2 and 4 repeat purchases) over the last
    300 days of the calibration window."""
    import datetime as _dt
    from growthlab.operators.summaries import customer_summary
    from growthlab.sources import fixtures as X
    sales = X.sales(spark, sf, P.CAL_START, P.CAL_END, P.CATEGORY)
    summ = customer_summary(sales, P.CAL_START, P.CAL_END, P.CATEGORY)
    pick = summ.where(F.col("frequency").isin(2, 4)).groupBy("frequency").agg(F.min("customer_id").alias("customer_id"))
    first = P.CAL_END - _dt.timedelta(days=299)
    return round_doubles(L.alive_history(sales, pick, first, P.CAL_END, BG), 6)


@query("repeat_histogram")
def repeat_histogram(spark, sf):
    return L.repeat_histogram(pre_post(spark, sf), 20)


@query("calibration_curve")
def calibration_curve(spark, sf):
    return round_doubles(L.calibration_curve(scored(spark, sf), 10))


@query("frequency_eval")
def frequency_eval(spark, sf):
    return round_doubles(L.frequency_eval(scored(spark, sf), 2, 40, adjusted=False))


@query("frequency_eval_capped")
def frequency_eval_capped(spark, sf):
    return round_doubles(L.frequency_eval_capped(scored(spark, sf), 25))


@query("money_eval")
def money_eval(spark, sf):
    return round_doubles(L.money_eval(scored(spark, sf)))


@query("clv_variant_eval")
def clv_variant_eval(spark, sf):
    return round_doubles(L.clv_variant_eval(scored(spark, sf), "total_holdout", 5e7))


@query("total_value_eval")
def total_value_eval(spark, sf):
    return round_doubles(L.total_value_eval(scored(spark, sf)))


def _bins(spark, sf, s=None):
    s = s if s is not None else scored(spark, sf)
    return L.decile_bins(s, "total_holdout")


@query("decile_bins")
def decile_bins(spark, sf):
    return round_doubles(_bins(spark, sf))


@query("bucket_mean")
def bucket_mean(spark, sf):
    s = scored(spark, sf)
    return round_doubles(L.bucket_mean(s, "total_holdout", ["total_holdout", "clv", "total_value"], _bins(spark, sf, s)))


@query("bucket_tpr_fpr")
def bucket_tpr_fpr(spark, sf):
    s = scored(spark, sf)
    return round_doubles(L.bucket_tpr_fpr(s, "total_holdout", "clv_adjusted", _bins(spark, sf, s)), 6)


@query("bucket_mape")
def bucket_mape(spark, sf):
    s = scored(spark, sf)
    bins = _bins(spark, sf, s)
    m = L.bucket_mean(s, "total_holdout", ["total_holdout", "clv"], bins)
    return round_doubles(L.bucket_mape(m, m, "mean_clv", "mean_total_holdout").where(F.col("bucket") >= 1))


@query("bucket_mape_mean")
def bucket_mape_mean(spark, sf):
    """EV9's headline: the mean over the buckets above 0 of the rounded deviation, of the
    prediction and of the training value as a baseline."""
    s = scored(spark, sf)
    m = materialize(L.bucket_mean(s, "total_holdout", ["total_holdout", "clv", "total_value"], _bins(spark, sf, s)))
    parts = [L.bucket_mape(m, m, c, "mean_total_holdout").where(F.col("bucket") >= 1)
             .agg(F.avg(F.round("mape", 3)).alias(name)) for c, name in (("mean_clv", "mape_clv"), ("mean_total_value", "mape_training"))]
    return round_doubles(parts[0].join(parts[1]))


@query("value_concentration")
def value_concentration(spark, sf):
    return round_doubles(L.value_concentration(scored(spark, sf), "clv", "id", 0.99), 6)


@query("percentile_curve")
def percentile_curve(spark, sf):
    return round_doubles(L.percentile_curve(scored(spark, sf), "clv", "id", 0.99), 6)


@query("gini")
def q_gini(spark, sf):
    s = scored(spark, sf)
    a = L.gini(s, "total_holdout").withColumnRenamed("gini", "gini_total_holdout")
    b = L.gini(s, "clv").withColumnRenamed("gini", "gini_clv")
    return round_doubles(a.join(b), 6)


@query("spearman")
def q_spearman(spark, sf):
    return round_doubles(AG.spearman(scored(spark, sf), "total_holdout", "clv"), 6)


@query("topn_jaccard")
def topn_jaccard(spark, sf):
    return round_doubles(AG.topn_jaccard(scored(spark, sf), "id", "total_holdout", "clv", 100), 6)


@query("bgnbd_loglik")
def bgnbd_loglik(spark, sf):
    """LV1's objective at the catalogue's parameters."""
    return round_doubles(L.log_likelihood(pre_post(spark, sf), L.bgnbd_loglik_terms(BG)))


@query("gamma_gamma_loglik")
def gamma_gamma_loglik(spark, sf):
    """LV2's objective at the catalogue's parameters, over repeat customers."""
    pp = pre_post(spark, sf).where((F.col("frequency_cal") > 0) & (F.col("monetary_value") > 0))
    return round_doubles(L.log_likelihood(pp, L.gg_loglik_terms(GG)))


@query("fitted_parameters")
def fitted_parameters(spark, sf):
    """LV1, LV2 and LV13: both models fitted, written, read back; logarithms of the parameters."""
    from growthlab.session import scratch_path
    pp = materialize(pre_post(spark, sf))
    path = scratch_path(spark, "params")
    L.save_params(spark, path, L.fit_bgnbd(pp, penalizer=0.001, tol=1e-8), L.fit_gamma_gamma(pp, penalizer=0.001, finite_mean=True, tol=1e-8))
    fitted = L.params_frame(spark, *L.load_params(spark, path))
    return fitted.select(*[F.round(F.log(c), 4).alias(f"log_{c}") for c in fitted.columns])


@query("clv_units")
def clv_units(spark, sf):
    """LV6 over three periods of a week, a month and an hour-counted month."""
    pp = pre_post(spark, sf)
    args = ("frequency_cal", "recency_cal", "T_cal", "monetary_value")
    return round_doubles(pp.select("id", *[L.clv(BG, GG, *args, time=3, discount=P.CLV_DISCOUNT, freq=f).alias(f"clv_{f.lower()}") for f in "WMH"]))


@query("ml_features")
def ml_features(spark, sf):
    return round_doubles(RG.ml_features(pre_post(spark, sf)), 6)


@query("standardised_features")
def standardised_features(spark, sf):
    f = RG.ml_features(pre_post(spark, sf))
    return round_doubles(RG.standardise(RG.split(f, 0.67), RG.SCALED), 6)


@query("ridge_coefficients")
def ridge_coefficients(spark, sf):
    f = RG.standardise(RG.split(RG.ml_features(pre_post(spark, sf)), 0.67), RG.SCALED)
    return round_doubles(RG.ridge_coefficients(f, RG.FEATURES, 0.5))


@query("ridge_mae")
def ridge_mae(spark, sf):
    f = RG.standardise(RG.split(RG.ml_features(pre_post(spark, sf)), 0.67), RG.SCALED)
    return round_doubles(RG.ridge_mae(f, RG.FEATURES, 0.5))
