"""Queries over the sales view: summaries, trims, quantiles, ranks (CS*, FLT8, AG15-18, WN5-6, SC14)."""

from __future__ import annotations

from growthlab.functions.columns import hash_sample, round_doubles
from growthlab.operators import summaries as S
from growthlab.plans import params as P
from growthlab.plans.catalogue import query
from growthlab.sources import fixtures as X


def _cal_summary(spark, sf):
    sales = X.sales(spark, sf, P.CAL_START, P.CAL_END, P.CATEGORY)
    return S.customer_summary(sales, P.CAL_START, P.CAL_END, P.CATEGORY)


@query("customer_summary")
def customer_summary(spark, sf):
    return round_doubles(_cal_summary(spark, sf))


@query("customer_category_summary")
def customer_category_summary(spark, sf):
    sales = X.sales(spark, sf, P.CAL_START, P.CAL_END)
    return round_doubles(S.customer_category_summary(sales, P.CAL_START, P.CAL_END))


@query("category_popularity")
def category_popularity(spark, sf):
    sales = X.sales(spark, sf, P.CAL_START, P.CAL_END)
    return S.category_popularity(sales, P.CAL_START, P.CAL_END)


@query("transaction_summary")
def transaction_summary(spark, sf):
    sales = X.sales(spark, sf, P.CAL_START, P.CAL_END)
    return S.transaction_summary(sales, P.CAL_END, P.CAL_START)


@query("train_test_summary")
def train_test_summary(spark, sf):
    sales = X.sales(spark, sf, P.CAL_START, P.HOLD_END, P.CATEGORY)
    return round_doubles(S.train_test_summary(sales, (P.CAL_START, P.CAL_END), (P.HOLD_START, P.HOLD_END),
                                              P.CATEGORY, sample_ratio=0.3))


@query("calibration_holdout")
def calibration_holdout(spark, sf):
    sales = X.sales(spark, sf, P.CAL_START, P.HOLD_END, P.CATEGORY)
    return S.calibration_holdout(sales, P.CAL_START, P.CAL_END, P.HOLD_END, P.CATEGORY)


def pre_post(spark, sf, weeks=False):
    sales = X.sales(spark, sf, P.CAL_START, P.HOLD_END, P.CATEGORY)
    return S.pre_post_table(sales, (P.CAL_START, P.CAL_END), (P.HOLD_START, P.HOLD_END), P.CATEGORY, weeks=weeks)


@query("pre_post_weeks")
def pre_post_weeks(spark, sf):
    """CS8 with the hold-out duration in weeks."""
    return round_doubles(pre_post(spark, sf, weeks=True).select("id", "frequency_cal", "duration_holdout"))


@query("customer_summary_whole_prices")
def customer_summary_whole_prices(spark, sf):
    """CS1 over prices cut to whole units (PRJ5)."""
    sales = X.sales(spark, sf, P.CAL_START, P.CAL_END, P.CATEGORY)
    return round_doubles(S.customer_summary(sales, P.CAL_START, P.CAL_END, P.CATEGORY, price_as_int=True))


@query("sketch_quantiles")
def sketch_quantiles(spark, sf):
    """AG13 with a stated error: per category, price quantiles from sketches made per day and
    merged, and whether each is within the rank error of the exact count."""
    return S.sketch_quantile_errors(X.sales(spark, sf), "category_id", "dt", "selling_price", (0.1, 0.25, 0.5, 0.75, 0.9, 0.99), 0.01)


@query("pre_post_table")
def pre_post_table(spark, sf):
    return round_doubles(pre_post(spark, sf))


@query("example_histories")
def example_histories(spark, sf):
    sales = X.sales(spark, sf, P.CAL_START, P.CAL_END, P.CATEGORY)
    return round_doubles(S.example_histories(sales, P.CAL_START, P.CAL_END, P.CATEGORY, (2, 4)))


@query("quantile_trim")
def quantile_trim(spark, sf):
    return round_doubles(S.quantile_trim(_cal_summary(spark, sf), "monetary_value", 0.99))


@query("value_quantiles")
def value_quantiles(spark, sf):
    return round_doubles(S.value_quantiles(_cal_summary(spark, sf), "monetary_value"))


@query("tail_describe")
def tail_describe(spark, sf):
    return round_doubles(S.tail_describe(_cal_summary(spark, sf), "total_value", 0.4))


@query("freq_money_corr")
def freq_money_corr(spark, sf):
    return round_doubles(S.freq_money_corr(_cal_summary(spark, sf)), 6)


@query("dense_pct_rank")
def dense_pct_rank(spark, sf):
    return round_doubles(S.dense_pct_rank(_cal_summary(spark, sf), "total_value", ascending=False), 6)


@query("avg_pct_rank")
def avg_pct_rank(spark, sf):
    return round_doubles(S.avg_pct_rank(_cal_summary(spark, sf), "total_value", ascending=True), 6)


@query("hash_split")
def hash_split(spark, sf):
    return round_doubles(hash_sample(_cal_summary(spark, sf), "customer_id", 0.3))

