"""Queries: CTR / CVR by category and rank, A/B comparison, allocation (CT*, AB*, AL1, SRC8)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from growthlab.functions.columns import round_doubles
from growthlab.functions.ordered import materialize
from growthlab.operators import ctr as C
from growthlab.plans import params as P
from growthlab.plans.catalogue import query
from growthlab.sources import fixtures as X
from growthlab.sources import io as IO
from growthlab.sources.io import latest_snapshot


def _daily(spark, sf):
    be = X.banner_events(spark, sf, P.SALES_START, P.SALES_END)
    return C.banner_customer_category(be, X.category_map(spark, sf))


def rank_base(spark, sf):
    snaps = X.scores_by_day(spark, sf, P.SALES_START - _dt.timedelta(days=1), P.SALES_END - _dt.timedelta(days=1))
    return C.banner_rank_base(_daily(spark, sf), snaps, P.TOP_N, "stable")


@query("latest_snapshot")
def q_latest_snapshot(spark, sf):
    return round_doubles(latest_snapshot(X.banner_events(spark, sf)))


@query("banner_customer_category")
def banner_customer_category(spark, sf):
    return _daily(spark, sf)


@query("banner_rank_base")
def banner_rank_base(spark, sf):
    return rank_base(spark, sf)


@query("ctr_by_category_rank")
def ctr_by_category_rank(spark, sf):
    return round_doubles(C.ctr_by_category_rank(rank_base(spark, sf)), 6)


@query("ctr_by_rank")
def ctr_by_rank(spark, sf):
    return round_doubles(C.ctr_by_rank(rank_base(spark, sf)), 6)


@query("impression_click_gap")
def impression_click_gap(spark, sf):
    return round_doubles(C.impression_click_gap(rank_base(spark, sf)), 6)


@query("category_factor")
def category_factor(spark, sf):
    return round_doubles(C.category_factor(rank_base(spark, sf)), 6)


@query("factor_decile")
def factor_decile(spark, sf):
    f = C.category_factor(rank_base(spark, sf)).select("cma_id", "factor")
    return round_doubles(C.factor_decile(f), 6)


@query("factor_deciles")
def factor_deciles(spark, sf):
    f = C.category_factor(rank_base(spark, sf)).select("cma_id", "factor")
    return round_doubles(C.factor_deciles(f), 6)


def ab_inputs(spark, sf, affected=None):
    """The banner aggregate, written once, and the A/B base on it (the experiment and the
    valid categories are read off the same rows)."""
    be = materialize(X.banner_events(spark, sf))
    return be, C.ab_event_base(be, X.experiment(spark, sf, events=be), X.category_map(spark, sf), affected)


def valid_categories(be):
    """Categories with a sale on the day."""
    return be.where(F.col("sales") > 0).select("dt", "cma_id").distinct()


@query("ab_event_base")
def ab_event_base(spark, sf):
    return round_doubles(ab_inputs(spark, sf)[1])


@query("ab_affected_base")
def ab_affected_base(spark, sf):
    """AB1 for affected customers only: those with an urgent order."""
    orders = IO.table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return round_doubles(ab_inputs(spark, sf, orders.select(F.col("o_custkey").alias("customer_id")))[1])


@query("ab_category_metrics")
def ab_category_metrics(spark, sf):
    return round_doubles(C.ab_category_metrics(ab_inputs(spark, sf)[1]), 6)


@query("ab_comparison")
def ab_comparison(spark, sf):
    be, base = ab_inputs(spark, sf)
    m = materialize(C.ab_category_metrics(base))  # a row per category, day and group, read by both sides
    return round_doubles(C.ab_comparison(m, valid_categories(be)), 6)


@query("ab_entropy")
def ab_entropy(spark, sf):
    return round_doubles(C.ab_entropy(C.ab_category_metrics(ab_inputs(spark, sf)[1])), 6)


@query("topk_allocation")
def topk_allocation(spark, sf):
    snaps = X.scores_by_day(spark, sf, P.ROLL_FIRST, P.ROLL_LAST)
    return C.topk_allocation(snaps, 2, "5")
