"""Queries: diversity (DV1-DV5), sequences (NG1-NG4), agreement (RK1-RK5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from growthlab.functions.columns import round_doubles
from growthlab.functions.ordered import materialize
from growthlab.operators import agreement as AG
from growthlab.operators import diversity as DV
from growthlab.operators import ranking as RK
from growthlab.operators import sequences as SQ
from growthlab.plans import params as P
from growthlab.plans.catalogue import query
from growthlab.plans.q_ranking import scores, topk
from growthlab.sources import fixtures as X

CATS = [str(i) for i in range(1, 13)]


@query("topk_category_counts")
def topk_category_counts(spark, sf):
    return DV.topk_category_counts(topk(spark, sf))


def _shares(spark, sf):
    return DV.topk_cumulative_share(DV.topk_category_counts(topk(spark, sf)), X.category_map(spark, sf))


@query("topk_cumulative_share")
def topk_cumulative_share(spark, sf):
    return round_doubles(_shares(spark, sf), 6)


@query("category_coverage")
def category_coverage(spark, sf):
    return round_doubles(DV.category_coverage(topk(spark, sf), X.category_map(spark, sf), P.TOP_K), 6)


@query("topk_entropy")
def topk_entropy(spark, sf):
    return round_doubles(DV.topk_entropy(_shares(spark, sf)), 6)


@query("topk_gini")
def topk_gini(spark, sf):
    return round_doubles(DV.topk_gini(_shares(spark, sf)), 6)


@query("category_sequence")
def category_sequence(spark, sf):
    return SQ.category_sequence(X.banner_events(spark, sf))


@query("category_bigrams")
def category_bigrams(spark, sf):
    return SQ.category_bigrams(X.banner_events(spark, sf))


@query("next_category_share")
def next_category_share(spark, sf):
    return round_doubles(SQ.next_category_share(SQ.category_bigrams(X.banner_events(spark, sf))), 6)


@query("repeat_share")
def repeat_share(spark, sf):
    return round_doubles(SQ.repeat_share(SQ.category_bigrams(X.banner_events(spark, sf))), 6)


def _taus(spark, sf):
    arr = AG.category_rank_arrays(scores(spark, sf), CATS)
    return AG.kendall_per_customer(arr, list(range(1, 13)))


@query("kendall_per_customer")
def kendall_per_customer(spark, sf):
    return round_doubles(_taus(spark, sf), 6)


@query("kendall_quantiles")
def kendall_quantiles(spark, sf):
    return round_doubles(AG.kendall_quantiles(_taus(spark, sf)), 6)


def _sales_rows(spark, sf, events=None):
    a = X.banner_events(spark, sf, P.SALES_START, P.SALES_END) if events is None else X._within(events, P.SALES_START, P.SALES_END)
    return a.where(F.col("sales") > 0).select("customer_id", "cma_id")


@query("category_sales_share")
def category_sales_share(spark, sf):
    return round_doubles(AG.category_share(_sales_rows(spark, sf)).join(X.category_map(spark, sf), "cma_id"), 6)


def _served(spark, sf):
    """(banner rows, served predictions): the banner aggregate is written once and read by
    the scores, the serving strategies and the sales."""
    be = materialize(X.banner_events(spark, sf))
    strat = X.experiment(spark, sf, events=be).select("customer_id", "final_serving_strategy").distinct()
    top = RK.topk_long(X.scores(spark, sf, P.SCORE_DAY, events=be), P.TOP_K, "asc")
    return be, top.join(strat, "customer_id").join(X.category_map(spark, sf), "cma_id")


@query("strategy_category_share")
def strategy_category_share(spark, sf):
    s = AG.category_share(_served(spark, sf)[1], by=["final_serving_strategy"])
    return round_doubles(s.join(X.category_map(spark, sf), "cma_id"), 6)


@query("topk_agreement")
def topk_agreement(spark, sf):
    be, served = _served(spark, sf)
    # a row per category each, read several times by the cut-offs
    pred = materialize(AG.category_share(served.where(F.col("final_serving_strategy") == "autopilot")))
    sales = materialize(AG.category_share(_sales_rows(spark, sf, be).join(X.category_map(spark, sf).select("cma_id"), "cma_id")))
    return round_doubles(AG.topk_agreement(pred, sales), 6)

