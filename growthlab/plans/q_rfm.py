"""Queries: RFM (RF1-RF4, AG16) and campaign / phase distributions (DS1-DS6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from growthlab.functions.columns import round_doubles
from growthlab.functions.ordered import materialize
from growthlab.operators import rfm as R
from growthlab.operators import shares as SH
from growthlab.plans import params as P
from growthlab.plans.catalogue import query
from growthlab.sources import fixtures as X


def customer_types(spark, sf):
    """Scheduler type per push-campaign customer: 'classic' when any campaign of
    the customer is classic-scheduled, else 'model'."""
    return X.push_campaigns(spark, sf).groupBy("customer_id").agg(F.min("scheduler").alias("type"))


def rfm_table(spark, sf):
    sales = X.sales(spark, sf, P.RFM_START, P.RFM_END)
    types = customer_types(spark, sf)
    # aggregate first, then attach the type (inner join = restriction to campaign customers)
    r = materialize(R.rfm(sales, P.RFM_START, P.RFM_END).join(types, "customer_id"))
    return materialize(R.trim_rfm(r))


@query("rfm")
def q_rfm(spark, sf):
    return round_doubles(rfm_table(spark, sf))


@query("rfm_summary")
def rfm_summary(spark, sf):
    return round_doubles(R.describe(rfm_table(spark, sf), ["frequency", "recency", "total_value"]))


@query("rfm_quantile_score")
def rfm_quantile_score(spark, sf):
    return round_doubles(R.rfm_quantile_score(rfm_table(spark, sf)))


@query("rfm_qcut_score")
def rfm_qcut_score(spark, sf):
    return round_doubles(R.rfm_qcut_score(rfm_table(spark, sf)))


@query("rfm_by_type")
def rfm_by_type(spark, sf):
    return round_doubles(R.describe(R.rfm_quantile_score(rfm_table(spark, sf)), ["rfm"], by=["type"]))


def _classic(spark, sf):
    return X.push_campaigns(spark, sf).where(F.col("scheduler") == "classic")


@query("campaign_user_share")
def campaign_user_share(spark, sf):
    return round_doubles(SH.campaign_user_share(_classic(spark, sf)), 6)


@query("phase_user_share")
def phase_user_share(spark, sf):
    return round_doubles(SH.phase_user_share(_classic(spark, sf), X.campaign_metadata(spark, sf)), 6)


@query("share_entropy")
def share_entropy(spark, sf):
    camp = SH.campaign_user_share(_classic(spark, sf)).withColumn("dimension", F.lit("campaign"))
    phase = SH.phase_user_share(_classic(spark, sf), X.campaign_metadata(spark, sf)).withColumn(
        "dimension", F.lit("phase"))
    both = camp.select("dimension", "count").unionByName(phase.select("dimension", "count"))
    return round_doubles(SH.entropy(both, "count", by=["dimension"]), 6)


@query("phase_validation_anti")
def phase_validation_anti(spark, sf):
    model = X.push_campaigns(spark, sf).where(F.col("scheduler") == "model")
    pairs = model.join(X.campaign_metadata(spark, sf).select("campaign_id", "phase_id"), "campaign_id")
    return SH.phase_validation_anti(pairs, X.customer_phases(spark, sf))


@query("interaction_rates")
def interaction_rates(spark, sf):
    return round_doubles(SH.interaction_rates(X.banner_events(spark, sf)), 6)


@query("campaign_names")
def campaign_names(spark, sf):
    md = X.campaign_metadata(spark, sf)
    used = X.push_campaigns(spark, sf).select("campaign_id")
    return SH.id_names(md.join(used, "campaign_id", "left_semi"), "campaign_id", "campaign_name")
