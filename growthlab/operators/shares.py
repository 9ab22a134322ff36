"""Distributions, shares and entropy.

A share of the grand total divides by a one-row aggregate joined by broadcast,
never by ``sum() over ()`` (an empty window is one task)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share_of_total(df: DataFrame, col: str, out: str = "p", by: list[str] | None = None) -> DataFrame:
    """``out`` = col / sum(col) (within ``by`` groups when given, else over all rows)."""
    by = list(by or [])
    tot = df.groupBy(*by).agg(F.sum(col).alias("__tot"))
    j = df.join(tot, by) if by else df.join(F.broadcast(tot))
    return j.withColumn(out, F.try_divide(F.col(col).cast("double"), F.col("__tot").cast("double"))).drop("__tot")


def entropy(df: DataFrame, weight_col: str, by: list[str] | None = None) -> DataFrame:
    """Shannon entropy of the distribution given by non-negative weights
    (normalised first, as ``scipy.stats.entropy``).  One pass:
    H = ln S − Σ w ln w / S."""
    by = list(by or [])
    w = F.col(weight_col).cast("double")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        (F.log(F.sum(w)) - F.sum(F.when(w > 0, w * F.log(w)).otherwise(F.lit(0.0))) / F.sum(w)).alias("entropy"))


def campaign_user_share(campaigns: DataFrame) -> DataFrame:
    """DS1: distinct users per campaign and their share."""
    c = campaigns.select("campaign_id", "customer_id").distinct().groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("count"))
    return share_of_total(c, "count")


def phase_user_share(campaigns: DataFrame, metadata: DataFrame) -> DataFrame:
    """DS2: (customer, phase) rows per phase (not distinct) and their share."""
    up = campaigns.join(metadata.select("campaign_id", "phase_id"), "campaign_id").select("customer_id", "phase_id")
    c = up.groupBy("phase_id").agg(F.count("customer_id").alias("count"))
    return share_of_total(c, "count")


def interaction_rates(events: DataFrame) -> DataFrame:
    """DS4: click rate and sales rate = sum / non-null count after null → 0."""
    e = events.select("banner_clicks", "sales").fillna(0)
    return e.agg(F.count("banner_clicks").alias("total"), F.sum("banner_clicks").alias("clicks"),
                 F.sum("sales").alias("sales_count")).select(
        "total", "clicks", F.try_divide(F.col("clicks").cast("double"), F.col("total")).alias("click_rate"),
        "sales_count", F.try_divide(F.col("sales_count").cast("double"), F.col("total")).alias("sales_rate"))


def phase_validation_anti(sample_pairs: DataFrame, phases: DataFrame) -> DataFrame:
    """DS6 / JN6: (customer, phase) pairs of the sample that the phase table lacks."""
    return sample_pairs.select("customer_id", "phase_id").distinct().join(
        phases.select("customer_id", "phase_id"), ["customer_id", "phase_id"], "left_anti")


def id_names(df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """DS5: distinct (id, name) pairs, for labelling."""
    return df.where(F.col(id_col).isNotNull()).select(id_col, name_col).distinct()
