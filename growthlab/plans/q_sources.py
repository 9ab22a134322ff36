"""Queries over stores the library writes itself (SRC2-SRC9, SRC12, SNK1-SNK4): the banner
rows go out through a sink, come back through a source, and are aggregated."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlab.functions.columns import round_doubles
from growthlab.functions.ordered import materialize
from growthlab.plans import params as P
from growthlab.plans.catalogue import query
from growthlab.session import scratch_path
from growthlab.sources import fixtures as X
from growthlab.sources import io as IO


def banner_store(spark, sf) -> str:
    """Banner rows under ``dt=`` folders; the score day is then written again with doubled
    impressions, which replaces that folder and leaves the others."""
    path = scratch_path(spark, "banner-store")
    be = materialize(X.banner_events(spark, sf))
    IO.write_parquet(be.repartition("dt", "cma_id"), path)
    again = be.where(F.col("dt") == F.lit(P.SCORE_DAY)).withColumn("impressions", 2 * F.col("impressions"))
    IO.write_parquet(again, path)
    return path


def _daily(rows):
    return rows.groupBy("dt").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("impressions").alias("impressions"),
                                  F.sum("sales").alias("sales"))


@query("store_day_range")
def store_day_range(spark, sf):
    """SRC2, SRC4, SNK1: a range of days of the store in one pruned scan."""
    return _daily(IO.day_range(IO.read_parquet(spark, banner_store(spark, sf)), P.ROLL_FIRST, P.ROLL_LAST))


@query("store_named_days")
def store_named_days(spark, sf):
    """SRC3: named days of the store in one pruned scan, with its base path for discovery."""
    path = banner_store(spark, sf)
    return _daily(IO.days_in(IO.read_parquet(spark, path, basePath=path), [P.SCORE_DAY, P.SALES_START, P.SALES_END]))


@query("store_latest_day")
def store_latest_day(spark, sf):
    """SRC8: the newest day, found from the partition values."""
    return _daily(IO.latest_snapshot(IO.read_parquet(spark, banner_store(spark, sf))))


EVENT_TEXT = "customer_id string, cma_id string, sales string, dt string, gmv string"
EVENT_SCHEMA = T.StructType([*IO.SALES_EVENTS_SCHEMA.fields, T.StructField("gmv", T.DoubleType())])


def csv_events(spark, sf):
    """SNK2, SRC6, SRC9, SRC12, FLT2: sold rows written as CSV parts with a header, every
    seventh customer's id as the text ``null``; read back as text in one scan, dates parsed,
    null ids dropped, typed and checked against the contract."""
    path = scratch_path(spark, "csv-events")
    sold = X.banner_events(spark, sf).where(F.col("sales") > 0)
    ids = F.when(F.col("customer_id") % 7 == 0, F.lit("null")).otherwise(F.col("customer_id").cast("string"))
    IO.write_csv(sold.select(ids.alias("customer_id"), "cma_id", "sales", "dt", "gmv"), path)
    text = IO.read_csv_parts_with_date(spark, path, EVENT_TEXT, "dt")
    return IO.check_schema(IO.as_schema(IO.drop_null_ids(text), EVENT_SCHEMA), EVENT_SCHEMA, forbidden=["model_date"])


@query("csv_events")
def q_csv_events(spark, sf):
    rows = csv_events(spark, sf).groupBy("cma_id", "dt")
    return round_doubles(rows.agg(F.count_distinct("customer_id").alias("customers"), F.sum("sales").alias("sales"), F.sum("gmv").alias("gmv")))


@query("csv_map_table")
def csv_map_table(spark, sf):
    """SRC6, SRC7, SNK4: the category map as a report with a header in one file, and without a
    header as a lookup; both read with declared columns and joined to the sold rows."""
    report, lookup = scratch_path(spark, "report"), scratch_path(spark, "lookup")
    names = X.category_map(spark, sf)
    IO.write_csv(names, report, single_file=True)
    names.select("category_name", "cma_id").write.option("header", False).csv(lookup)
    by_name = IO.read_map_table(spark, lookup, "category_name", "top_cat")
    listed = IO.read_csv(spark, report, "cma_id string, category_name string")
    sold = csv_events(spark, sf).groupBy("cma_id").agg(F.sum("sales").alias("sales"))
    return sold.join(listed, "cma_id").join(by_name, "category_name").select("category_name", "top_cat", "sales")
