import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlab.sources import fixtures as X
from growthlab.sources import io as IO

SF = "/root/testdata/sf0.001"


def test_partitioned_write_read_and_pruning(spark):
    d = tempfile.mkdtemp(prefix="gl-io-", dir="/tmp")
    be = X.banner_events(spark, SF)
    IO.write_parquet(be, f"{d}/be", ["dt"])
    back = IO.read_parquet(spark, f"{d}/be")
    assert back.count() == be.count()
    one = IO.day_range(back, dt.date(2024, 1, 3), dt.date(2024, 1, 4))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "dt" in plan
    assert one.count() == be.where(F.col("dt").between("2024-01-03", "2024-01-04")).count()


def test_csv_with_schema_and_map_table(spark):
    d = tempfile.mkdtemp(prefix="gl-csv-", dir="/tmp")
    cm = X.category_map(spark, SF)
    IO.write_csv(cm, f"{d}/cm", single_file=True)
    back = IO.read_csv(spark, f"{d}/cm", "cma_id string, category_name string")
    assert sorted(back.collect()) == sorted(cm.collect())
    cm.write.mode("overwrite").option("header", False).csv(f"{d}/raw")
    m = IO.read_map_table(spark, f"{d}/raw", "category_name", "top_cat")
    assert m.columns == ["category_name", "top_cat"] and m.count() == cm.count()


def test_latest_snapshot(spark):
    be = X.banner_events(spark, SF)
    mx = be.agg(F.max("dt")).first()[0]
    assert IO.latest_snapshot(be).where(F.col("dt") != mx).count() == 0


def test_schema_contract(spark):
    sc = X.scores(spark, SF, dt.date(2024, 1, 20))
    IO.check_schema(sc, IO.SCORES_SCHEMA)
    with pytest.raises(ValueError):
        IO.check_schema(sc.withColumn("model_date", F.lit(1)), IO.SCORES_SCHEMA, forbidden=["model_date"])
    with pytest.raises(ValueError):
        IO.check_schema(sc.withColumn("customer_id", F.col("customer_id").cast("string")), IO.SCORES_SCHEMA)


def test_csv_parts_typed_read_and_null_ids(spark):
    d = tempfile.mkdtemp(prefix="gl-parts-", dir="/tmp")
    rows = [("1", "2024-01-02", "0.5"), ("2", "2024-01-03", "x"), ("null", "2024-01-04", "1.0")]
    df = spark.createDataFrame(rows, "customer_id string, date string, p string")
    df.repartition(3).write.option("header", True).csv(f"{d}/parts")
    back = IO.read_csv_parts_with_date(spark, f"{d}/parts", "customer_id string, date string, p string", "date")
    assert dict(back.dtypes)["date"] == "date" and back.count() == 3
    typed = IO.as_schema(back, T.StructType([T.StructField("customer_id", T.LongType()),
                                             T.StructField("p", T.DoubleType())]))
    assert typed.columns == ["customer_id", "p"]
    assert sorted((r["customer_id"], r["p"]) for r in typed.where(F.col("customer_id").isNotNull()).collect()) == \
        [(1, 0.5), (2, None)]
    assert IO.drop_null_ids(back).count() == 2
