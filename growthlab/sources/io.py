"""Reads, writes and input contracts.

Everything stays a DataFrame: no pandas round trip, no pickles, no driver
collection of data.  Multi-day reads are one scan with a partition-column
predicate (partition pruning) instead of a per-day read + union loop.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (Parquet)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_parquet(spark: SparkSession, path: str, basePath: str | None = None) -> DataFrame:
    """Parquet scan with partition discovery (``model=…/dt=…`` directories become columns)."""
    reader = spark.read
    if basePath:
        reader = reader.option("basePath", basePath)
    return reader.parquet(path)


def day_range(df: DataFrame, start, end, col: str = "dt") -> DataFrame:
    """Inclusive date range on a (partition) column: pruned at the scan."""
    return df.where(F.col(col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def days_in(df: DataFrame, days: Iterable, col: str = "dt") -> DataFrame:
    """Several named days in one scan (replaces read-per-day + union)."""
    return df.where(F.col(col).isin([F.lit(d).cast("date") for d in days]))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """CSV with an explicit schema (never inferred)."""
    return spark.read.schema(schema).option("header", header).csv(path)


def read_map_table(spark: SparkSession, path: str, c0: str, c1: str) -> DataFrame:
    """Headerless two-column CSV lookup, columns renamed to ``c0``, ``c1``."""
    return spark.read.schema(f"`{c0}` string, `{c1}` string").option("header", False).csv(path)


def read_csv_parts_with_date(spark: SparkSession, path: str, schema: T.StructType | str, date_col: str,
                             fmt: str = "yyyy-MM-dd") -> DataFrame:
    """SRC9: every CSV part under ``path`` in one scan (header, explicit schema),
    ``date_col`` parsed to a date."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.withColumn(date_col, F.to_date(F.col(date_col).cast("string"), fmt))


def as_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """SRC12 typed read (``.as[CaseClass]``): keep the declared fields, in order,
    cast to the declared types (``try_cast``: a bad value becomes null)."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def drop_null_ids(df: DataFrame, col: str = "customer_id") -> DataFrame:
    """FLT2: drop null ids and the string sentinel ``"null"``."""
    c = F.col(col)
    return df.where(c.isNotNull() & (c.cast("string") != F.lit("null")))


def latest_snapshot(df: DataFrame, col: str = "dt") -> DataFrame:
    """Rows of the newest snapshot (``col = max(col)``).

    The newest day is a scalar subquery: on a partition column it reads no data column, and
    the scan of the rows opens the files of that partition only (``PartitionFilters``); on a
    data column it becomes a filter of the scan.  Nothing is collected to the driver."""
    newest = df.select(col).agg(F.max(col)).scalar()
    return df.where(F.col(col) == newest)


def write_parquet(df: DataFrame, path: str, partition_by: Iterable[str] = ("dt",)) -> None:
    """Partitioned Parquet overwrite that replaces only the partitions present
    in ``df`` (dynamic partition overwrite)."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    cols = list(partition_by or ())
    if cols:
        w = w.partitionBy(*cols)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header.  ``single_file`` gathers the rows in one task: for reports, not
    for results that grow with the data."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def _strip(dt: T.DataType) -> T.DataType:
    if isinstance(dt, T.StructType):
        return T.StructType([T.StructField(f.name, _strip(f.dataType), True) for f in dt.fields])
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_strip(dt.elementType), True)
    if isinstance(dt, T.MapType):
        return T.MapType(_strip(dt.keyType), _strip(dt.valueType), True)
    return dt


def check_schema(df: DataFrame, expected: T.StructType, forbidden: Iterable[str] = ()) -> DataFrame:
    """Input contract: field names and types must equal ``expected`` (nullability
    ignored); forbidden columns (e.g. ``model_date``) are rejected.  Raises
    ``ValueError``; returns ``df`` unchanged so it can be chained."""
    got = {f.name: _strip(f.dataType) for f in df.schema.fields}
    for name in forbidden:
        if name in got:
            raise ValueError(f"column {name!r} must not be present")
    for f in expected.fields:
        if f.name not in got:
            raise ValueError(f"missing column {f.name!r}")
        if got[f.name] != _strip(f.dataType):
            raise ValueError(f"column {f.name!r} has type {got[f.name].simpleString()}, "
                             f"expected {f.dataType.simpleString()}")
    return df


SCORES_SCHEMA = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("category_trend_scores", T.ArrayType(T.StructType([
        T.StructField("category_id", T.StringType()),
        T.StructField("probability", T.DoubleType()),
    ]))),
])

SALES_EVENTS_SCHEMA = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("cma_id", T.StringType()),
    T.StructField("sales", T.LongType()),
    T.StructField("dt", T.DateType()),
])
