"""Small Column helpers (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(num, den) -> Column:
    """num / den as double; null when den is 0 or null (ANSI-safe)."""
    return F.try_divide(F.col(num) if isinstance(num, str) else num,
                        (F.col(den) if isinstance(den, str) else den).cast("double"))


MONEY_SCALE = 10_000


def money_units(c) -> Column:
    """Money as exact fixed-point units of 1e-4 (long).  Sums of units do not
    depend on summation order, so totals are the same on any partitioning and
    after any retry."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * F.lit(float(MONEY_SCALE)), 0).cast("long")


def units_to_money(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("double") / F.lit(float(MONEY_SCALE))


def mean_units(sum_units, n) -> Column:
    """(sum of units / n) / scale, as double."""
    s = F.col(sum_units) if isinstance(sum_units, str) else sum_units
    k = F.col(n) if isinstance(n, str) else n
    return (s.cast("double") / k.cast("double")) / F.lit(float(MONEY_SCALE))


def hash_bucket(id_col, modulus: int = 1000) -> Column:
    """Deterministic pseudo-random bucket of an integer id: pmod(id·7919, modulus).
    Same value in DuckDB; re-running after a lost executor gives the same split."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(c * F.lit(7919), F.lit(modulus))


def hash_sample(df: DataFrame, id_col: str, fraction: float, modulus: int = 1000) -> DataFrame:
    """Rows whose id falls in the first ``fraction`` of the hash buckets."""
    return df.where(hash_bucket(id_col, modulus) < F.lit(int(round(fraction * modulus))))


def round_half(c: Column, digits: int) -> Column:
    """round(c·10^d)/10^d on the binary double (the usual C-library rounding;
    Spark's ``round`` rounds the shortest decimal string instead, which differs
    on values such as 23791.70585)."""
    scale = float(10 ** digits)
    return F.round(c * F.lit(scale), 0) / F.lit(scale)


def round_doubles(df: DataFrame, digits: int = 4, overrides: dict[str, int] | None = None) -> DataFrame:
    """Round every double column (for reproducible comparison of results)."""
    overrides = overrides or {}
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_half(F.col(f.name).cast("double"), overrides.get(f.name, digits)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def arr_to_str(arr, sep: str = ",") -> Column:
    """Array of scalars → delimited string (order kept)."""
    c = F.col(arr) if isinstance(arr, str) else arr
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)
