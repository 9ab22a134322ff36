"""growthlab: customer-growth analytics written as Spark DataFrame code.

Modules
-------
sources     reading the driver tables, canonical fixture views, sinks, schema contracts
functions   Column-level helpers (safe ratios, log-gamma, array top-k, ...)
operators   the analyses (summaries, RFM, CTR/A-B, ranking metrics, diversity,
            n-grams, agreement statistics, lifetime value, regression)
plans       the query catalogue (one callable per query key) and DuckDB oracle SQL
streaming   incremental (micro-batch) runners over day-partitioned inputs
"""

from growthlab.session import get_spark  # noqa: F401

__all__ = ["get_spark"]
