"""Query catalogue: every query key of SURVEY §9 as ``f(spark, sf_dir) -> DataFrame``.

Each query reads the driver tables through ``growthlab.sources.fixtures`` and
runs one operator over the whole input.  Double columns are rounded at the end
(4 decimals unless stated) so the DuckDB oracle in ``plans.oracle`` gives the
same values; arrays are turned into delimited strings.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    """Register ``fn(spark, sf_dir)`` under ``name``.  The registered callable
    first makes sure the session has a checkpoint folder (the cluster's
    ``spark.checkpoint.dir``, or a scratch one only when none is set)."""
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from growthlab.session import ensure_checkpoint_dir
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        return fn
    return deco


MODULES = ["q_summaries", "q_rfm", "q_ctr", "q_ranking", "q_diversity", "q_clv", "q_sources"]


def _load_all():
    # importing the modules fills QUERIES
    import importlib
    for m in MODULES:
        importlib.import_module(f"growthlab.plans.{m}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)
