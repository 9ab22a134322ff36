"""Oracle SQL statements (DuckDB dialect), one per query key that SQL can express."""

from __future__ import annotations

import importlib

MODULES = ["o_summaries", "o_rfm", "o_ctr", "o_ranking", "o_diversity", "o_clv", "o_fits", "o_sources"]


def all_oracle() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out.update(importlib.import_module(f"growthlab.plans.{m}").ORACLE)
    return out
