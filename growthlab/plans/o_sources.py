"""Oracle SQL for the store queries: what the sources must give back."""

from __future__ import annotations

from growthlab.plans.views_sql import with_views


def _daily(where: str) -> str:
    return with_views(["banner_events"], f"""
        SELECT dt, COUNT(*) AS n_rows, CAST(SUM(CASE WHEN dt = DATE '2024-01-20' THEN 2 ELSE 1 END * impressions) AS BIGINT) AS impressions,
               CAST(SUM(sales) AS BIGINT) AS sales FROM banner_events WHERE {where} GROUP BY dt""")


_SOLD = ("sold", "SELECT * FROM banner_events WHERE sales > 0 AND customer_id % 7 <> 0")

ORACLE = {
    "store_day_range": _daily("dt BETWEEN DATE '2024-01-20' AND DATE '2024-01-26'"),
    "store_named_days": _daily("dt IN (DATE '2024-01-20', DATE '2024-01-21', DATE '2024-01-30')"),
    "store_latest_day": _daily("dt = (SELECT MAX(dt) FROM banner_events)"),
    "csv_events": with_views(["banner_events"], """
        SELECT cma_id, dt, COUNT(DISTINCT customer_id) AS customers, CAST(SUM(sales) AS BIGINT) AS sales, round(SUM(gmv), 4) AS gmv
        FROM sold GROUP BY cma_id, dt""", [_SOLD]),
    "csv_map_table": with_views(["banner_events"], """
        SELECT n_name AS category_name, CAST(n_nationkey + 1 AS VARCHAR) AS top_cat, CAST(SUM(sales) AS BIGINT) AS sales
        FROM sold JOIN nation ON cma_id = CAST(n_nationkey + 1 AS VARCHAR) GROUP BY ALL""", [_SOLD]),
}
