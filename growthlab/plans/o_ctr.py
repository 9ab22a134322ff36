"""Oracle SQL for the CTR / A-B queries."""

from __future__ import annotations

from growthlab.plans.views_sql import with_views


def snapshot_ctes(first, last):
    """Daily score snapshots (dt, customer_id, category_id, probability, pos)."""
    return [
        ("days", f"SELECT CAST(UNNEST(generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 DAY)) AS DATE) AS snap_dt"),
        ("be_up", f"""SELECT customer_id, cma_id, dt, COUNT(*) AS n FROM banner_events
                     WHERE dt <= DATE '{last}' GROUP BY customer_id, cma_id, dt"""),
        ("snap", """SELECT d.snap_dt, b.customer_id, b.cma_id, SUM(b.n) AS n FROM be_up b JOIN days d ON b.dt <= d.snap_dt
                   GROUP BY d.snap_dt, b.customer_id, b.cma_id"""),
        ("sp", """SELECT snap_dt AS dt, customer_id, cma_id AS category_id,
                     n / SUM(n) OVER (PARTITION BY snap_dt, customer_id) AS probability FROM snap"""),
        ("tk", """SELECT *, ROW_NUMBER() OVER (PARTITION BY dt, customer_id ORDER BY probability DESC, category_id ASC) AS pos
                  FROM sp"""),
    ]


BASE_CTES = snapshot_ctes("2024-01-20", "2024-01-29") + [
    ("daily", """SELECT b.dt, b.customer_id, b.cma_id, CAST(SUM(b.impressions) AS BIGINT) AS impressions,
                   CAST(SUM(b.banner_clicks) AS BIGINT) AS clicks, CAST(SUM(b.sales) AS BIGINT) AS sales
                 FROM banner_events b JOIN category_map m ON b.cma_id = m.cma_id
                 WHERE b.dt BETWEEN DATE '2024-01-21' AND DATE '2024-01-30' GROUP BY b.dt, b.customer_id, b.cma_id"""),
    ("lens", "SELECT dt, customer_id, LEAST(10, COUNT(*)) AS len FROM sp GROUP BY dt, customer_id"),
    ("base", """SELECT d.dt, d.customer_id, d.cma_id, d.impressions, d.clicks, d.sales,
                   CAST(COALESCE(t.pos, l.len + 1) AS INTEGER) AS rank
                FROM daily d JOIN lens l ON l.dt + 1 = d.dt AND l.customer_id = d.customer_id
                LEFT JOIN tk t ON t.dt + 1 = d.dt AND t.customer_id = d.customer_id AND t.category_id = d.cma_id
                              AND t.pos <= 10"""),
    ("fac", """SELECT cma_id, CAST(SUM(impressions) AS BIGINT) AS impressions_total,
                  CAST(SUM(clicks) AS BIGINT) AS clicks_total FROM base GROUP BY cma_id"""),
    ("fac2", """SELECT *, impressions_total / SUM(impressions_total) OVER () AS ratio,
                   clicks_total / NULLIF(CAST(impressions_total AS DOUBLE), 0) AS ctr FROM fac"""),
    ("fac3", "SELECT *, ctr / NULLIF(ratio, 0) AS factor FROM fac2"),
]

V_BASE = ["banner_events", "category_map"]

AB_CTES = [
    ("ab", """SELECT b.customer_id, b.banner_id, b.dt, b.cma_id, b.impressions, b.banner_clicks, b.icon_clicks, b.sales,
                b.gmv, e.experiment_group_name, m.category_name
              FROM banner_events b JOIN experiment e ON b.customer_id = e.customer_id AND b.banner_id = e.banner_id
                AND b.dt = e.dt AND b.cma_id = e.cma_id JOIN category_map m ON b.cma_id = m.cma_id"""),
    ("abm", """SELECT category_name, cma_id, dt, experiment_group_name,
                 CAST(SUM(impressions) AS BIGINT) AS impressions_total, CAST(SUM(banner_clicks) AS BIGINT) AS clicks_total,
                 CAST(SUM(sales) AS BIGINT) AS category_sales_total, SUM(gmv) AS category_gmv_total
               FROM ab GROUP BY category_name, cma_id, dt, experiment_group_name"""),
    ("abm2", """SELECT *, clicks_total / NULLIF(CAST(impressions_total AS DOUBLE), 0) AS ctr,
                  category_sales_total / NULLIF(CAST(impressions_total AS DOUBLE), 0) AS cvr,
                  category_gmv_total / NULLIF(CAST(impressions_total AS DOUBLE), 0) AS gmv_per_impression,
                  category_gmv_total / NULLIF(CAST(clicks_total AS DOUBLE), 0) AS gmv_per_click FROM abm"""),
    ("abs", """SELECT *,
                 impressions_total / NULLIF(CAST(SUM(impressions_total) OVER (PARTITION BY dt, experiment_group_name) AS DOUBLE), 0)
                   AS impression_ratio,
                 clicks_total / NULLIF(CAST(SUM(clicks_total) OVER (PARTITION BY dt, experiment_group_name) AS DOUBLE), 0)
                   AS clicks_ratio FROM abm2"""),
    ("valid", "SELECT DISTINCT dt, cma_id FROM banner_events WHERE sales > 0"),
    ("absv", """SELECT a.*, v.cma_id AS sale_category_id FROM abs a LEFT JOIN valid v ON a.dt = v.dt AND a.cma_id = v.cma_id"""),
]

AB_METRICS = ["impressions_total", "clicks_total", "category_sales_total", "category_gmv_total", "ctr", "cvr",
              "gmv_per_impression", "gmv_per_click", "impression_ratio", "clicks_ratio"]
DBL = {"category_gmv_total", "ctr", "cvr", "gmv_per_impression", "gmv_per_click", "impression_ratio", "clicks_ratio"}


def _side(alias, suffix, with_id=True):
    cols = [f"{alias}.category_name AS category_name{suffix}", f"{alias}.sale_category_id AS sale_category_id{suffix}"]
    if with_id:
        cols.append(f"{alias}.cma_id AS cma_id{suffix}")
    for m in AB_METRICS:
        cols.append(f"round({alias}.{m}, 6) AS {m}{suffix}" if m in DBL else f"{alias}.{m} AS {m}{suffix}")
    return ", ".join(cols)


ORACLE = {
    "latest_snapshot": with_views(["banner_events"], """
        SELECT customer_id, dt, cma_id, banner_id, impressions, banner_clicks, icon_clicks, sales, round(gmv, 4) AS gmv
        FROM banner_events WHERE dt = (SELECT MAX(dt) FROM banner_events)"""),
    "banner_customer_category": with_views(V_BASE, "SELECT * FROM daily", BASE_CTES),
    "banner_rank_base": with_views(V_BASE, "SELECT * FROM base", BASE_CTES),
    "ctr_by_category_rank": with_views(V_BASE, """
        SELECT cma_id, rank, impressions_total, clicks_total, category_sales_total,
               round(clicks_total / NULLIF(CAST(impressions_total AS DOUBLE), 0), 6) AS ctr,
               round(category_sales_total / NULLIF(CAST(impressions_total AS DOUBLE), 0), 6) AS cvr,
               round(category_sales_total / NULLIF(CAST(clicks_total AS DOUBLE), 0), 6) AS cvr_click,
               round(impressions_total / NULLIF(CAST(SUM(impressions_total) OVER (PARTITION BY cma_id) AS DOUBLE), 0), 6)
                 AS impression_rate
        FROM (SELECT cma_id, rank, CAST(SUM(impressions) AS BIGINT) AS impressions_total,
                     CAST(SUM(clicks) AS BIGINT) AS clicks_total, CAST(SUM(sales) AS BIGINT) AS category_sales_total
              FROM base GROUP BY cma_id, rank) t""", BASE_CTES),
    "ctr_by_rank": with_views(V_BASE, """
        SELECT rank, impressions_total, clicks_total,
               round(clicks_total / NULLIF(CAST(impressions_total AS DOUBLE), 0), 6) AS ctra,
               round(impressions_total / NULLIF(CAST(SUM(impressions_total) OVER () AS DOUBLE), 0), 6) AS impression_rate
        FROM (SELECT rank, CAST(SUM(impressions) AS BIGINT) AS impressions_total,
                     CAST(SUM(clicks) AS BIGINT) AS clicks_total FROM base GROUP BY rank) t""", BASE_CTES),
    "impression_click_gap": with_views(V_BASE, """
        SELECT cma_id, rank, round(AVG(impressions - clicks), 6) AS avg_diff FROM base GROUP BY cma_id, rank""",
        BASE_CTES),
    "category_factor": with_views(V_BASE, """
        SELECT cma_id, impressions_total, clicks_total, round(ratio, 6) AS ratio, round(ctr, 6) AS ctr,
               round(factor, 6) AS factor FROM fac3""", BASE_CTES),
    "factor_decile": with_views(V_BASE, """
        SELECT cma_id, round(factor, 6) AS factor,
               CASE WHEN factor IS NULL THEN NULL ELSE
                 CAST((SELECT COUNT(*) FROM e WHERE e.v <= fac3.factor) AS INTEGER) END AS result
        FROM fac3""", BASE_CTES + [("e", """SELECT DISTINCT UNNEST(quantile_disc(factor,
                [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS v FROM fac3""")]),
    "factor_deciles": with_views(V_BASE, """
        SELECT round(UNNEST([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]), 6) AS q,
               round(UNNEST(quantile_disc(factor, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])), 6) AS value
        FROM fac3""", BASE_CTES),
    "ab_event_base": with_views(V_BASE + ["experiment"], """
        SELECT cma_id, customer_id, banner_id, dt, impressions, banner_clicks, icon_clicks, sales, round(gmv, 4) AS gmv,
               experiment_group_name, category_name FROM ab""", AB_CTES),
    "ab_affected_base": with_views(V_BASE + ["experiment"], """
        SELECT cma_id, customer_id, banner_id, dt, impressions, banner_clicks, icon_clicks, sales, round(gmv, 4) AS gmv,
               experiment_group_name, category_name FROM ab
        WHERE customer_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""", AB_CTES),
    "ab_category_metrics": with_views(V_BASE + ["experiment"], """
        SELECT category_name, cma_id, dt, experiment_group_name, impressions_total, clicks_total, category_sales_total,
               round(category_gmv_total, 6) AS category_gmv_total, round(ctr, 6) AS ctr, round(cvr, 6) AS cvr,
               round(gmv_per_impression, 6) AS gmv_per_impression, round(gmv_per_click, 6) AS gmv_per_click
        FROM abm2""", AB_CTES),
    "ab_comparison": with_views(V_BASE + ["experiment"], f"""
        SELECT COALESCE(r.dt, t.dt) AS dt, {_side('r', '_raw')}, {_side('t', '_rt', with_id=False)}
        FROM (SELECT * FROM absv WHERE experiment_group_name = 'raw') r
        FULL OUTER JOIN (SELECT * FROM absv WHERE experiment_group_name = 'rt') t
          ON r.dt = t.dt AND r.category_name = t.category_name""", AB_CTES),
    "ab_entropy": with_views(V_BASE + ["experiment"], """
        SELECT dt, experiment_group_name,
               round(SUM(CASE WHEN impression_ratio > 0 THEN -impression_ratio * ln(impression_ratio) ELSE 0.0 END), 6)
                 AS impression_entropy,
               round(SUM(CASE WHEN clicks_ratio > 0 THEN -clicks_ratio * ln(clicks_ratio) ELSE 0.0 END), 6)
                 AS clicks_entropy
        FROM abs GROUP BY dt, experiment_group_name""", AB_CTES),
    "topk_allocation": with_views(["banner_events"], """
        SELECT dt, COUNT(*) AS n_customers, '5' AS category_id, 2 AS k FROM tk
        WHERE category_id = '5' AND pos <= 2 GROUP BY dt""", snapshot_ctes("2024-01-20", "2024-01-26")),
}
