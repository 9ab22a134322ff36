"""Oracle SQL for RFM and distribution queries."""

from __future__ import annotations

from growthlab.plans.views_sql import with_views

U = "CAST(round(selling_price * 10000.0) AS BIGINT)"

RFM_CTES = [
    ("types", "SELECT customer_id, MIN(scheduler) AS type FROM push_campaigns GROUP BY customer_id"),
    ("r0", f"""SELECT customer_id, COUNT(DISTINCT dt) AS frequency,
                  CAST(date_diff('day', MAX(dt), DATE '2001-01-01') AS INTEGER) AS recency,
                  (CAST(SUM({U}) AS DOUBLE) / COUNT(*)) / 10000.0 AS monetary_value,
                  CAST(SUM({U}) AS DOUBLE) / 10000.0 AS total_value
               FROM sales WHERE dt BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
                 AND customer_id IN (SELECT customer_id FROM types) GROUP BY customer_id"""),
    ("r1", "SELECT * FROM r0 WHERE frequency < (SELECT quantile_disc(frequency, 0.99) FROM r0)"),
    ("r2", "SELECT * FROM r1 WHERE total_value < (SELECT quantile_disc(total_value, 0.99) FROM r1)"),
    ("rfm", "SELECT r2.*, types.type FROM r2 JOIN types ON r2.customer_id = types.customer_id"),
]


def _edges(fn, col):
    return f"SELECT DISTINCT UNNEST({fn}(CAST({col} AS DOUBLE), [0.25, 0.5, 0.75])) AS e FROM rfm"


QS_CTES = RFM_CTES + [
    ("eR", _edges("quantile_disc", "recency")), ("eF", _edges("quantile_disc", "frequency")),
    ("eM", _edges("quantile_disc", "total_value")),
    ("qs", """SELECT rfm.*,
          CAST(4 - (SELECT COUNT(*) FROM eR WHERE e <= rfm.recency) AS INTEGER) AS R,
          CAST(1 + (SELECT COUNT(*) FROM eF WHERE e <= rfm.frequency) AS INTEGER) AS F,
          CAST(1 + (SELECT COUNT(*) FROM eM WHERE e <= rfm.total_value) AS INTEGER) AS M FROM rfm"""),
    ("qs2", "SELECT *, R + F + M AS rfm FROM qs"),
]

QC_CTES = RFM_CTES + [
    ("eR", _edges("quantile_cont", "recency")), ("eF", _edges("quantile_cont", "frequency")),
    ("eM", _edges("quantile_cont", "total_value")),
    ("qc", """SELECT rfm.*,
          CAST(4 - (SELECT COUNT(*) FROM eR WHERE e < rfm.recency) AS INTEGER) AS R,
          CAST(1 + (SELECT COUNT(*) FROM eF WHERE e < rfm.frequency) AS INTEGER) AS F,
          CAST(1 + (SELECT COUNT(*) FROM eM WHERE e < rfm.total_value) AS INTEGER) AS M FROM rfm"""),
]

RFM_COLS = ("customer_id, frequency, recency, round(monetary_value, 4) AS monetary_value, "
            "round(total_value, 4) AS total_value, type")


def _desc(col, src="rfm", by=None):
    b = f"{by}, " if by else ""
    g = f" GROUP BY {by}" if by else ""
    return (f"SELECT {b}'{col}' AS \"column\", COUNT({col}) AS \"count\", round(AVG({col}), 4) AS mean, "
            f"round(STDDEV_SAMP({col}), 4) AS std, round(CAST(MIN({col}) AS DOUBLE), 4) AS \"min\", "
            + "".join(f"round(CAST(quantile_disc({col}, {q / 100}) AS DOUBLE), 4) AS p{q}, " for q in (25, 50, 75)) +
            f"round(CAST(MAX({col}) AS DOUBLE), 4) AS \"max\" FROM {src}{g}")


CLASSIC = "(SELECT * FROM push_campaigns WHERE scheduler = 'classic')"

CAMP = f"""SELECT campaign_id, COUNT(DISTINCT customer_id) AS "count" FROM {CLASSIC} c GROUP BY campaign_id"""
PHASE = f"""SELECT md.phase_id, COUNT(c.customer_id) AS "count" FROM {CLASSIC} c
            JOIN campaign_metadata md ON c.campaign_id = md.campaign_id GROUP BY md.phase_id"""

ORACLE = {
    "campaign_names": with_views(["push_campaigns", "campaign_metadata"], """
        SELECT DISTINCT campaign_id, campaign_name FROM campaign_metadata
        WHERE campaign_id IN (SELECT campaign_id FROM push_campaigns)"""),
    "rfm": with_views(["sales", "push_campaigns"], f"SELECT {RFM_COLS} FROM rfm", RFM_CTES),
    "rfm_summary": with_views(["sales", "push_campaigns"], " UNION ALL ".join(
        _desc(c) for c in ("frequency", "recency", "total_value")), RFM_CTES),
    "rfm_quantile_score": with_views(["sales", "push_campaigns"],
                                     f"SELECT {RFM_COLS}, R, F, M, rfm FROM qs2", QS_CTES),
    "rfm_qcut_score": with_views(["sales", "push_campaigns"], f"""
        SELECT {RFM_COLS}, R, F, M, CAST(CAST(R AS VARCHAR) || CAST(F AS VARCHAR) || CAST(M AS VARCHAR) AS INTEGER) AS rfm,
               R + F + M AS rfm_score FROM qc""", QC_CTES),
    "rfm_by_type": with_views(["sales", "push_campaigns"], _desc("rfm", "qs2", "type"), QS_CTES),
    "campaign_user_share": with_views(["push_campaigns"], f"""
        SELECT campaign_id, "count", round("count" / SUM("count") OVER (), 6) AS p FROM ({CAMP}) t"""),
    "phase_user_share": with_views(["push_campaigns", "campaign_metadata"], f"""
        SELECT phase_id, "count", round("count" / SUM("count") OVER (), 6) AS p FROM ({PHASE}) t"""),
    "share_entropy": with_views(["push_campaigns", "campaign_metadata"], f"""
        SELECT dimension, COUNT(*) AS n, round(-SUM(p * ln(p)), 6) AS entropy FROM (
          SELECT 'campaign' AS dimension, "count" / SUM("count") OVER () AS p FROM ({CAMP}) a
          UNION ALL
          SELECT 'phase' AS dimension, "count" / SUM("count") OVER () AS p FROM ({PHASE}) b) t
        GROUP BY dimension"""),
    "phase_validation_anti": with_views(["push_campaigns", "campaign_metadata", "customer_phases"], """
        SELECT DISTINCT pc.customer_id, md.phase_id FROM push_campaigns pc
        JOIN campaign_metadata md ON pc.campaign_id = md.campaign_id
        WHERE pc.scheduler = 'model'
          AND NOT EXISTS (SELECT 1 FROM customer_phases cp
                          WHERE cp.customer_id = pc.customer_id AND cp.phase_id = md.phase_id)"""),
    "interaction_rates": with_views(["banner_events"], """
        SELECT COUNT(banner_clicks) AS total, CAST(SUM(banner_clicks) AS BIGINT) AS clicks,
               round(SUM(banner_clicks) / CAST(COUNT(banner_clicks) AS DOUBLE), 6) AS click_rate,
               CAST(SUM(sales) AS BIGINT) AS sales_count,
               round(SUM(sales) / CAST(COUNT(sales) AS DOUBLE), 6) AS sales_rate
        FROM banner_events"""),
}
