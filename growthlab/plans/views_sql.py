"""The canonical fixture views as DuckDB SQL (FIXTURES.md §2), used by the
oracle statements.  ``with_views`` prepends the needed views as CTEs."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "sales": ((), """
        SELECT o.o_custkey AS customer_id, p.p_brand AS category_id, CAST(o.o_orderdate AS DATE) AS dt,
               l.l_extendedprice * (1 - l.l_discount) AS selling_price
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey"""),
    "banner_events": ((), """
        SELECT user_id AS customer_id, CAST(ts AS DATE) AS dt, CAST(k % 12 + 1 AS VARCHAR) AS cma_id,
               CAST(k % 30 + 1 AS VARCHAR) AS banner_id,
               CAST(SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS impressions,
               CAST(SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS banner_clicks,
               CAST(SUM(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS icon_clicks,
               CAST(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS sales,
               SUM(CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END) AS gmv
        FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events) e GROUP BY 1, 2, 3, 4"""),
    "category_map": ((), """
        SELECT CAST(n_nationkey + 1 AS VARCHAR) AS cma_id, n_name AS category_name FROM nation"""),
    "scores_long": (("banner_events",), """
        SELECT customer_id, cma_id AS category_id,
               COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY customer_id) AS probability
        FROM banner_events WHERE dt <= DATE '2024-01-20' GROUP BY customer_id, cma_id"""),
    "push_campaigns": ((), """
        SELECT DISTINCT l.l_suppkey AS campaign_id, o.o_custkey AS customer_id,
               CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'classic' ELSE 'model' END AS scheduler
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""),
    "campaign_metadata": ((), """
        SELECT s.s_suppkey AS campaign_id, s.s_name AS campaign_name, n.n_regionkey AS phase_id, r.r_name AS phase_name
        FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""),
    "experiment": (("banner_events",), """
        SELECT DISTINCT customer_id, banner_id, dt, cma_id,
               CASE WHEN customer_id % 2 = 0 THEN 'raw' ELSE 'rt' END AS experiment_group_name,
               CASE WHEN customer_id % 3 = 0 THEN 'manual' ELSE 'autopilot' END AS final_serving_strategy
        FROM banner_events"""),
    "customer_phases": (("push_campaigns", "campaign_metadata"), """
        SELECT DISTINCT pc.customer_id, md.phase_id FROM push_campaigns pc
        JOIN campaign_metadata md ON pc.campaign_id = md.campaign_id WHERE pc.scheduler = 'classic'"""),
    # top-k (k=6) by probability desc, category asc: long form with 1-based position
    "topk_long": (("scores_long",), """
        SELECT customer_id, category_id, probability,
               ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY probability DESC, category_id ASC) AS pos
        FROM scores_long"""),
    # actual sales after the score day
    "actual": (("banner_events",), """
        SELECT customer_id, cma_id, dt, sales FROM banner_events
        WHERE sales > 0 AND dt BETWEEN DATE '2024-01-21' AND DATE '2024-01-30'"""),
}


def _order(names):
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in VIEWS[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(names, body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH <views...>, <extra...> <body>``."""
    parts = [f"{n} AS ({VIEWS[n][1]}\n)" for n in _order(names)]
    for n, q in extra or []:
        parts.append(f"{n} AS ({q}\n)")
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
