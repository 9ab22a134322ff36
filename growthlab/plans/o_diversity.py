"""Oracle SQL for diversity, sequence and agreement queries."""

from __future__ import annotations

from growthlab.plans.views_sql import with_views

V = ["topk_long", "category_map"]

DV_CTES = [
    ("cnt", """SELECT category_id AS top_cat, CAST(pos AS INTEGER) AS rank, COUNT(*) AS total_model_rec_cnt
               FROM topk_long WHERE pos <= 6 GROUP BY category_id, pos"""),
    ("cum", """SELECT *, SUM(total_model_rec_cnt) OVER (PARTITION BY top_cat ORDER BY rank
                 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS crc FROM cnt"""),
    ("sh", """SELECT rank AS k, top_cat, CAST(crc AS BIGINT) AS category_rec_count,
                crc / SUM(crc) OVER (PARTITION BY rank) AS percentage FROM cum"""),
]

SEQ_CTES = [
    ("seq", """SELECT customer_id, ROW_NUMBER() OVER (PARTITION BY customer_id
                 ORDER BY dt, CAST(cma_id AS INTEGER), banner_id) AS seq_pos, cma_id
               FROM banner_events WHERE banner_clicks + icon_clicks + sales > 0"""),
    ("bg", """SELECT a.customer_id, a.seq_pos, a.cma_id AS pre, b.cma_id AS nxt FROM seq a
              JOIN seq b ON a.customer_id = b.customer_id AND b.seq_pos = a.seq_pos + 1"""),
]

RK_CTES = [
    ("cats", "SELECT CAST(UNNEST(range(1, 13)) AS VARCHAR) AS c, UNNEST(range(1, 13)) AS e"),
    ("custs", "SELECT DISTINCT customer_id FROM scores_long"),
    ("rk", """SELECT cu.customer_id, ca.e, COALESCE(t.pos, 13) AS x FROM custs cu CROSS JOIN cats ca
              LEFT JOIN topk_long t ON t.customer_id = cu.customer_id AND t.category_id = ca.c"""),
    ("pairs", """SELECT a.customer_id, SUM(sign(a.x - b.x) * sign(a.e - b.e)) AS s,
                   SUM(CASE WHEN a.x = b.x THEN 1 ELSE 0 END) AS tx
                 FROM rk a JOIN rk b ON a.customer_id = b.customer_id AND a.e < b.e GROUP BY a.customer_id"""),
    ("tau", """SELECT customer_id, CASE WHEN tx = 66 THEN NULL ELSE s / sqrt((66.0 - tx) * 66.0) END AS tau FROM pairs"""),
]

SHARE_CTES = [
    ("srows", """SELECT customer_id, cma_id FROM banner_events
                 WHERE sales > 0 AND dt BETWEEN DATE '2024-01-21' AND DATE '2024-01-30'"""),
    ("strat", "SELECT DISTINCT customer_id, final_serving_strategy FROM experiment"),
    ("served", """SELECT t.customer_id, t.category_id AS cma_id, s.final_serving_strategy FROM topk_long t
                  JOIN strat s ON t.customer_id = s.customer_id JOIN category_map m ON t.category_id = m.cma_id
                  WHERE t.pos <= 6"""),
    ("pc", """SELECT cma_id, COUNT(*) AS cnt FROM served WHERE final_serving_strategy = 'autopilot' GROUP BY cma_id"""),
    ("sc", """SELECT s.cma_id, COUNT(*) AS cnt FROM srows s JOIN category_map m ON s.cma_id = m.cma_id GROUP BY s.cma_id"""),
    ("sr", "SELECT cma_id, cnt AS test_count, ROW_NUMBER() OVER (ORDER BY cnt DESC, cma_id) AS rs FROM sc"),
    ("pr", "SELECT cma_id, cnt AS pred_count, ROW_NUMBER() OVER (ORDER BY cnt DESC, cma_id) AS rp FROM pc"),
    ("cut", """SELECT CAST(i AS DOUBLE) / 10.0 * 100.0 AS top_percent_category,
                 GREATEST(CAST(FLOOR((SELECT COUNT(*) FROM sc) * (CAST(i AS DOUBLE) / 10.0)) AS BIGINT) - 1, 0) AS c
               FROM (SELECT UNNEST(range(1, 11)) AS i) t"""),
    ("jn", """SELECT cut.top_percent_category, sr.cma_id, sr.rs, sr.test_count, COALESCE(p.pred_count, 0) AS pred_count
              FROM cut JOIN sr ON sr.rs <= cut.c
              LEFT JOIN pr p ON p.cma_id = sr.cma_id AND p.rp <= cut.c"""),
    ("kp", """SELECT a.top_percent_category, SUM(sign(a.pred_count - b.pred_count) * sign(a.test_count - b.test_count)) AS s,
                 SUM(CASE WHEN a.pred_count = b.pred_count THEN 1 ELSE 0 END) AS tx,
                 SUM(CASE WHEN a.test_count = b.test_count THEN 1 ELSE 0 END) AS ty, COUNT(*) AS n0
              FROM jn a JOIN jn b ON a.top_percent_category = b.top_percent_category AND a.rs < b.rs
              GROUP BY a.top_percent_category"""),
    ("jac", """SELECT cut.top_percent_category,
                 (SELECT COUNT(*) FROM sr JOIN pr ON sr.cma_id = pr.cma_id WHERE sr.rs <= cut.c AND pr.rp <= cut.c) AS i,
                 (SELECT COUNT(*) FROM (SELECT cma_id FROM sr WHERE rs <= cut.c UNION SELECT cma_id FROM pr WHERE rp <= cut.c) u)
                   AS u
               FROM cut"""),
]

ORACLE = {
    "topk_category_counts": with_views(V, "SELECT * FROM cnt", DV_CTES),
    "topk_cumulative_share": with_views(V, """
        SELECT sh.k, sh.top_cat, sh.category_rec_count, round(sh.percentage, 6) AS percentage, m.category_name
        FROM sh LEFT JOIN category_map m ON sh.top_cat = m.cma_id""", DV_CTES),
    "category_coverage": with_views(V, """
        SELECT k, round((SELECT COUNT(DISTINCT category_id) FROM topk_long
                         WHERE pos <= k AND category_id IN (SELECT cma_id FROM category_map))
                        / CAST((SELECT COUNT(*) FROM category_map) AS DOUBLE), 6) AS coverage
        FROM (SELECT UNNEST(range(1, 7)) AS k) ks""".replace("UNNEST(range(1, 7))", "CAST(UNNEST(range(1, 7)) AS INTEGER)")),
    "topk_entropy": with_views(V, """
        SELECT k, round(-SUM(CASE WHEN percentage > 0 THEN percentage * ln(percentage) ELSE 0 END), 6) AS entropy
        FROM sh GROUP BY k""", DV_CTES),
    "topk_gini": with_views(V, """
        SELECT k, round(CASE WHEN COUNT(*) > 1 THEN SUM((2 * j - n - 1) * percentage) / (n - 1.0) END, 6) AS gini
        FROM (SELECT k, percentage, ROW_NUMBER() OVER (PARTITION BY k ORDER BY percentage, top_cat) AS j,
                     COUNT(*) OVER (PARTITION BY k) AS n FROM sh) t GROUP BY k, n""", DV_CTES),
    "category_sequence": with_views(["banner_events"], "SELECT * FROM seq", SEQ_CTES),
    "category_bigrams": with_views(["banner_events"], "SELECT * FROM bg", SEQ_CTES),
    "next_category_share": with_views(["banner_events"], """
        SELECT pre, nxt, COUNT(*) AS "count", round(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY pre), 6) AS share
        FROM bg GROUP BY pre, nxt""", SEQ_CTES),
    "repeat_share": with_views(["banner_events"], """
        SELECT pre, COUNT(*) AS n_bigrams, round(AVG(CASE WHEN nxt = pre THEN 1.0 ELSE 0.0 END), 6) AS repeat_share
        FROM bg GROUP BY pre""", SEQ_CTES),
    "kendall_per_customer": with_views(["topk_long"], "SELECT customer_id, round(tau, 6) AS tau FROM tau", RK_CTES),
    "kendall_quantiles": with_views(["topk_long"], """
        SELECT round(UNNEST([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99]::DOUBLE[]), 6) AS q,
               round(UNNEST(quantile_disc(tau, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99])), 6) AS value
        FROM tau""", RK_CTES),
    "category_sales_share": with_views(["banner_events", "category_map"], """
        SELECT s.cma_id, COUNT(*) AS "count", round(round(COUNT(*) / CAST((SELECT COUNT(*) FROM srows) AS DOUBLE), 6), 6)
                 AS percent, m.category_name
        FROM srows s JOIN category_map m ON s.cma_id = m.cma_id GROUP BY s.cma_id, m.category_name""",
        SHARE_CTES[:1]),
    "strategy_category_share": with_views(["topk_long", "category_map", "experiment"], """
        SELECT s.final_serving_strategy, s.cma_id, COUNT(*) AS "count",
               round(COUNT(*) / CAST(t.n AS DOUBLE), 6) AS percent, m.category_name
        FROM served s JOIN (SELECT final_serving_strategy, COUNT(*) AS n FROM served GROUP BY 1) t
          ON s.final_serving_strategy = t.final_serving_strategy
        JOIN category_map m ON s.cma_id = m.cma_id
        GROUP BY s.final_serving_strategy, s.cma_id, t.n, m.category_name""", SHARE_CTES),
    "topk_agreement": with_views(["topk_long", "category_map", "experiment"], """
        SELECT cut.top_percent_category,
               round(CASE WHEN kp.n0 IS NULL OR (kp.n0 - kp.tx) * (kp.n0 - kp.ty) = 0 THEN NULL
                          ELSE kp.s / sqrt((kp.n0 - kp.tx) * (kp.n0 - kp.ty)) END, 6) AS kendall,
               round(CASE WHEN jac.u = 0 THEN NULL ELSE jac.i / CAST(jac.u AS DOUBLE) END, 6) AS jc_similarity
        FROM cut LEFT JOIN kp ON cut.top_percent_category = kp.top_percent_category
        JOIN jac ON cut.top_percent_category = jac.top_percent_category""", SHARE_CTES),
}
