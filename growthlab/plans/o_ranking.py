"""Oracle SQL for top-k and ranking-metric queries."""

from __future__ import annotations

from growthlab.plans.o_ctr import snapshot_ctes
from growthlab.plans.views_sql import with_views

V = ["topk_long", "actual"]

COMMON = [
    ("tk6", "SELECT customer_id, category_id AS cma_id, probability AS prob, pos FROM topk_long WHERE pos <= 6"),
    ("tkd", """SELECT customer_id, category_id AS cma_id, ROW_NUMBER() OVER (PARTITION BY customer_id
                 ORDER BY probability DESC, category_id DESC) AS pos FROM scores_long"""),
    ("lab", "SELECT DISTINCT customer_id, cma_id FROM actual"),
]


def _hit_ctes(tk):
    return [
        (f"r_{tk}", f"""SELECT l.customer_id, l.cma_id, CAST(COALESCE(t.pos, 999999) AS INTEGER) AS rank FROM lab l
                  LEFT JOIN (SELECT * FROM {tk} WHERE pos <= 6) t ON l.customer_id = t.customer_id AND l.cma_id = t.cma_id
                  WHERE l.customer_id IN (SELECT customer_id FROM {tk})"""),
        (f"cnt_{tk}", f"""SELECT customer_id, COUNT(DISTINCT cma_id) AS count_cat FROM r_{tk}
                    WHERE cma_id IN (SELECT cma_id FROM {tk} WHERE pos <= 6) GROUP BY customer_id"""),
        (f"h_{tk}", f"""SELECT r.customer_id, k, COUNT(DISTINCT CASE WHEN rank <= k THEN cma_id END) AS count_cat_les_k_rank
                  FROM r_{tk} r, (SELECT UNNEST([1, 2, 3, 4, 5, 6]) AS k) ks GROUP BY r.customer_id, k"""),
        (f"hr_{tk}", f"""SELECT h.customer_id, k, count_cat_les_k_rank,
                    CASE WHEN count_cat_les_k_rank > 0 THEN 1 ELSE 0 END AS hit_rate, count_cat,
                    count_cat_les_k_rank / CAST(count_cat AS DOUBLE) AS recall
                  FROM h_{tk} h JOIN cnt_{tk} c ON h.customer_id = c.customer_id"""),
    ]


LIST_CTES = COMMON + [
    ("labn", "SELECT customer_id, COUNT(*) AS nl FROM lab GROUP BY customer_id"),
    ("predn", "SELECT customer_id, COUNT(*) AS np FROM tk6 GROUP BY customer_id"),
    ("cust", "SELECT p.customer_id, np, nl FROM predn p JOIN labn l ON p.customer_id = l.customer_id"),
    ("hitpos", """SELECT t.customer_id, t.pos, ROW_NUMBER() OVER (PARTITION BY t.customer_id ORDER BY t.pos) AS h
                  FROM tk6 t JOIN lab l ON t.customer_id = l.customer_id AND t.cma_id = l.cma_id
                  WHERE t.customer_id IN (SELECT customer_id FROM cust)"""),
    ("ks", "SELECT UNNEST([1, 2, 3, 4]) AS k"),
    ("idx", "SELECT UNNEST(range(1, (SELECT CAST(MAX(GREATEST(np, nl)) + 1 AS BIGINT) FROM cust))) AS j"),
    ("per", """SELECT c.customer_id, k, np, nl, LEAST(GREATEST(np, nl), k) AS n FROM cust c, ks"""),
    ("prec", """SELECT per.customer_id, k,
                  (SELECT COUNT(*) FROM hitpos h WHERE h.customer_id = per.customer_id AND h.pos <= k)
                    / CAST(LEAST(np, k) AS DOUBLE) AS p,
                  COALESCE((SELECT SUM(1.0 / ln(h.pos + 1.0)) FROM hitpos h WHERE h.customer_id = per.customer_id
                            AND h.pos <= n), 0.0)
                    / (SELECT SUM(1.0 / ln(j + 1.0)) FROM idx WHERE j <= LEAST(n, nl)) AS g
                FROM per"""),
    ("ap", """SELECT c.customer_id, COALESCE((SELECT SUM(h.h / CAST(h.pos AS DOUBLE)) FROM hitpos h
                                           WHERE h.customer_id = c.customer_id), 0.0) / nl AS ap FROM cust c"""),
    ("metrics", """SELECT k, AVG(p) AS precision_at_k, AVG(g) AS ndcg_at_k,
                     (SELECT AVG(ap) FROM ap) AS mean_avg_precision FROM prec GROUP BY k"""),
]

PU_CTES = COMMON + [
    ("mcat", "SELECT DISTINCT category_id AS cma_id FROM scores_long"),
    ("rel", "SELECT DISTINCT customer_id FROM actual WHERE cma_id IN (SELECT cma_id FROM mcat)"),
    ("labr", "SELECT * FROM lab WHERE customer_id IN (SELECT customer_id FROM rel)"),
    ("labn", "SELECT customer_id, CAST(COUNT(*) AS INTEGER) AS relevant_cat_cnt FROM labr GROUP BY customer_id"),
    ("pu", """SELECT l.customer_id, k, l.relevant_cat_cnt,
                CAST((SELECT COUNT(*) FROM tk6 t JOIN labr x ON t.customer_id = x.customer_id AND t.cma_id = x.cma_id
                      WHERE t.customer_id = l.customer_id AND t.pos <= k) AS INTEGER) AS cnt_pred_lab_k,
                (SELECT COUNT(*) - COUNT(DISTINCT t.cma_id) FROM tk6 t WHERE t.customer_id = l.customer_id) AS n_dup
              FROM labn l, (SELECT UNNEST([1, 2, 3, 4, 5, 6]) AS k) ks"""),
    ("pu2", """SELECT *, cnt_pred_lab_k / CAST(k AS DOUBLE) AS perc_pred_lab_k,
                 CASE WHEN relevant_cat_cnt > 0 THEN cnt_pred_lab_k / CAST(relevant_cat_cnt AS DOUBLE) ELSE 1.0 END
                   AS recall_pred_lab_k FROM pu"""),
    ("prk", """SELECT k, AVG(perc_pred_lab_k) AS precision_at_k, AVG(recall_pred_lab_k) AS recall_at_k,
                 CAST(SUM(n_dup) AS BIGINT) AS dup_pred_category_at_k, CAST(SUM(relevant_cat_cnt) AS BIGINT) AS num_label_at_k
               FROM pu2 GROUP BY k"""),
]


def rolling_ctes():
    return snapshot_ctes("2024-01-20", "2024-01-26") + [
        ("rs", """SELECT customer_id, cma_id, dt - 1 AS dt FROM banner_events
                  WHERE sales > 0 AND dt BETWEEN DATE '2024-01-21' AND DATE '2024-01-27'"""),
        ("mcat", "SELECT DISTINCT dt, category_id AS cma_id FROM sp"),
        ("rlab", """SELECT DISTINCT r.dt, r.customer_id, r.cma_id FROM rs r
                    WHERE EXISTS (SELECT 1 FROM rs r2 JOIN mcat m ON r2.dt = m.dt AND r2.cma_id = m.cma_id
                                  WHERE r2.dt = r.dt AND r2.customer_id = r.customer_id)"""),
        ("rlabn", "SELECT dt, customer_id, COUNT(*) AS nl FROM rlab GROUP BY dt, customer_id"),
        ("rpu", """SELECT l.dt, l.customer_id, k, l.nl,
                    (SELECT COUNT(*) FROM tk t JOIN rlab x ON t.dt = x.dt AND t.customer_id = x.customer_id
                       AND t.category_id = x.cma_id
                     WHERE t.dt = l.dt AND t.customer_id = l.customer_id AND t.pos <= k) AS c
                  FROM rlabn l, (SELECT UNNEST([1, 2, 3, 4, 5, 6]) AS k) ks"""),
        ("rday", """SELECT dt, k, AVG(c / CAST(k AS DOUBLE)) AS p, AVG(c / CAST(nl AS DOUBLE)) AS r
                    FROM rpu GROUP BY dt, k"""),
    ]


ORACLE = {
    "top_n_stable": with_views(["topk_long"], """
        SELECT customer_id, string_agg(category_id, ',' ORDER BY pos) AS topn FROM topk_long WHERE pos <= 10
        GROUP BY customer_id"""),
    "topk_user_categories": with_views(["topk_long"], """
        SELECT customer_id, CAST(pos AS INTEGER) AS rank, category_id AS cma_id, round(probability, 6) AS prob
        FROM topk_long WHERE pos <= 6"""),
    "topk_desc_ties": with_views(["scores_long"], """
        SELECT customer_id, string_agg(cma_id, ',' ORDER BY pos) AS predicted_top_category FROM tkd WHERE pos <= 6
        GROUP BY customer_id""", [COMMON[1]]),
    "sales_category_rank": with_views(V, "SELECT * FROM r_tk6", COMMON + _hit_ctes("tk6")[:1]),
    "hit_recall_per_customer": with_views(V, """
        SELECT customer_id, CAST(k AS INTEGER) AS k, count_cat_les_k_rank, hit_rate, count_cat, round(recall, 6) AS recall
        FROM hr_tk6""", COMMON + _hit_ctes("tk6")),
    "hit_recall_at_k": with_views(V, """
        SELECT CAST(k AS INTEGER) AS k, round(AVG(hit_rate), 6) AS hit_rate_at_k, round(AVG(recall), 6) AS recall_at_k
        FROM hr_tk6 GROUP BY k""", COMMON + _hit_ctes("tk6")),
    "hit_recall_by_model": with_views(V, """
        SELECT 'asc' AS model, CAST(k AS INTEGER) AS k, round(AVG(hit_rate), 6) AS hit_rate_at_k,
               round(AVG(recall), 6) AS recall_at_k FROM hr_tk6 GROUP BY k
        UNION ALL
        SELECT 'desc' AS model, CAST(k AS INTEGER) AS k, round(AVG(hit_rate), 6) AS hit_rate_at_k,
               round(AVG(recall), 6) AS recall_at_k FROM hr_tkd GROUP BY k""",
        COMMON + _hit_ctes("tk6") + _hit_ctes("tkd")),
    "precision_at_k_fixed": with_views(V, "SELECT k, round(precision_at_k, 6) AS precision_at_k FROM metrics",
                                       LIST_CTES),
    "ndcg_at_k": with_views(V, "SELECT k, round(ndcg_at_k, 6) AS ndcg_at_k FROM metrics", LIST_CTES),
    "mean_avg_precision": with_views(V, "SELECT round(AVG(ap), 6) AS mean_avg_precision FROM ap", LIST_CTES),
    "ranking_metrics_at_k": with_views(V, """
        SELECT k, round(precision_at_k, 6) AS precision_at_k, round(ndcg_at_k, 6) AS ndcg_at_k,
               round(mean_avg_precision, 6) AS mean_avg_precision FROM metrics""", LIST_CTES),
    "sales_label_set": with_views(["actual"], """
        SELECT customer_id, string_agg(DISTINCT cma_id, ',' ORDER BY cma_id) AS labels,
               CAST(COUNT(DISTINCT cma_id) AS INTEGER) AS relevant_cat_cnt FROM actual GROUP BY customer_id"""),
    "restricted_label_set": with_views(["actual"], """
        SELECT customer_id, string_agg(DISTINCT cma_id, ',' ORDER BY cma_id) AS labels,
               CAST(COUNT(DISTINCT cma_id) AS INTEGER) AS relevant_cat_cnt FROM actual
        WHERE customer_id % 7 <> 0 AND CAST(cma_id AS INTEGER) <= 8
          AND cma_id IN (SELECT CAST(n_nationkey + 1 AS VARCHAR) FROM nation) GROUP BY customer_id"""),
    "precision_recall_per_user_k": with_views(V, """
        SELECT customer_id, k, cnt_pred_lab_k, round(perc_pred_lab_k, 6) AS perc_pred_lab_k,
               round(recall_pred_lab_k, 6) AS recall_pred_lab_k FROM pu2""", PU_CTES),
    "precision_recall_at_k": with_views(V, """
        SELECT k, round(precision_at_k, 6) AS precision_at_k, round(recall_at_k, 6) AS recall_at_k,
               dup_pred_category_at_k, num_label_at_k FROM prk""", PU_CTES),
    "relevant_customers": with_views(V, "SELECT customer_id FROM rel", PU_CTES),
    "removed_customer_count": with_views(V, """
        SELECT COUNT(*) AS num_customers_removed FROM (SELECT DISTINCT customer_id FROM actual) a
        WHERE customer_id NOT IN (SELECT customer_id FROM rel)""", PU_CTES),
    "prediction_quality_check": with_views(V, """
        SELECT CAST(SUM(dup_pred_category_at_k) AS BIGINT) AS tlt_dup_pred_category,
               CAST(SUM(num_label_at_k) AS BIGINT) AS tlt_num_label,
               SUM(dup_pred_category_at_k) = 0 AND SUM(num_label_at_k) > 0 AS ok FROM prk""", PU_CTES),
    "rolling_precision_recall": with_views(["banner_events"], """
        SELECT k, round(AVG(p), 6) AS precision_at_k, round(AVG(r), 6) AS recall_at_k FROM rday GROUP BY k""",
        rolling_ctes()),
}
