"""Oracle SQL for lifetime-value scoring and evaluation.  The hypergeometric
series is summed from log-gamma terms over a fixed range, longer than any row of the
catalogue's parameters needs."""

from __future__ import annotations

from growthlab.plans import params as P
from growthlab.plans.o_summaries import CAL, cs_sql, pre_post_ctes
from growthlab.plans.views_sql import with_views


def L(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


r, al, a, b = P.BG_R, P.BG_ALPHA, P.BG_A, P.BG_B
p, q, v = P.GG_P, P.GG_Q, P.GG_V
A, B = a + b - 1.0 - r, a - 1.0

SCORE_CTES = pre_post_ctes() + [
    ("sc0", """SELECT *, CAST(frequency_cal AS DOUBLE) AS x, CAST(recency_cal AS DOUBLE) AS tx,
                 CAST(T_cal AS DOUBLE) AS TT FROM pre_post"""),
    ("sc1", f"""SELECT *, 1.0 / (1.0 + CASE WHEN x > 0 THEN {L(a)} / ({L(b)} + x - 1.0)
                   * pow(({L(al)} + TT) / ({L(al)} + tx), {L(r)} + x) ELSE 0.0 END) AS invd,
                 {L(p)} * ({L(v)} + x * monetary_value) / ({L(p)} * x + {L(q)} - 1.0) AS avenue FROM sc0"""),
    ("ts", "SELECT UNNEST([578.0, 30.0, 60.0, 90.0, 120.0, 150.0, 180.0]::DOUBLE[]) AS t"),
    ("terms", "SELECT CAST(UNNEST(range(0, 2500)) AS DOUBLE) AS n"),
    ("zz", f"""SELECT id, t, invd, t / ({L(al)} + TT + t) AS z, {L(a + b - 1.0)} + x AS C FROM sc1, ts"""),
    ("ser", f"""SELECT id, t, invd, z, C, SUM(CASE WHEN n = 0 THEN 1.0 ELSE
                   {'-' if B < 0 else ''}exp(lgamma({L(A)} + n) - lgamma({L(A)}) + lgamma({L(B)} + n) - lgamma({L(B)})
                       - lgamma(C + n) + lgamma(C) - lgamma(n + 1.0) + n * ln(z)) END) AS S
                FROM zz, terms GROUP BY id, t, invd, z, C"""),
    ("ev", f"""SELECT id, t, C / {L(a - 1.0)} * (1.0 - pow(1.0 - z, {L(a - 1.0)}) * S) * invd AS E FROM ser"""),
    ("cl", """SELECT id, t, E - LAG(E, 1, 0.0) OVER (PARTITION BY id ORDER BY t) AS dE FROM ev WHERE t <= 180.0"""),
    ("clvt", f"""SELECT c.id, SUM(s.avenue * c.dE / pow(1.1, c.t / 30.0)) AS clv,
                   SUM(s.avenue * (CASE WHEN isnan(c.dE) OR c.dE < {L(P.CLV_ADJ_FLOOR)} THEN 0.0 ELSE c.dE END)
                       / pow(1.1, c.t / 30.0)) AS clv_adjusted
                 FROM cl c JOIN sc1 s ON c.id = s.id GROUP BY c.id"""),
    ("scored", """SELECT s.*, e.E AS predicted_purchases, s.invd AS palive, c.clv, c.clv_adjusted,
                    CASE WHEN s.invd >= 0.5 THEN 1 ELSE 0 END AS alive_status,
                    CASE WHEN e.E < 0.5 THEN 0.0 ELSE e.E END AS pred
                  FROM sc1 s JOIN (SELECT * FROM ev WHERE t = 578.0) e ON s.id = e.id JOIN clvt c ON s.id = c.id"""),
]

BIN_CTES = SCORE_CTES + [
    ("bins", """SELECT CAST(round(q * 10) AS INTEGER) AS bin, CASE WHEN q = 0 THEN 0.0 ELSE round(e, 3) END AS edge FROM (
                  SELECT UNNEST([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]) AS q,
                         UNNEST(quantile_cont(total_holdout, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e
                  FROM scored WHERE total_holdout > 0) t"""),
    ("bk", """SELECT s.*, COALESCE((SELECT MIN(bin) FROM bins WHERE COALESCE(s.total_holdout, 0.0) <= bins.edge),
                                   (SELECT COUNT(*) - 1 FROM bins)) AS bucket FROM scored s"""),
]

TRIM = "(SELECT id, clv AS value FROM scored WHERE clv < (SELECT quantile_cont(clv, 0.99) FROM scored))"


def _gini(col):
    return f"""(SELECT SUM((2 * i - n - 1) * x) / (n * SUM(x)) FROM (
                 SELECT x, ROW_NUMBER() OVER (ORDER BY x) AS i, COUNT(*) OVER () AS n FROM (
                   SELECT COALESCE({col}, 0.0) - LEAST((SELECT MIN(COALESCE({col}, 0.0)) FROM scored), 0.0) + 1e-7 AS x
                   FROM scored) u) w GROUP BY n)"""


V = ["sales"]

# three periods of each unit's length
UNIT_CTES = [(n, "SELECT u, i, CAST(f * i AS DOUBLE) AS t FROM (SELECT UNNEST(['w', 'm', 'h']) AS u, UNNEST([4.345, 1.0, 720.0]::DOUBLE[]) AS f) a, (SELECT UNNEST([1, 2, 3]) AS i) b" if n == "ts" else q)
             for n, q in SCORE_CTES if n in ("cs_cal", "cs_hold", "pre", "post", "pre_post", "sc0", "sc1", "ts", "terms")]
UNIT_CTES += [
    ("zz", f"SELECT id, t, u, i, invd, t / ({L(al)} + TT + t) AS z, {L(a + b - 1.0)} + x AS C FROM sc1, ts"),
    ("ser", dict(SCORE_CTES)["ser"].replace("SELECT id, t,", "SELECT id, t, u, i,").replace("GROUP BY id, t,", "GROUP BY id, t, u, i,")),
    ("ev", f"SELECT id, u, i, C / {L(a - 1.0)} * (1.0 - pow(1.0 - z, {L(a - 1.0)}) * S) * invd AS E FROM ser"),
    ("de", "SELECT id, u, i, E - LAG(E, 1, 0.0) OVER (PARTITION BY id, u ORDER BY i) AS d FROM ev"),
    ("per", "SELECT de.id, u, SUM(avenue * d / pow(1.1, i)) AS v FROM de JOIN sc1 ON de.id = sc1.id GROUP BY de.id, u"),
]

ORACLE = {
    "clv_units": with_views(["sales"], """
        SELECT id, round(MAX(CASE WHEN u = 'w' THEN v END), 4) AS clv_w, round(MAX(CASE WHEN u = 'm' THEN v END), 4) AS clv_m,
               round(MAX(CASE WHEN u = 'h' THEN v END), 4) AS clv_h FROM per GROUP BY id""", UNIT_CTES),
    "expected_purchases": with_views(V, "SELECT id, round(predicted_purchases, 4) AS predicted_purchases FROM scored",
                                     SCORE_CTES),
    "probability_alive": with_views(V, "SELECT id, round(palive, 4) AS palive FROM scored", SCORE_CTES),
    "expected_avg_profit": with_views(V, "SELECT id, round(avenue, 4) AS avenue FROM scored", SCORE_CTES),
    "clv": with_views(V, "SELECT id, round(clv, 4) AS clv FROM scored", SCORE_CTES),
    "clv_adjusted": with_views(V, "SELECT id, round(clv_adjusted, 4) AS clv_adjusted FROM scored", SCORE_CTES),
    "rule_based_clv": with_views(V, f"""
        SELECT id, round(monetary_value * {L(0.8 / (1.0 + 0.1 - 0.8))}, 4) AS clv_rule,
               round(predicted_purchases * monetary_value, 4) AS ltv FROM scored""", SCORE_CTES),
    "frequency_recency_grid": with_views(V, f"""
        SELECT frequency, round(recency, 6) AS recency,
               round(C / {L(a - 1.0)} * (1.0 - pow(1.0 - z, {L(a - 1.0)}) * S) * invd, 6) AS expected_purchases,
               round(invd, 6) AS p_alive
        FROM (SELECT frequency, recency, invd, z, C, SUM(CASE WHEN n = 0 THEN 1.0 ELSE
                 {'-' if B < 0 else ''}exp(lgamma({L(A)} + n) - lgamma({L(A)}) + lgamma({L(B)} + n) - lgamma({L(B)})
                 - lgamma(C + n) + lgamma(C) - lgamma(n + 1.0) + n * ln(z)) END) AS S
              FROM (SELECT frequency, recency, 1.0 / ({L(al)} + TT + 1.0) AS z, {L(a + b - 1.0)} + frequency AS C,
                      1.0 / (1.0 + CASE WHEN frequency > 0 THEN {L(a)} / ({L(b)} + frequency - 1.0)
                        * pow(({L(al)} + TT) / ({L(al)} + recency), {L(r)} + frequency) ELSE 0.0 END) AS invd
                    FROM (SELECT CAST(MAX(T_cal) AS DOUBLE) AS TT FROM pre_post) m,
                         (SELECT CAST(UNNEST(range(0, 21)) AS INTEGER) AS frequency) f,
                         (SELECT CAST(UNNEST(range(0, 21)) AS INTEGER) AS j) jj,
                         LATERAL (SELECT m.TT * jj.j / 20.0 AS recency) rr) g, terms
              GROUP BY frequency, recency, invd, z, C) s""", SCORE_CTES[:-9] + [SCORE_CTES[-7]]),
    "repeat_histogram": with_views(V, """
        SELECT LEAST(frequency_cal, 20) AS repeat_purchases, COUNT(*) AS customers FROM pre_post GROUP BY 1""",
        pre_post_ctes()),
    "calibration_curve": with_views(V, """
        SELECT frequency_cal, round(AVG(frequency_holdout), 4) AS frequency_holdout,
               round(AVG(predicted_purchases), 4) AS predicted_purchases
        FROM scored GROUP BY frequency_cal ORDER BY frequency_cal LIMIT 10""", SCORE_CTES),
    "frequency_eval": with_views(V, """
        SELECT round(AVG(abs(frequency_holdout - pred)), 4) AS mae, round(AVG(pow(frequency_holdout - pred, 2)), 4) AS mse,
               round(AVG(CASE WHEN abs(frequency_holdout - pred) < 2 THEN 1.0 ELSE 0.0 END), 4) AS pred_in,
               round(AVG(CASE WHEN (palive < 0.3 AND frequency_holdout = 0) OR (palive >= 0.3 AND frequency_holdout > 0)
                              THEN 1.0 ELSE 0.0 END), 4) AS alive_acc,
               round(AVG(abs(frequency_holdout - frequency_cal)), 4) AS base_mae,
               round(AVG(CASE WHEN abs(frequency_holdout - frequency_cal) < 2 THEN 1.0 ELSE 0.0 END), 4) AS base_in,
               COUNT(*) AS n FROM scored""", SCORE_CTES),
    "frequency_eval_capped": with_views(V, """
        SELECT round(AVG(abs(frequency_holdout - pc)), 4) AS mae, round(AVG(pow(frequency_holdout - pc, 2)), 4) AS mse
        FROM (SELECT *, CASE WHEN predicted_purchases < 0.5 THEN 0.0 WHEN predicted_purchases > 25 THEN 25.0
                             ELSE predicted_purchases END AS pc FROM scored) t""", SCORE_CTES),
    "money_eval": with_views(V, """
        SELECT round(AVG(abs(avenue - money_holdout)), 4) AS mae, round(sqrt(AVG(pow(avenue - money_holdout, 2))), 4) AS rmse,
               round(AVG(avenue), 4) AS mean_expected, round(AVG(money_holdout), 4) AS mean_actual, COUNT(*) AS n
        FROM scored WHERE frequency_cal > 0 AND money_holdout > 0""", SCORE_CTES),
    "clv_variant_eval": with_views(V, """
        SELECT COUNT(*) AS n, round(AVG(abs(clv - a)), 4) AS mae_clv,
               round(AVG(abs(GREATEST(clv * alive_status, 0.0) - a)), 4) AS mae_clv_alive,
               round(AVG(abs(GREATEST(avenue * pred * alive_status, 0.0) - a)), 4) AS mae_ave_pred_alive,
               round(AVG(abs(GREATEST(avenue * pred, 0.0) - a)), 4) AS mae_ave_pred
        FROM (SELECT *, COALESCE(total_holdout, 0.0) AS a FROM scored WHERE clv <= 5e7) t""", SCORE_CTES),
    "total_value_eval": with_views(V, """
        SELECT round(sqrt(AVG(pow(e1, 2))), 4) AS rmse_clv_alive, round(AVG(abs(e1)), 4) AS mae_clv_alive,
               round(sqrt(AVG(pow(e2, 2))), 4) AS rmse_ave_pred_alive, round(AVG(abs(e2)), 4) AS mae_ave_pred_alive
        FROM (SELECT clv * alive_status - money_holdout * (frequency_holdout + 1) AS e1,
                     avenue * pred * alive_status - money_holdout * (frequency_holdout + 1) AS e2 FROM scored) t""",
        SCORE_CTES),
    "decile_bins": with_views(V, "SELECT bin, round(edge, 4) AS edge FROM bins", BIN_CTES),
    "bucket_mean": with_views(V, """
        SELECT b.bin AS bucket, round(b.edge, 4) AS bins, m."count", round(m.mean_total_holdout, 4) AS mean_total_holdout,
               round(m.mean_clv, 4) AS mean_clv, round(m.mean_total_value, 4) AS mean_total_value
        FROM bins b LEFT JOIN (SELECT bucket, COUNT(*) AS "count", AVG(COALESCE(total_holdout, 0.0)) AS mean_total_holdout,
                                      AVG(COALESCE(clv, 0.0)) AS mean_clv, AVG(COALESCE(total_value, 0.0)) AS mean_total_value
                               FROM bk GROUP BY bucket) m ON b.bin = m.bucket""", BIN_CTES),
    "bucket_tpr_fpr": with_views(V, """
        SELECT round(AVG(CASE WHEN bucket = 0 THEN CASE WHEN COALESCE(clv_adjusted, 0.0) = 0 THEN 1.0 ELSE 0.0 END END), 6) AS tpr,
               round(AVG(CASE WHEN bucket <> 0 THEN CASE WHEN COALESCE(clv_adjusted, 0.0) = 0 THEN 1.0 ELSE 0.0 END END), 6) AS fpr
        FROM bk""", BIN_CTES),
    "bucket_mape": with_views(V, """
        SELECT bucket, round(g1, 4) AS g1, round(g2, 4) AS g2,
               round(CASE WHEN g2 <> 0 THEN abs(g1 - g2) / g2 ELSE g1 - g2 END, 4) AS mape
        FROM (SELECT b.bin AS bucket, AVG(COALESCE(total_holdout, 0.0)) AS g2, AVG(COALESCE(clv, 0.0)) AS g1
              FROM bins b LEFT JOIN bk ON b.bin = bk.bucket GROUP BY b.bin) t WHERE bucket >= 1""", BIN_CTES),
    "bucket_mape_mean": with_views(V, """
        SELECT round(AVG(round(abs(c - h) / h, 3)), 4) AS mape_clv, round(AVG(round(abs(t - h) / h, 3)), 4) AS mape_training
        FROM (SELECT b.bin AS bucket, AVG(COALESCE(total_holdout, 0.0)) AS h, AVG(COALESCE(clv, 0.0)) AS c,
                     AVG(COALESCE(total_value, 0.0)) AS t
              FROM bins b JOIN bk ON b.bin = bk.bucket GROUP BY b.bin) m WHERE bucket >= 1""", BIN_CTES),
    "value_concentration": with_views(V, f"""
        SELECT id, nid, round(value, 6) AS value, round(cv / tv, 6) AS value_share,
               round((nid * (nid + 1) / 2.0) / (n * (n - 1) / 2.0), 6) AS index_share, round((nid + 1.0) / n, 6) AS row_share
        FROM (SELECT id, value, ROW_NUMBER() OVER (ORDER BY value DESC, id) - 1 AS nid,
                     SUM(value) OVER (ORDER BY value DESC, id ROWS UNBOUNDED PRECEDING) AS cv,
                     SUM(value) OVER () AS tv, COUNT(*) OVER () AS n FROM {TRIM} t0) t""", SCORE_CTES),
    "percentile_curve": with_views(V, f"""
        SELECT id, nid, round(value, 6) AS value, round((nid + 1.0) / n, 6) AS x, round(dr / CAST(nd AS DOUBLE), 6) AS y
        FROM (SELECT id, value, ROW_NUMBER() OVER (ORDER BY value DESC, id) - 1 AS nid, COUNT(*) OVER () AS n,
                     DENSE_RANK() OVER (ORDER BY value DESC) AS dr,
                     (SELECT COUNT(DISTINCT value) FROM {TRIM} t1) AS nd FROM {TRIM} t0) t""", SCORE_CTES),
    "gini": with_views(V, f"""
        SELECT round({_gini('total_holdout')}, 6) AS gini_total_holdout, round({_gini('clv')}, 6) AS gini_clv""",
        SCORE_CTES),
    "spearman": with_views(V, """
        SELECT round(CORR(ra, rb), 6) AS spearman, COUNT(*) AS n FROM (
          SELECT (RANK() OVER (ORDER BY a) - 1 + (COUNT(*) OVER (PARTITION BY a) + 1) / 2.0) AS ra,
                 (RANK() OVER (ORDER BY b) - 1 + (COUNT(*) OVER (PARTITION BY b) + 1) / 2.0) AS rb
          FROM (SELECT COALESCE(total_holdout, 0.0) AS a, COALESCE(clv, 0.0) AS b FROM scored) u
          WHERE a <> 0 OR b <> 0) t""", SCORE_CTES),
    "topn_jaccard": with_views(V, """
        SELECT round((SELECT COUNT(*) FROM t1 JOIN t2 ON t1.id = t2.id)
                     / CAST((SELECT COUNT(*) FROM (SELECT id FROM t1 UNION SELECT id FROM t2) u) AS DOUBLE), 6) AS jaccard,
               100 AS top""", SCORE_CTES + [
        ("t1", "SELECT id FROM scored ORDER BY COALESCE(total_holdout, 0.0) DESC, id LIMIT 100"),
        ("t2", "SELECT id FROM scored ORDER BY COALESCE(clv, 0.0) DESC, id LIMIT 100")]),
    "ml_features": with_views(V, """
        SELECT id, round(CAST(frequency_cal AS DOUBLE), 6) AS frequency_cal, round(CAST(recency_cal AS DOUBLE), 6) AS recency_cal,
               round(CAST(T_cal AS DOUBLE), 6) AS T_cal, round(monetary_value, 6) AS monetary_value,
               round(sqrt(frequency_cal + 1.0), 6) AS f_sqrt, round(ln(frequency_cal + 1.0), 6) AS f_log,
               round(ln((frequency_cal + 1.0) * monetary_value + 1), 6) AS fm_log,
               round(ln((frequency_holdout + 1) * money_holdout + 1), 6) AS label FROM pre_post""", pre_post_ctes()),
}

ORACLE["bgnbd_loglik"] = with_views(V, f"""
    SELECT round(SUM(lgamma({L(r)} + x) - lgamma({L(r)}) + {L(r)} * ln({L(al)})
               + lgamma({L(a + b)}) + lgamma({L(b)} + x) - lgamma({L(b)}) - lgamma({L(a + b)} + x)
               + ln(pow({L(al)} + TT, -({L(r)} + x)) + CASE WHEN x > 0 THEN {L(a)} / ({L(b)} + x - 1.0)
                    * pow({L(al)} + tx, -({L(r)} + x)) ELSE 0.0 END)), 4) AS log_likelihood, COUNT(*) AS n FROM sc0""",
    SCORE_CTES[:SCORE_CTES.index(next(c for c in SCORE_CTES if c[0] == "sc0")) + 1])
ORACLE["gamma_gamma_loglik"] = with_views(V, f"""
    SELECT round(SUM(lgamma({L(p)} * x + {L(q)}) - lgamma({L(p)} * x) - lgamma({L(q)}) + {L(q)} * ln({L(v)})
               + ({L(p)} * x - 1.0) * ln(monetary_value) + {L(p)} * x * ln(x)
               - ({L(p)} * x + {L(q)}) * ln({L(v)} + x * monetary_value)), 4) AS log_likelihood, COUNT(*) AS n
    FROM sc0 WHERE x > 0 AND monetary_value > 0""",
    SCORE_CTES[:SCORE_CTES.index(next(c for c in SCORE_CTES if c[0] == "sc0")) + 1])

_FEATS = ["frequency_cal", "recency_cal", "T_cal", "monetary_value", "f_sqrt", "f_log", "fm_log"]
_FEAT_CTES = pre_post_ctes() + [
    ("mf", """SELECT id, CAST(frequency_cal AS DOUBLE) AS frequency_cal, CAST(recency_cal AS DOUBLE) AS recency_cal,
                CAST(T_cal AS DOUBLE) AS T_cal, monetary_value, sqrt(frequency_cal + 1.0) AS f_sqrt,
                ln(frequency_cal + 1.0) AS f_log, ln((frequency_cal + 1.0) * monetary_value + 1) AS fm_log,
                ln((frequency_holdout + 1) * money_holdout + 1) AS label,
                ((id * 7919) % 1000 + 1000) % 1000 < 670 AS is_train FROM pre_post"""),
    ("st", "SELECT " + ", ".join(f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in _FEATS)
     + " FROM mf WHERE is_train"),
]
ORACLE["standardised_features"] = with_views(V, "SELECT id, " + ", ".join(
    f"round(({c} - m_{c}) / NULLIF(s_{c}, 0), 6) AS {c}" if c in _FEATS[:4] else f"round({c}, 6) AS {c}" for c in _FEATS)
    + ", round(label, 6) AS label, is_train FROM mf, st", _FEAT_CTES)


def _ridge_ctes(alpha: float) -> list[tuple[str, str]]:
    """Centred normal equations of the train rows plus alpha on the diagonal, solved by
    Gaussian elimination with one statement per pivot, then substitution from the last."""
    n = len(_FEATS)
    x = [f"(({c} - m_{c}) / NULLIF(s_{c}, 0))" if i < 4 else c for i, c in enumerate(_FEATS)]
    ctes = [("xs", "SELECT id, is_train, label AS y, " + ", ".join(f"{e} AS x{i}" for i, e in enumerate(x)) + " FROM mf, st"),
            ("mx", "SELECT AVG(y) AS my, " + ", ".join(f"AVG(x{i}) AS m{i}" for i in range(n)) + " FROM xs WHERE is_train"),
            ("e0", "SELECT " + ", ".join(
                [f"SUM((x{i} - m{i}) * (x{j} - m{j})){f' + {L(alpha)}' if i == j else ''} AS c{i}_{j}" for i in range(n) for j in range(n)]
                + [f"SUM((x{i} - m{i}) * (y - my)) AS c{i}_{n}" for i in range(n)]) + " FROM xs, mx WHERE is_train")]
    for k in range(n - 1):
        ctes.append((f"e{k + 1}", "SELECT " + ", ".join(
            f"c{i}_{j}" if i <= k else f"c{i}_{j} - c{i}_{k} * c{k}_{j} / c{k}_{k} AS c{i}_{j}"
            for i in range(n) for j in range(min(i, k + 1) if i <= k else k + 1, n + 1)) + f" FROM e{k}"))
    last = f"e{n - 1}"
    for k in range(n - 1, -1, -1):
        done = " - ".join([f"c{k}_{n}"] + [f"c{k}_{j} * b{j}" for j in range(k + 1, n)])
        ctes.append((f"s{k}", f"SELECT *, ({done}) / c{k}_{k} AS b{k} FROM {last}"))
        last = f"s{k}"
    ctes.append(("beta", "SELECT " + ", ".join(f"b{i}" for i in range(n)) + ", my - ("
                 + " + ".join(f"b{i} * m{i}" for i in range(n)) + f") AS b FROM {last}, mx"))
    return ctes


_RIDGE = _FEAT_CTES + _ridge_ctes(0.5)
ORACLE["ridge_coefficients"] = with_views(V, " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(b{i}, 4) AS coefficient FROM beta" for i, c in enumerate(_FEATS))
    + " UNION ALL SELECT 'intercept', round(b, 4) FROM beta", _RIDGE)
ORACLE["ridge_mae"] = with_views(V, "SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END AS part, round(AVG(abs(b + "
                                 + " + ".join(f"b{i} * x{i}" for i in range(len(_FEATS)))
                                 + " - y)), 4) AS mae, COUNT(*) AS n FROM xs, beta GROUP BY 1", _RIDGE)

ORACLE["alive_history"] = with_views(V, f"""
    SELECT g.customer_id, g.day, COUNT(*) - 1 AS frequency, CAST(date_diff('day', MIN(d.dt), MAX(d.dt)) AS INTEGER) AS recency,
           CAST(date_diff('day', MIN(d.dt), g.day) AS INTEGER) AS T,
           round(1.0 / (1.0 + CASE WHEN COUNT(*) - 1 > 0 THEN {L(a)} / ({L(b)} + (COUNT(*) - 1) - 1.0)
             * pow(({L(al)} + date_diff('day', MIN(d.dt), g.day)) / ({L(al)} + date_diff('day', MIN(d.dt), MAX(d.dt))),
                   {L(r)} + (COUNT(*) - 1)) ELSE 0.0 END), 6) AS p_alive
    FROM (SELECT p.customer_id, CAST(UNNEST(generate_series(DATE '1999-12-31' - 299, DATE '1999-12-31', INTERVAL 1 DAY)) AS DATE) AS day
          FROM pick p) g
    JOIN (SELECT DISTINCT customer_id, dt FROM sales WHERE category_id = 'Brand#1'
            AND dt BETWEEN DATE '1995-01-01' AND DATE '1999-12-31') d
      ON g.customer_id = d.customer_id AND d.dt <= g.day
    GROUP BY g.customer_id, g.day""", [
    ("cs", cs_sql(*CAL)),
    ("pick", "SELECT frequency, MIN(customer_id) AS customer_id FROM cs WHERE frequency IN (2, 4) GROUP BY frequency")])
