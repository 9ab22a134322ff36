"""Oracle SQL (DuckDB) for the summary queries."""

from __future__ import annotations

from growthlab.plans.views_sql import with_views

CAL = ("DATE '1995-01-01'", "DATE '1999-12-31'")
HOLD = ("DATE '2000-01-01'", "DATE '2001-08-01'")
CAT = "'Brand#1'"
# money in exact units of 1e-4
U = "CAST(round(selling_price * 10000.0) AS BIGINT)"


def cs_sql(start, end, category=CAT, keys="customer_id", money=True, total=True):
    cat = f" AND category_id = {category}" if category else ""
    money_c = f", (CAST(SUM({U}) AS DOUBLE) / COUNT(*)) / 10000.0 AS monetary_value" if money else ""
    total_c = f", CAST(SUM({U}) AS DOUBLE) / 10000.0 AS total_value" if (money and total) else ""
    return f"""SELECT {keys}, CAST(COUNT(DISTINCT dt) - 1 AS BIGINT) AS frequency,
        CAST(date_diff('day', MIN(dt), MAX(dt)) AS INTEGER) AS recency{money_c},
        CAST(date_diff('day', MIN(dt), {end}) AS INTEGER) AS T{total_c}
      FROM sales WHERE dt BETWEEN {start} AND {end}{cat} GROUP BY {keys}"""


CS_COLS = ("customer_id, frequency, recency, round(monetary_value, 4) AS monetary_value, T, "
           "round(total_value, 4) AS total_value")

HB = "((customer_id * 7919) % 1000 + 1000) % 1000"


def pre_post_ctes():
    """CTEs ``pre_post`` (CS8) on top of ``sales``."""
    return [
        ("cs_cal", cs_sql(*CAL)),
        ("cs_hold", cs_sql(*HOLD)),
        ("pre", """SELECT customer_id AS id, frequency AS frequency_cal, recency AS recency_cal, T AS T_cal,
                    monetary_value, total_value FROM cs_cal
                  WHERE frequency < (SELECT quantile_cont(frequency, 0.99) FROM cs_cal)"""),
        ("post", """SELECT customer_id AS id, frequency AS frequency_holdout, monetary_value AS money_holdout,
                    total_value AS total_holdout FROM cs_hold
                  WHERE frequency < (SELECT quantile_cont(frequency, 0.99) FROM cs_hold)"""),
        ("pre_post", """SELECT pre.id, frequency_cal, recency_cal, T_cal, monetary_value, total_value,
                    COALESCE(frequency_holdout, 0) AS frequency_holdout, COALESCE(money_holdout, 0.0) AS money_holdout,
                    COALESCE(total_holdout, 0.0) AS total_holdout, CAST(579 AS DOUBLE) AS duration_holdout
                  FROM pre LEFT JOIN post ON pre.id = post.id"""),
    ]


ORACLE = {
    "customer_summary": with_views(["sales"], f"SELECT {CS_COLS} FROM cs", [("cs", cs_sql(*CAL))]),
    "customer_summary_whole_prices": with_views(["sales"], f"SELECT {CS_COLS} FROM cs", [
        ("whole", "SELECT customer_id, category_id, dt, trunc(selling_price) AS selling_price FROM sales"),
        ("cs", cs_sql(*CAL).replace("FROM sales", "FROM whole"))]),
    "pre_post_weeks": with_views(["sales"], "SELECT id, frequency_cal, round(579 / 7.0, 4) AS duration_holdout FROM pre_post", pre_post_ctes()),
    "sketch_quantiles": with_views(["sales"], """
        SELECT category_id, q, n, true AS within FROM (SELECT category_id, COUNT(selling_price) AS n FROM sales GROUP BY category_id) t,
               (SELECT UNNEST([0.1, 0.25, 0.5, 0.75, 0.9, 0.99]::DOUBLE[]) AS q) qs"""),
    "customer_category_summary": with_views(
        ["sales"],
        "SELECT customer_id, category_id, frequency, recency, round(monetary_value, 4) AS monetary_value, T FROM cs",
        [("cs", cs_sql(*CAL, category=None, keys="customer_id, category_id", total=False))]),
    "category_popularity": with_views(["sales"], f"""
        SELECT category_id, COUNT(*) AS n_rows FROM sales WHERE dt BETWEEN {CAL[0]} AND {CAL[1]}
        GROUP BY category_id"""),
    "transaction_summary": with_views(["sales"], "SELECT customer_id, frequency, recency, T FROM cs",
                                      [("cs", cs_sql(*CAL, category=None, money=False))]),
    "train_test_summary": with_views(["sales"], f"""
        SELECT {CS_COLS}, 'train' AS part FROM tr
        UNION ALL
        SELECT {CS_COLS}, 'test' AS part FROM te WHERE customer_id IN (SELECT customer_id FROM tr)""",
        [("tr0", cs_sql(*CAL)), ("tr", f"SELECT * FROM tr0 WHERE {HB} < 300"), ("te", cs_sql(*HOLD))]),
    "calibration_holdout": with_views(["sales"], f"""
        SELECT c.customer_id, c.frequency AS frequency_cal, c.recency AS recency_cal, c.T AS T_cal,
               COALESCE(h.n, 0) AS frequency_holdout,
               CAST(date_diff('day', {CAL[1]}, {HOLD[1]}) AS INTEGER) AS duration_holdout
        FROM cal c LEFT JOIN h ON c.customer_id = h.customer_id""",
        [("cal", cs_sql(*CAL, money=False)),
         ("h", f"""SELECT customer_id, COUNT(DISTINCT dt) AS n FROM sales
                   WHERE dt > {CAL[1]} AND dt <= {HOLD[1]} AND category_id = {CAT} GROUP BY customer_id""")]),
    "pre_post_table": with_views(["sales"], """
        SELECT id, frequency_cal, recency_cal, T_cal, round(monetary_value, 4) AS monetary_value,
               round(total_value, 4) AS total_value, frequency_holdout, round(money_holdout, 4) AS money_holdout,
               round(total_holdout, 4) AS total_holdout, round(duration_holdout, 4) AS duration_holdout
        FROM pre_post""", pre_post_ctes()),
    "example_histories": with_views(["sales"], f"""
        SELECT p.frequency, s.customer_id, s.category_id, s.dt, round(s.selling_price, 4) AS selling_price
        FROM sales s JOIN (SELECT frequency, MIN(customer_id) AS customer_id FROM cs WHERE frequency IN (2, 4)
                           GROUP BY frequency) p ON s.customer_id = p.customer_id
        WHERE s.dt BETWEEN {CAL[0]} AND {CAL[1]} AND s.category_id = {CAT}""", [("cs", cs_sql(*CAL))]),
    "quantile_trim": with_views(["sales"], f"""
        SELECT {CS_COLS} FROM cs WHERE monetary_value < (SELECT quantile_cont(monetary_value, 0.99) FROM cs)""",
        [("cs", cs_sql(*CAL))]),
    "value_quantiles": with_views(["sales"], """
        SELECT round(UNNEST([0.25, 0.5, 0.75, 0.85, 0.95, 0.99]::DOUBLE[]), 4) AS q,
               round(UNNEST(quantile_cont(monetary_value, [0.25, 0.5, 0.75, 0.85, 0.95, 0.99])), 4) AS value
        FROM cs""", [("cs", cs_sql(*CAL))]),
    "tail_describe": with_views(["sales"], """
        SELECT COUNT(*) AS "count", round(AVG(x), 4) AS mean, round(MIN(x), 4) AS "min",
               round(quantile_cont(x, 0.25), 4) AS p25, round(quantile_cont(x, 0.5), 4) AS p50,
               round(quantile_cont(x, 0.75), 4) AS p75, round(MAX(x), 4) AS "max", round(STDDEV_SAMP(x), 4) AS std
        FROM (SELECT total_value AS x, ROW_NUMBER() OVER (ORDER BY total_value) - 1 AS pos,
                     COUNT(*) OVER () AS n FROM cs) t
        WHERE pos >= FLOOR(n * CAST(0.6 AS DOUBLE))""", [("cs", cs_sql(*CAL))]),
    "freq_money_corr": with_views(["sales"], """
        SELECT round(CORR(CAST(frequency AS DOUBLE), monetary_value), 6) AS corr, COUNT(*) AS n
        FROM cs WHERE frequency > 0 AND monetary_value > 0""", [("cs", cs_sql(*CAL))]),
    "dense_pct_rank": with_views(["sales"], """
        SELECT customer_id, round(total_value, 6) AS total_value,
               round(DENSE_RANK() OVER (ORDER BY total_value DESC)
                     / CAST((SELECT COUNT(DISTINCT total_value) FROM cs) AS DOUBLE), 6) AS pct_rank
        FROM cs""", [("cs", cs_sql(*CAL))]),
    "avg_pct_rank": with_views(["sales"], """
        SELECT customer_id, round(total_value, 6) AS total_value,
               round((RANK() OVER (ORDER BY total_value) - 1
                      + (COUNT(*) OVER (PARTITION BY total_value) + 1) / 2.0) / COUNT(*) OVER (), 6) AS pct_rank
        FROM cs""", [("cs", cs_sql(*CAL))]),
    "hash_split": with_views(["sales"], f"SELECT {CS_COLS} FROM cs WHERE {HB} < 300", [("cs", cs_sql(*CAL))]),
}
