"""Oracle SQL for the fits (LV1, LV2, LV13): both likelihoods maximised in SQL by another
method than the library's.  A recursive statement takes damped scoring steps (the inverse of
the summed outer products of the customers' gradients, solved by elimination)."""

from __future__ import annotations

from growthlab.plans.o_summaries import pre_post_ctes
from growthlab.plans.views_sql import with_views

PENALTY = 0.001
ITERATIONS = 400


def digamma(x: str) -> str:
    """Shift by 8, then the asymptotic series."""
    y = f"({x} + 8.0)"
    shift = " + ".join(f"1.0 / ({x} + {k}.0)" for k in range(8))
    i = f"(1.0 / ({y} * {y}))"
    return (f"(ln({y}) - 0.5 / {y} - {i} * (1.0 / 12 - {i} * (1.0 / 120 - {i} * (1.0 / 252 - {i} * (1.0 / 240 - {i} / 132.0)))) - ({shift}))")


def _scoring(n: int, name: str, start: list[str], values: list[str], gradients: list[str], source: str, low: list[float]) -> str:
    """The recursive part: log-parameters t1 ... tn; ``gradients`` by the parameters p1 ... pn."""
    ps = ", ".join(f"{low[i]} + exp(t{i + 1}) AS p{i + 1}, exp(t{i + 1}) AS e{i + 1}" for i in range(n))
    ts = ", ".join(f"t{i}" for i in range(1, n + 1))
    es = ", ".join(f"e{i}" for i in range(1, n + 1))
    rows = f"SELECT it, {ts}, {es}, w, {', '.join(f'{g} * e{i + 1} AS g{i + 1}' for i, g in enumerate(gradients))} FROM (SELECT *{''.join(', ' + v for v in values)} FROM (SELECT *, {ps} FROM {name} WHERE it < {ITERATIONS}) f, {source} c) d"
    grads = ", ".join(f"SUM(w * g{i}) / SUM(w) - 2 * {PENALTY} * e{i} * e{i} AS b{i}" for i in range(1, n + 1))
    outer = ", ".join(f"SUM(w * g{i} * g{j}) / SUM(w){f' + 4 * {PENALTY} * e{i} * e{i}' if i == j else ''} AS a{i}{j}"
                      for i in range(1, n + 1) for j in range(1, n + 1))
    step = f"SELECT it, {ts}, {grads}, {outer} FROM ({rows}) r GROUP BY it, {ts}, {es}"
    for k in range(1, n):  # forward elimination
        fixed = [f"a{i}{j}" for i in range(1, k + 1) for j in range(i, n + 1)] + [f"b{i}" for i in range(1, k + 1)]
        new = [f"a{i}{j} - a{i}{k} / a{k}{k} * a{k}{j} AS a{i}{j}" for i in range(k + 1, n + 1) for j in range(k + 1, n + 1)]
        new += [f"b{i} - a{i}{k} / a{k}{k} * b{k} AS b{i}" for i in range(k + 1, n + 1)]
        step = f"SELECT it, {ts}, {', '.join(fixed + new)} FROM ({step}) s{k}"
    for k in range(n, 0, -1):  # back substitution
        known = "".join(f" - a{k}{j} * x{j}" for j in range(k + 1, n + 1))
        step = f"SELECT *, (b{k}{known}) / a{k}{k} AS x{k} FROM ({step}) u{k}"
    most = "greatest(" + ", ".join(f"abs(x{i})" for i in range(1, n + 1)) + ")"
    moved = ", ".join(f"t{i} + 0.5 * x{i} / greatest(1.0, {most})" for i in range(1, n + 1))
    return f"SELECT 0 AS it, {', '.join(f'{s} AS t{i + 1}' for i, s in enumerate(start))} UNION ALL SELECT it + 1, {moved} FROM ({step}) z"


_BG = _scoring(
    4, "bg_fit", ["0.0::DOUBLE", "(SELECT ln(SUM(w * TT) / SUM(w)) FROM bg_rows)", "0.0::DOUBLE", "0.0::DOUBLE"],
    [f"{digamma('p1 + x')} - {digamma('p1')} AS psi_r", f"{digamma('p3 + p4')} - {digamma('p3 + p4 + x')} AS psi_ab",
     f"{digamma('p4 + x')} - {digamma('p4')} AS psi_b",
     "CASE WHEN x > 0 THEN 1.0 / (1.0 + (p4 + x - 1.0) / p3 * exp((p1 + x) * (ln(p2 + tx) - ln(p2 + TT)))) ELSE 0.0 END AS gone"],
    ["(psi_r + ln(p2) - (1.0 - gone) * ln(p2 + TT) - gone * ln(p2 + tx))",
     "(p1 / p2 - (p1 + x) * ((1.0 - gone) / (p2 + TT) + gone / (p2 + tx)))",
     "(psi_ab + gone / p3)", "(psi_ab + psi_b - CASE WHEN x > 0 THEN gone / (p4 + x - 1.0) ELSE 0.0 END)"], "bg_rows", [0.0] * 4)

_GG = _scoring(
    3, "gg_fit", ["ln(2.0::DOUBLE)", "ln(2.0::DOUBLE)", "0.0::DOUBLE"],
    [f"{digamma('p1 * x + p2')} AS psi_all", f"{digamma('p1 * x')} AS psi_x", f"{digamma('p2')} AS psi_q"],
    ["(x * (psi_all - psi_x + ln(x) + ln(m) - ln(p3 + x * m)))", "(psi_all - psi_q + ln(p3) - ln(p3 + x * m))",
     "(p2 / p3 - (p1 * x + p2) / (p3 + x * m))"], "gg_rows", [0.0, 1.0, 0.0])

FIT_CTES = pre_post_ctes() + [
    ("units", "SELECT MAX(T_cal) / 10.0 AS days, AVG(monetary_value) FILTER (WHERE frequency_cal > 0 AND monetary_value > 0) AS money FROM pre_post"),
    ("bg_rows", "SELECT CAST(frequency_cal AS DOUBLE) AS x, recency_cal / days AS tx, T_cal / days AS TT, CAST(COUNT(*) AS DOUBLE) AS w FROM pre_post, units GROUP BY ALL"),
    ("gg_rows", "SELECT CAST(frequency_cal AS DOUBLE) AS x, monetary_value / money AS m, CAST(COUNT(*) AS DOUBLE) AS w FROM pre_post, units WHERE frequency_cal > 0 AND monetary_value > 0 GROUP BY ALL"),
    ("bg_fit(it, t1, t2, t3, t4)", _BG),
    ("gg_fit(it, t1, t2, t3)", _GG),
]

_LAST = f"(SELECT * FROM {{}} WHERE it = {ITERATIONS})"
ORACLE = {
    "fitted_parameters": with_views(["sales"], f"""
        SELECT round(b.t1, 4) AS log_r, round(b.t2 + ln(units.days), 4) AS log_alpha, round(b.t3, 4) AS log_a, round(b.t4, 4) AS log_b,
               round(g.t1, 4) AS log_p, round(ln(1.0 + exp(g.t2)), 4) AS log_q, round(g.t3 + ln(units.money), 4) AS log_v
        FROM {_LAST.format('bg_fit')} b, {_LAST.format('gg_fit')} g, units""", FIT_CTES).replace("WITH ", "WITH RECURSIVE ", 1),
}
