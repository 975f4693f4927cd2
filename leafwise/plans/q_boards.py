"""Leaderboard / selection / grid queries over the ``results`` carrier, with their
DuckDB oracle SQL.  Each query: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafwise.operators import boards, grid, selection
from leafwise.plans import carriers
from leafwise.plans.oracle_base import ratio, round_half_up, round_ratio, with_results
from leafwise.sources import dims

Q: dict = {}
SQL: dict = {}

COMBOS = [c[0] for c in dims.COMBINATIONS]


def cnt_if(cond: str) -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


def sum_if(cond: str, v: str = "t10") -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN {v} ELSE 0 END) AS BIGINT)"


def q(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


# --- A3 run statistics ------------------------------------------------------
@q("run_stats")
def run_stats(spark, sf):
    return boards.run_stats(carriers.results(spark, sf))


SQL["run_stats"] = with_results(f"""
SELECT framework, mode, combination, count(*) AS n_tests,
       COALESCE({ratio(sum_if('scored'), '10 * ' + cnt_if('scored'))}, 0.0) AS avg_ok,
       {ratio('sum(t10)', '10 * count(*)')} AS avg_all,
       count(*) - {cnt_if('scored')} AS fail_count
FROM results GROUP BY framework, mode, combination""")


# --- A4 summary matrix ------------------------------------------------------
@q("summary_matrix")
def summary_matrix(spark, sf):
    return boards.summary_matrix(carriers.results(spark, sf))


_cols = []
for _c in COMBOS:
    _cond = f"combination = '{_c}'"
    _cols.append(f"{ratio(sum_if(_cond + ' AND success'), '10 * ' + cnt_if(_cond + ' AND success'))} AS {_c}_avg")
    _cols.append(f"{cnt_if(_cond)} - {cnt_if(_cond + ' AND success')} AS {_c}_fail")
SQL["summary_matrix"] = with_results(f"""
SELECT framework, mode, {', '.join(_cols)} FROM results GROUP BY framework, mode""")


# --- A5 overall with CI -----------------------------------------------------
@q("overall_ci")
def overall_ci(spark, sf):
    return boards.overall_ci(carriers.results(spark, sf))


_var = ("CAST(CAST(n AS DECIMAL(38,0)) * CAST(ss AS DECIMAL(38,0)) - CAST(s AS DECIMAL(38,0)) * "
        "CAST(s AS DECIMAL(38,0)) AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE) / 100.0")
_margin = f"(CAST(1.96 AS DOUBLE) * sqrt(({_var}) / CAST(n AS DOUBLE)))"
_mean = ratio("s", "n * 10")
SQL["overall_ci"] = with_results(f"""
, cell AS (SELECT framework, mode, combination, count(*) AS n, CAST(sum(t10) AS BIGINT) AS s,
                  CAST(sum(t10 * t10) AS BIGINT) AS ss, {cnt_if('success')} AS k
           FROM results GROUP BY framework, mode, combination),
pooled AS (SELECT framework, mode, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS s,
                  CAST(sum(ss) AS BIGINT) AS ss FROM cell WHERE k > 0 GROUP BY framework, mode)
SELECT framework, mode, n AS n_pooled, {_mean} AS overall,
       CASE WHEN n = 0 THEN 0.0 WHEN n < 2 THEN {_mean} ELSE {round_half_up(_mean + ' - ' + _margin)} END AS ci_low,
       CASE WHEN n = 0 THEN 0.0 WHEN n < 2 THEN {_mean} ELSE {round_half_up(_mean + ' + ' + _margin)} END AS ci_high
FROM pooled""")


# --- A6 published overall (ok = score > 0) ----------------------------------
@q("overall_ok")
def overall_ok(spark, sf):
    return boards.overall_ok(carriers.results(spark, sf))


SQL["overall_ok"] = with_results(f"""
SELECT framework, mode, {cnt_if('score_pct > 0')} AS n_ok,
       {ratio(sum_if('score_pct > 0'), '10 * ' + cnt_if('score_pct > 0'))} AS overall_ok
FROM results GROUP BY framework, mode""")


# --- A7 / A8 combination averages ---------------------------------------------
@q("combo_avg")
def combo_avg(spark, sf):
    return boards.combo_avg(carriers.results(spark, sf))


SQL["combo_avg"] = with_results(f"""
SELECT combination, count(*) AS n, {ratio('sum(t10)', '10 * count(*)')} AS avg_all,
       {cnt_if('NOT success')} AS fail_count
FROM results GROUP BY combination""")


@q("combo_avg_ok")
def combo_avg_ok(spark, sf):
    return boards.combo_avg_ok(carriers.results(spark, sf))


SQL["combo_avg_ok"] = with_results(f"""
SELECT combination, count(*) AS n_total, {cnt_if('score_pct > 0')} AS n_pos, {cnt_if('success')} AS n_success,
       {ratio(sum_if('score_pct > 0'), '10 * ' + cnt_if('score_pct > 0'))} AS avg_pos,
       {ratio(sum_if('success'), '10 * ' + cnt_if('success'))} AS avg_success
FROM results GROUP BY combination""")


# --- A9 / A10 breakdowns --------------------------------------------------------
def _group_breakdown_sql(g):
    return with_results(f"""
SELECT {g}, combination, COALESCE({ratio(sum_if('success'), '10 * ' + cnt_if('success'))}, 0.0) AS avg_ok,
       count(*) - {cnt_if('success')} AS fail_count
FROM results WHERE {g} IS NOT NULL GROUP BY {g}, combination""")


@q("category_breakdown")
def category_breakdown(spark, sf):
    return boards.group_breakdown(carriers.results(spark, sf), "category")


SQL["category_breakdown"] = _group_breakdown_sql("category")


@q("domain_breakdown")
def domain_breakdown(spark, sf):
    return boards.group_breakdown(carriers.results(spark, sf), "domain")


SQL["domain_breakdown"] = _group_breakdown_sql("domain")


@q("depth_breakdown")
def depth_breakdown(spark, sf):
    return boards.positive_breakdown(carriers.results(spark, sf), "true_depth")


SQL["depth_breakdown"] = with_results(f"""
SELECT true_depth, count(*) AS n, {cnt_if('score_pct > 0')} AS n_ok,
       {ratio(sum_if('score_pct > 0'), '10 * ' + cnt_if('score_pct > 0'))} AS avg_ok
FROM results GROUP BY true_depth""")


# --- A13 group pivot, A11 dashboard pivot -------------------------------------
@q("group_pivot")
def group_pivot(spark, sf):
    return boards.group_pivot(carriers.results(spark, sf), "category")


SQL["group_pivot"] = with_results(
    "SELECT category, " + ", ".join(
        f"{round_ratio(sum_if(f'combination = {chr(39)}{c}{chr(39)}'), '10 * ' + cnt_if(f'combination = {chr(39)}{c}{chr(39)}'))} AS {c}"
        for c in COMBOS) + " FROM results WHERE category IS NOT NULL GROUP BY category")


@q("dashboard_pivot")
def dashboard_pivot(spark, sf):
    return boards.dashboard_pivot(carriers.results(spark, sf))


_cells = ", ".join(
    f"{round_ratio(sum_if(f'combination = {chr(39)}{c}{chr(39)}'), '10 * ' + cnt_if(f'combination = {chr(39)}{c}{chr(39)}'))} AS {c}"
    for c in COMBOS)
_tot = " + ".join(f"COALESCE({c}, 0.0)" for c in COMBOS)
_cnt = " + ".join(f"(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)" for c in COMBOS)
SQL["dashboard_pivot"] = with_results(f"""
, p AS (SELECT framework || '/' || mode AS fw_mode, {_cells} FROM results GROUP BY framework || '/' || mode)
SELECT fw_mode, {', '.join(COMBOS)}, {round_half_up(f'({_tot}) / CAST({_cnt} AS DOUBLE)')} AS overall FROM p""")


# --- A12 reliability ------------------------------------------------------------
@q("reliability_stats")
def reliability_stats(spark, sf):
    return boards.reliability_stats(carriers.results(spark, sf))


SQL["reliability_stats"] = with_results(f"""
SELECT framework || '/' || mode AS fw_mode, count(*) AS total, {cnt_if('success')} AS success,
       {round_ratio('sum(t10)', '10 * count(*)')} AS avg_score,
       {round_ratio('sum(CAST(round(latency_ms * 10) AS BIGINT))', '10 * count(*)')} AS avg_latency,
       count(*) - {cnt_if('success')} AS fail,
       {round_ratio('(count(*) - ' + cnt_if('success') + ') * 100', 'count(*)')} AS fail_rate
FROM results GROUP BY framework || '/' || mode""")


# --- A19 / L3 ranking -------------------------------------------------------------
@q("rank_modes")
def rank_modes(spark, sf):
    return boards.rank_modes(carriers.results(spark, sf))


SQL["rank_modes"] = with_results(f"""
, a AS (SELECT combination, framework, mode, {cnt_if('success')} AS n_ok, count(*) AS n,
               {sum_if('success')} AS s, {sum_if('success', 'CAST(round(latency_ms * 10) AS BIGINT)')} AS lat10
        FROM results GROUP BY combination, framework, mode),
b AS (SELECT combination, framework, mode, n_ok, n, {ratio('s', 'n_ok * 10')} AS avg_score,
             {ratio('lat10', 'n_ok * 10')} AS avg_latency FROM a)
SELECT *, CAST(row_number() OVER (PARTITION BY combination ORDER BY (n_ok = 0) ASC, avg_score DESC NULLS LAST,
                             framework, mode) AS INTEGER) AS rank FROM b""")


# --- A16 / A17 / A18 / L7 ------------------------------------------------------------
@q("distributions")
def distributions(spark, sf):
    return boards.distributions(carriers.samples(spark, sf), ["category", "true_depth", "domain"])


SQL["distributions"] = with_results("""
SELECT 'category' AS dimension, CAST(category AS VARCHAR) AS value, count(*) AS n FROM samples GROUP BY category
UNION ALL SELECT 'true_depth', CAST(true_depth AS VARCHAR), count(*) FROM samples GROUP BY true_depth
UNION ALL SELECT 'domain', CAST(domain AS VARCHAR), count(*) FROM samples GROUP BY domain""")


@q("distinct_values")
def distinct_values(spark, sf):
    r = carriers.results(spark, sf).withColumn("fw_mode", selection.fw_mode(F.col("framework")))
    return boards.distinct_values(r, ["category", "domain", "true_depth", "model", "dataset", "fw_mode"])


SQL["distinct_values"] = with_results("""
SELECT DISTINCT 'category' AS dimension, CAST(category AS VARCHAR) AS value FROM results
UNION SELECT DISTINCT 'domain', CAST(domain AS VARCHAR) FROM results
UNION SELECT DISTINCT 'true_depth', CAST(true_depth AS VARCHAR) FROM results
UNION SELECT DISTINCT 'model', model FROM results
UNION SELECT DISTINCT 'dataset', dataset FROM results
UNION SELECT DISTINCT 'fw_mode', framework || '/' || mode FROM results""")


@q("models_label")
def models_label(spark, sf):
    return boards.models_label(carriers.results(spark, sf))


SQL["models_label"] = with_results("""
SELECT COALESCE(NULLIF(string_agg(model, ', ' ORDER BY model), ''), 'unknown') AS models
FROM (SELECT DISTINCT model FROM results WHERE model IS NOT NULL AND model <> '')""")


@q("mode_average_pos")
def mode_average_pos(spark, sf):
    return boards.mode_average_pos(carriers.results(spark, sf))


SQL["mode_average_pos"] = with_results(f"""
SELECT dataset, framework, mode, {cnt_if('score_pct > 0')} AS n_ok,
       {ratio(sum_if('score_pct > 0'), '10 * ' + cnt_if('score_pct > 0'))} AS avg_ok
FROM results GROUP BY dataset, framework, mode""")


def _positive_matrix_sql(group: str) -> str:
    cells = []
    for c, *_rest in dims.COMBINATIONS:
        here = f"combination = '{c}'"
        cells.append(f"COALESCE(CAST(sum(CASE WHEN {here} AND t10 > 0 THEN t10 ELSE 0 END) AS DOUBLE) / "
                     f"NULLIF(CAST(sum(CASE WHEN {here} AND t10 > 0 THEN 10 ELSE 0 END) AS DOUBLE), 0), 0.0) AS {c}_avg, "
                     f"CAST(sum(CASE WHEN {here} AND t10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS {c}_fail")
    return with_results(f"SELECT {group}, {', '.join(cells)} FROM results GROUP BY {group}")


@q("category_matrix")
def category_matrix(spark, sf):
    return boards.positive_group_matrix(carriers.results(spark, sf), "category")


SQL["category_matrix"] = _positive_matrix_sql("category")


@q("depth_matrix")
def depth_matrix(spark, sf):
    return boards.positive_group_matrix(carriers.results(spark, sf), "true_depth")


SQL["depth_matrix"] = _positive_matrix_sql("true_depth")
