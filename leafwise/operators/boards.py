"""Leaderboards over a ``results`` table.

Input columns used (any subset per operator): dataset, model, combination,
framework, mode, sample_id, success, scored, score_pct, latency_ms, category,
domain, true_depth.  Every board is one hash aggregate (partial aggregation
map-side, then one shuffle on the few group keys); pivots list their values
explicitly so Spark never runs a distinct job to discover them.

Three notions of "ok" exist and are kept apart: ``scored`` (run statistics),
``success`` (summary matrix, combination average, breakdowns, reliability)
and ``score_pct > 0`` (published Overall and the *_ok variants).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafwise.functions.stats import ci95, ratio, round_half_up, round_ratio, tenths
from leafwise.sources import dims

COMBO_IDS = [c[0] for c in dims.COMBINATIONS]


def _t(df: DataFrame) -> Column:
    return tenths(F.col("score_pct"))


def _sum_if(cond: Column, val: Column) -> Column:
    return F.sum(F.when(cond, val).otherwise(F.lit(0)))


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")


def run_stats(results: DataFrame) -> DataFrame:
    """Per mode × combination: success-only mean, all-rows mean, failures (ok = scored)."""
    t = _t(results)
    agg = results.groupBy("framework", "mode", "combination").agg(
        F.count(F.lit(1)).alias("n_tests"),
        _count_if(F.col("scored")).alias("n_ok"),
        _sum_if(F.col("scored"), t).alias("s_ok"),
        F.sum(t).alias("s_all"),
    )
    return agg.select(
        "framework", "mode", "combination", "n_tests",
        F.coalesce(ratio(F.col("s_ok"), F.col("n_ok") * 10), F.lit(0.0)).alias("avg_ok"),
        ratio(F.col("s_all"), F.col("n_tests") * 10).alias("avg_all"),
        (F.col("n_tests") - F.col("n_ok")).alias("fail_count"),
    )


def summary_matrix(results: DataFrame, combo_ids: list[str] = COMBO_IDS) -> DataFrame:
    """Mode × combination pivot of success-only means and failure counts.

    ``<combo>_avg`` is NULL when every row of the cell failed (printed "ALL FAIL").
    """
    t = _t(results)
    ok = F.col("success")
    piv = (results.groupBy("framework", "mode").pivot("combination", combo_ids)
           .agg(_sum_if(ok, t).alias("s"), _count_if(ok).alias("k"), F.count(F.lit(1)).alias("n")))
    cols = [F.col("framework"), F.col("mode")]
    for c in combo_ids:
        cols.append(ratio(F.col(f"{c}_s"), F.col(f"{c}_k") * 10).alias(f"{c}_avg"))
        cols.append((F.col(f"{c}_n") - F.col(f"{c}_k")).alias(f"{c}_fail"))
    return piv.select(*cols)


def overall_ci(results: DataFrame) -> DataFrame:
    """Overall ± 95 % CI per mode, pooled over combinations that have ≥1 success,
    *including* the failed rows of those combinations (current runner formula).

    Two-level aggregation: per (mode, combination) partial sums, then combine —
    no window, no per-row state.
    """
    t = _t(results)
    cell = results.groupBy("framework", "mode", "combination").agg(
        F.count(F.lit(1)).alias("n"), F.sum(t).alias("s"), F.sum(t * t).alias("ss"),
        _count_if(F.col("success")).alias("k"))
    pooled = cell.filter(F.col("k") > 0).groupBy("framework", "mode").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    lo, hi = ci95(F.col("n"), F.col("s"), F.col("ss"))
    return pooled.select("framework", "mode", F.col("n").alias("n_pooled"),
                         ratio(F.col("s"), F.col("n") * 10).alias("overall"),
                         lo.alias("ci_low"), hi.alias("ci_high"))


def overall_ok(results: DataFrame) -> DataFrame:
    """Published Overall: success-only pooled mean with ok = score_pct > 0."""
    t = _t(results)
    ok = F.col("score_pct") > 0
    agg = results.groupBy("framework", "mode").agg(_sum_if(ok, t).alias("s"), _count_if(ok).alias("k"))
    return agg.select("framework", "mode", F.col("k").alias("n_ok"),
                      ratio(F.col("s"), F.col("k") * 10).alias("overall_ok"))


def combo_avg(results: DataFrame) -> DataFrame:
    """Per combination: mean over all rows (failures count as 0) + failures (not success)."""
    t = _t(results)
    agg = results.groupBy("combination").agg(F.count(F.lit(1)).alias("n"), F.sum(t).alias("s"),
                                             _count_if(~F.col("success")).alias("fail_count"))
    return agg.select("combination", "n", ratio(F.col("s"), F.col("n") * 10).alias("avg_all"), "fail_count")


def combo_avg_ok(results: DataFrame) -> DataFrame:
    """Per combination: ok-only means under both ok definitions, with ok/total counts."""
    t = _t(results)
    pos = F.col("score_pct") > 0
    succ = F.col("success")
    agg = results.groupBy("combination").agg(
        F.count(F.lit(1)).alias("n_total"),
        _count_if(pos).alias("n_pos"), _sum_if(pos, t).alias("s_pos"),
        _count_if(succ).alias("n_success"), _sum_if(succ, t).alias("s_success"))
    return agg.select("combination", "n_total", "n_pos", "n_success",
                      ratio(F.col("s_pos"), F.col("n_pos") * 10).alias("avg_pos"),
                      ratio(F.col("s_success"), F.col("n_success") * 10).alias("avg_success"))


def group_breakdown(results: DataFrame, group_col: str) -> DataFrame:
    """Group × combination: success-only mean (0 when none) and failures; rows with a
    NULL group are skipped (an all-NULL column yields an empty board)."""
    t = _t(results)
    succ = F.col("success")
    agg = (results.filter(F.col(group_col).isNotNull())
           .groupBy(group_col, "combination")
           .agg(F.count(F.lit(1)).alias("n"), _count_if(succ).alias("k"), _sum_if(succ, t).alias("s")))
    return agg.select(group_col, "combination",
                      F.coalesce(ratio(F.col("s"), F.col("k") * 10), F.lit(0.0)).alias("avg_ok"),
                      (F.col("n") - F.col("k")).alias("fail_count"))


def positive_breakdown(results: DataFrame, group_col: str) -> DataFrame:
    """Group breakdown with ok = score_pct > 0 (domain / category / depth tables)."""
    t = _t(results)
    pos = F.col("score_pct") > 0
    agg = results.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"), _count_if(pos).alias("n_ok"),
                                         _sum_if(pos, t).alias("s"))
    return agg.select(group_col, "n", "n_ok", ratio(F.col("s"), F.col("n_ok") * 10).alias("avg_ok"))


def positive_group_matrix(results: DataFrame, group_col: str, combo_ids: list[str] = COMBO_IDS) -> DataFrame:
    """Group × combination with ok = score_pct > 0: ``<combo>_avg`` over the ok rows (0 when none) and ``<combo>_fail``."""
    t = _t(results)
    pos = F.col("score_pct") > 0
    piv = (results.groupBy(group_col).pivot("combination", combo_ids)
           .agg(_sum_if(pos, t).alias("s"), _count_if(pos).alias("k"), F.count(F.lit(1)).alias("n")))
    cols = []
    for c in combo_ids:
        k, n = F.coalesce(F.col(f"{c}_k"), F.lit(0)), F.coalesce(F.col(f"{c}_n"), F.lit(0))
        cols += [F.coalesce(ratio(F.col(f"{c}_s"), k * 10), F.lit(0.0)).alias(f"{c}_avg"), (n - k).alias(f"{c}_fail")]
    return piv.select(group_col, *cols)


def group_pivot(results: DataFrame, group_col: str, combo_ids: list[str] = COMBO_IDS) -> DataFrame:
    """Dashboard group × combination mean (all rows, NULL groups excluded), rounded to 1 digit."""
    t = _t(results)
    piv = (results.filter(F.col(group_col).isNotNull()).groupBy(group_col).pivot("combination", combo_ids)
           .agg(F.sum(t).alias("s"), F.count(F.lit(1)).alias("n")))
    return piv.select(group_col, *[round_ratio(F.col(f"{c}_s"), F.col(f"{c}_n") * 10, 1).alias(c)
                                   for c in combo_ids])


def dashboard_pivot(results: DataFrame, combo_ids: list[str] = COMBO_IDS) -> DataFrame:
    """fw_mode × combination mean score (all rows) rounded to 1 digit; ``Overall`` is the
    unweighted mean of the *rounded* combination means that exist, rounded to 1 digit; best first."""
    t = _t(results)
    fm = F.concat_ws("/", "framework", "mode").alias("fw_mode")
    piv = (results.groupBy(fm).pivot("combination", combo_ids)
           .agg(F.sum(t).alias("s"), F.count(F.lit(1)).alias("n")))
    cells = {c: round_ratio(F.col(f"{c}_s"), F.col(f"{c}_n") * 10, 1) for c in combo_ids}
    out = piv.select("fw_mode", *[v.alias(c) for c, v in cells.items()])
    total = None
    cnt = None
    for c in combo_ids:
        v = F.coalesce(F.col(c), F.lit(0.0))
        k = F.when(F.col(c).isNotNull(), F.lit(1)).otherwise(F.lit(0))
        total = v if total is None else total + v
        cnt = k if cnt is None else cnt + k
    return out.withColumn("overall", round_half_up(total / cnt.cast("double"), 1)).orderBy(F.desc("overall"), "fw_mode")


def reliability_stats(results: DataFrame) -> DataFrame:
    """Per fw_mode: total, successes, mean score, mean latency, failures, failure rate %; best first."""
    t = _t(results)
    fm = F.concat_ws("/", "framework", "mode").alias("fw_mode")
    agg = results.groupBy(fm).agg(
        F.count(F.lit(1)).alias("total"), _count_if(F.col("success")).alias("success"),
        F.sum(t).alias("s"), F.sum(tenths(F.col("latency_ms"))).alias("lat10"))
    return agg.select(
        "fw_mode", "total", "success",
        round_ratio(F.col("s"), F.col("total") * 10, 1).alias("avg_score"),
        round_ratio(F.col("lat10"), F.col("total") * 10, 1).alias("avg_latency"),
        (F.col("total") - F.col("success")).alias("fail"),
        round_ratio((F.col("total") - F.col("success")) * 100, F.col("total"), 1).alias("fail_rate")).orderBy(
        F.desc("avg_score"), "fw_mode")


def rank_modes(results: DataFrame) -> DataFrame:
    """Per combination ranking of modes: modes with successes by mean score desc,
    all-failed modes appended (stable by name).  Ranking runs over the small
    per-(combination, mode) aggregate, never over raw rows."""
    t = _t(results)
    succ = F.col("success")
    agg = results.groupBy("combination", "framework", "mode").agg(
        _count_if(succ).alias("n_ok"), F.count(F.lit(1)).alias("n"), _sum_if(succ, t).alias("s"),
        _sum_if(succ, tenths(F.col("latency_ms"))).alias("lat10"))
    scored = agg.select("combination", "framework", "mode", "n_ok", "n",
                        ratio(F.col("s"), F.col("n_ok") * 10).alias("avg_score"),
                        ratio(F.col("lat10"), F.col("n_ok") * 10).alias("avg_latency"))
    w = Window.partitionBy("combination").orderBy(
        (F.col("n_ok") == 0).asc(), F.col("avg_score").desc_nulls_last(), "framework", "mode")
    return scored.withColumn("rank", F.row_number().over(w))


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(dimension, value) of several columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.inline(pairs))


def distributions(results_or_samples: DataFrame, cols: list[str]) -> DataFrame:
    """Long-form value counts of several columns: (dimension, value, n); one scan, counted map-side first."""
    return _long(results_or_samples, cols).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sorted distinct values of several columns as rows (never one giant array); one scan."""
    return _long(df, cols).distinct().orderBy("dimension", "value")


def models_label(results: DataFrame) -> DataFrame:
    """Sorted distinct model names joined with ", "; ``unknown`` when none.
    The distinct set is reduced before collection, so only the few model names
    reach the final single-row aggregate."""
    m = results.select("model").filter(F.col("model").isNotNull() & (F.col("model") != "")).distinct()
    return m.agg(F.coalesce(F.nullif(F.array_join(F.sort_array(F.collect_list("model")), ", "), F.lit("")),
                            F.lit("unknown")).alias("models"))


def mode_average_pos(results: DataFrame) -> DataFrame:
    """Per (dataset, fw, mode) mean with ok = score_pct > 0."""
    t = _t(results)
    pos = F.col("score_pct") > 0
    agg = results.groupBy("dataset", "framework", "mode").agg(_count_if(pos).alias("n_ok"),
                                                              _sum_if(pos, t).alias("s"))
    return agg.select("dataset", "framework", "mode", "n_ok", ratio(F.col("s"), F.col("n_ok") * 10).alias("avg_ok"))


def field_score_board(leaf_scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hardest fields first: mean leaf score per field path (optionally per extra keys)."""
    keys = ["path"] + (by or [])
    return (leaf_scores.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg_score"))
            .orderBy(F.col("avg_score").asc(), *keys))


def field_mode_pivot(leaf_scores: DataFrame, modes: list[str]) -> DataFrame:
    """Field × mode mean leaf score (3 digits) with ``avg``, the mean over the modes that have the field (3 digits);
    hardest fields first.  leaf_scores: path, fw_mode, score."""
    piv = leaf_scores.groupBy("path").pivot("fw_mode", modes).agg(F.avg("score"))
    cells = [F.round(F.col(f"`{m}`"), 3).alias(m) for m in modes]
    out = piv.select("path", *cells)
    there = F.filter(F.array(*[F.col(f"`{m}`") for m in modes]), lambda x: x.isNotNull())
    mean = F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there)
    return out.withColumn("avg", F.round(mean, 3)).orderBy("avg", "path")
