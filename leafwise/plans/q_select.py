"""Selection, sampling, grid and resume queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafwise.operators import grid, selection
from leafwise.plans import carriers, docs
from leafwise.plans.oracle_base import catalogue_values, with_results
from leafwise.sources import dims

Q: dict = {}
SQL: dict = {}

SEED = 42
CATS = ["1-URGENT", "2-HIGH", "5-LOW"]
DONE_MODES = 8          # modes with index < 8 count as already saved in a previous run


def q(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


def hash_key():
    """Order key that both engines can repeat: sixty bits of the MD5 of seed and id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), "id").cast("binary")), 1, 15), 16, 10).cast("long")


HASH_KEY_SQL = f"CAST('0x' || substr(md5('{SEED}:' || id), 1, 15) AS BIGINT)"


@q("sample_filters")
def sample_filters(spark, sf):
    s = carriers.samples(spark, sf)
    out = selection.filter_samples(s, CATS, min_depth=4, max_depth=6, max_text_length=75)
    return out.select("id", "category", "true_depth", F.length("text").alias("text_len"))


SQL["sample_filters"] = with_results(f"""
SELECT id, category, true_depth, CAST(length(text) AS INTEGER) AS text_len FROM samples
WHERE category IN ({', '.join(repr(c) for c in CATS)}) AND true_depth BETWEEN 4 AND 6 AND length(text) <= 75""")


@q("seeded_sample")
def seeded_sample(spark, sf):
    s = carriers.samples(spark, sf)
    return selection.seeded_sample(s, 500, hash_key()).select("id", "category")


SQL["seeded_sample"] = with_results(f"""
SELECT id, category FROM samples ORDER BY {HASH_KEY_SQL}, id LIMIT 500""")


@q("large_sample")
def large_sample(spark, sf):
    """Four fifths of all samples: more than one task should sort."""
    s = carriers.samples(spark, sf)
    return selection.smallest_by_key(s, s.count() * 4 // 5, hash_key()).select("id", "category")


SQL["large_sample"] = with_results(f"""
SELECT id, category FROM samples ORDER BY {HASH_KEY_SQL}, id LIMIT (SELECT count(*) * 4 // 5 FROM samples)""")


@q("stratified_cap")
def stratified_cap(spark, sf):
    s = carriers.samples(spark, sf)
    return selection.stratified_cap(s, "category", 50, hash_key()).select("id", "category")


SQL["stratified_cap"] = with_results(f"""
SELECT id, category FROM (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY {HASH_KEY_SQL}, id) rn
FROM samples) WHERE rn <= 50""")

TOKENS = ["instructor", "openai/default", "nosuch", "marvin/nonexistent"]


@q("mode_selector")
def mode_selector(spark, sf):
    sel = selection.select_modes(spark, TOKENS)
    counts = carriers.results(spark, sf).groupBy("framework", "mode").agg(F.count(F.lit(1)).alias("n"))
    return (sel.join(counts, ["framework", "mode"], "left")
            .select("framework", "mode", F.coalesce(F.col("n"), F.lit(0)).alias("n")))


SQL["mode_selector"] = with_results(f"""
, cat AS ({catalogue_values()}),
sel AS (SELECT DISTINCT framework, mode FROM cat WHERE framework = 'instructor'
        UNION ALL SELECT 'openai', 'default' UNION ALL SELECT 'marvin', 'nonexistent'),
cnt AS (SELECT framework, mode, count(*) AS n FROM results GROUP BY framework, mode)
SELECT s.framework, s.mode, COALESCE(c.n, 0) AS n FROM sel s LEFT JOIN cnt c USING (framework, mode)""")


@q("combo_filter")
def combo_filter(spark, sf):
    r = selection.board_filters(carriers.results(spark, sf), combinations=["A_desc", "C_rich"])
    return r.groupBy("combination").agg(F.count(F.lit(1)).alias("n"),
                                        F.sum(F.col("success").cast("int")).cast("long").alias("n_success"))


SQL["combo_filter"] = with_results("""
SELECT combination, count(*) AS n, CAST(sum(CAST(success AS INTEGER)) AS BIGINT) AS n_success
FROM results WHERE combination IN ('A_desc', 'C_rich') GROUP BY combination""")


@q("default_alias_filter")
def default_alias_filter(spark, sf):
    modes = selection.runnable_modes(spark)
    counts = carriers.results(spark, sf).groupBy("framework", "mode").agg(F.count(F.lit(1)).alias("n"))
    return (modes.join(counts, ["framework", "mode"], "left")
            .select("framework", "mode", F.coalesce(F.col("n"), F.lit(0)).alias("n")))


def _supported_values():
    from leafwise.sources import dims
    rows = ", ".join(f"('{fw}', '{m}')" for fw, ms in dims.SUPPORTED_MODES.items() for m in ms)
    return f"SELECT * FROM (VALUES {rows}) t(framework, mode)"


SQL["default_alias_filter"] = with_results(f"""
, sm AS ({_supported_values()}),
keep AS (SELECT framework, mode FROM (SELECT *, count(*) OVER (PARTITION BY framework) AS k FROM sm)
         WHERE k = 1 OR mode <> 'default'),
cnt AS (SELECT framework, mode, count(*) AS n FROM results GROUP BY framework, mode)
SELECT k.framework, k.mode, COALESCE(c.n, 0) AS n FROM keep k LEFT JOIN cnt c USING (framework, mode)""")


@q("display_map")
def display_map(spark, sf):
    r = selection.with_display_combination(carriers.results(spark, sf))
    return r.groupBy("combination").agg(F.count(F.lit(1)).alias("n"))


SQL["display_map"] = with_results("""
SELECT CASE combination WHEN 'A_desc' THEN 'Prompt(min) + Desc(O)' WHEN 'B_nodesc' THEN 'Prompt(min) + Desc(X)'
            WHEN 'C_rich' THEN 'Prompt(rich) + Desc(X)' WHEN 'D_both' THEN 'Prompt(rich) + Desc(O)'
            ELSE combination END AS combination, count(*) AS n
FROM results GROUP BY 1""")


@q("derived_keys")
def derived_keys(spark, sf):
    r = carriers.results(spark, sf)
    fm = selection.fw_mode(r)
    sk = F.concat_ws("/", "domain", "schema_name")
    return r.select(fm.alias("fw_mode"), selection.safe_name(fm).alias("fw_mode_safe"),
                    sk.alias("schema_key"), selection.safe_name(sk).alias("schema_key_safe")).distinct()


SQL["derived_keys"] = with_results("""
SELECT DISTINCT framework || '/' || mode AS fw_mode, translate(framework || '/' || mode, '/-.', '___') AS fw_mode_safe,
       domain || '/' || schema_name AS schema_key, translate(domain || '/' || schema_name, '/-.', '___') AS schema_key_safe
FROM results""")


@q("test_grid")
def test_grid(spark, sf):
    g = grid.expand_grid(carriers.samples(spark, sf), carriers.grid_catalogue())
    return g.groupBy("combination", "framework", "mode").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))


SQL["test_grid"] = with_results(f"""
SELECT c.combination, c.framework, c.mode, count(*) AS n, min(s.id) AS min_id, max(s.id) AS max_id
FROM samples s CROSS JOIN ({catalogue_values()}) c GROUP BY c.combination, c.framework, c.mode""")


@q("resume_anti")
def resume_anti(spark, sf):
    res = carriers.results(spark, sf)
    done = res.filter(F.col("mode_idx") < DONE_MODES)
    g = grid.expand_grid(carriers.samples(spark, sf), carriers.grid_catalogue())
    return (grid.remaining_work(g, done).groupBy("framework", "mode", "combination")
            .agg(F.count(F.lit(1)).alias("n_remaining")))


SQL["resume_anti"] = with_results(f"""
, g AS (SELECT s.id, c.* FROM samples s CROSS JOIN ({catalogue_values()}) c),
done AS (SELECT DISTINCT framework, mode FROM results WHERE mode_idx < {DONE_MODES})
SELECT framework, mode, combination, count(*) AS n_remaining FROM g
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.framework = g.framework AND d.mode = g.mode)
GROUP BY framework, mode, combination""")


@q("resume_semi")
def resume_semi(spark, sf):
    s = carriers.samples(spark, sf)
    saved = selection.seeded_sample(s, 500, hash_key()).select(F.col("id").alias("sample_id"))
    return grid.restrict_to_saved(s, saved).select("id", "category", "true_depth")


SQL["resume_semi"] = with_results(f"""
, saved AS (SELECT id AS sample_id FROM samples ORDER BY {HASH_KEY_SQL}, id LIMIT 500)
SELECT id, category, true_depth FROM samples WHERE EXISTS (SELECT 1 FROM saved WHERE saved.sample_id = samples.id)""")


@q("resume_union")
def resume_union(spark, sf):
    res = carriers.results(spark, sf).select(*grid.GRAIN, "score_pct", "mode_idx")
    old = res.filter(F.col("mode_idx") < DONE_MODES)
    new = (res.filter(F.col("mode_idx") >= DONE_MODES - 2)
           .withColumn("score_pct", F.least(F.col("score_pct") + 1.0, F.lit(100.0))))
    merged = grid.merge_results(old, new)
    return merged.groupBy("framework", "mode").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("score_pct") * 10).cast("long")).alias("s10"))


SQL["resume_union"] = with_results(f"""
, old AS (SELECT * FROM results WHERE mode_idx < {DONE_MODES}),
new AS (SELECT dataset, model, combination, framework, mode, sample_id, least(score_pct + 1.0, 100.0) AS score_pct
        FROM results WHERE mode_idx >= {DONE_MODES - 2}),
merged AS (SELECT dataset, model, combination, framework, mode, sample_id, score_pct FROM old o
           WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.dataset = o.dataset AND n.model = o.model
             AND n.combination = o.combination AND n.framework = o.framework AND n.mode = o.mode
             AND n.sample_id = o.sample_id)
           UNION ALL SELECT * FROM new)
SELECT framework, mode, count(*) AS n, CAST(sum(CAST(round(score_pct * 10) AS BIGINT)) AS BIGINT) AS s10
FROM merged GROUP BY framework, mode""")


@q("resume_skipped")
def resume_skipped(spark, sf):
    res = carriers.results(spark, sf)
    done = res.filter(F.col("mode_idx") < DONE_MODES)
    g = grid.expand_grid(carriers.samples(spark, sf), carriers.grid_catalogue())
    return (grid.skipped_work(g, done).groupBy("framework", "mode")
            .agg(F.count(F.lit(1)).alias("n_skipped")))


SQL["resume_skipped"] = with_results(f"""
, g AS (SELECT s.id, c.* FROM samples s CROSS JOIN ({catalogue_values()}) c),
done AS (SELECT DISTINCT framework, mode FROM results WHERE mode_idx < {DONE_MODES})
SELECT framework, mode, count(*) AS n_skipped FROM g
WHERE EXISTS (SELECT 1 FROM done d WHERE d.framework = g.framework AND d.mode = g.mode)
GROUP BY framework, mode""")


@q("board_filter")
def board_filter(spark, sf):
    """Dataset, combination and framework/mode filters together, on results whose dataset is their run folder."""
    r = carriers.results(spark, sf).withColumn("_source", F.concat(F.lit("run"), F.col("o_orderkey") % 3)).drop("dataset")
    r = selection.board_filters(selection.with_dataset_fallback(r), ["run0", "run2"], ["A_desc"], ["openai/default", "marvin/cast"])
    return r.groupBy("dataset", "framework", "mode").agg(F.count(F.lit(1)).alias("n"))


SQL["board_filter"] = with_results("""
SELECT 'run' || CAST(o_orderkey % 3 AS VARCHAR) AS dataset, framework, mode, count(*) AS n FROM results
WHERE o_orderkey % 3 IN (0, 2) AND combination = 'A_desc' AND framework || '/' || mode IN ('openai/default', 'marvin/cast')
GROUP BY 1, 2, 3""")


@q("missing_saved")
def missing_saved(spark, sf):
    """Ids of a saved run that the source no longer has."""
    s = carriers.samples(spark, sf)
    return grid.missing_saved(s.where("o_orderkey % 10 <> 3"), s.select(F.col("id").alias("sample_id")))


SQL["missing_saved"] = with_results("SELECT id AS sample_id FROM samples WHERE o_orderkey % 10 = 3")


@q("ground_truth_default")
def ground_truth_default(spark, sf):
    s = carriers.samples(spark, sf)
    truths = s.where("o_orderkey % 4 <> 1").select("id", F.parse_json(F.concat(F.lit('{"k":'), "o_orderkey", F.lit("}"))).alias("ground_truth"))
    return grid.ground_truth_or_empty(s.select("id"), truths, "id").select("id", F.to_json("ground_truth").alias("ground_truth"))


SQL["ground_truth_default"] = with_results("""
SELECT id, CASE WHEN o_orderkey % 4 = 1 THEN '{}' ELSE '{"k":' || CAST(o_orderkey AS VARCHAR) || '}' END AS ground_truth FROM samples""")


@q("mode_catalogue")
def mode_catalogue(spark, sf):
    """Frameworks with their modes, and the rows that the results hold for each framework."""
    rows = carriers.results(spark, sf).groupBy("framework").agg(F.count(F.lit(1)).alias("n"))
    cat = selection.mode_catalogue(spark).select("framework", F.array_join(F.sort_array("modes"), ",").alias("modes"))
    return cat.join(rows, "framework", "left")


SQL["mode_catalogue"] = with_results(f"""
, sm AS ({_supported_values()}), n AS (SELECT framework, count(*) AS n FROM results GROUP BY framework)
SELECT sm.framework, string_agg(sm.mode, ',' ORDER BY sm.mode) AS modes, any_value(n.n) AS n FROM sm LEFT JOIN n USING (framework) GROUP BY sm.framework""")


@q("prompt_lookup")
def prompt_lookup(spark, sf):
    """A prompt template by name beside every sample's text: length of the request's two messages."""
    p = dims.prompt(spark, PROMPT_NAME).first()
    return carriers.samples(spark, sf).select("id", F.lit(p["name"]).alias("name"), F.lit(p["version"]).alias("version"),
                                              (F.length(F.lit(p["system_prompt"])) + F.length("text")).alias("chars"))


PROMPT_NAME = min(p[0] for p in dims.PROMPTS)
_PROMPT = min(dims.PROMPTS)
SQL["prompt_lookup"] = with_results(f"""
SELECT id, '{_PROMPT[0]}' AS name, '{_PROMPT[2]}' AS version, CAST({len(_PROMPT[3])} + length(text) AS INTEGER) AS chars FROM samples""")


@q("pruned_predictions")
def pruned_predictions(spark, sf):
    """Results without their documents, as a run that does not save predictions writes them."""
    r = carriers.results(spark, sf).withColumns({"ground_truth": F.lit("{}"), "predicted": F.lit("{}"), "field_scores": F.lit("{}")})
    out = selection.drop_predictions(r)
    bulky = len(set(out.columns) & {"ground_truth", "predicted", "field_scores"})
    return out.groupBy("framework").agg(F.count(F.lit(1)).alias("n"), F.lit(bulky).alias("bulky_columns"))


SQL["pruned_predictions"] = with_results("SELECT framework, count(*) AS n, 0 AS bulky_columns FROM results GROUP BY framework")


@q("sample_modes")
def sample_modes(spark, sf):
    """Detail view of one sample: what every mode predicted."""
    return selection.detail_view(carriers.results(spark, sf), docs.document_pairs(spark, sf), DETAIL_ID,
                                 {"$.status": "string", "$.priority": "string", "$.totalprice": "double"})


DETAIL_ID = "ord_12"
SQL["sample_modes"] = with_results(f"""
SELECT sample_id, combination, framework, mode, success, o_orderstatus AS gt_status, o_orderpriority AS gt_priority, o_totalprice AS gt_totalprice,
       CASE WHEN success THEN CASE WHEN o.o_orderkey % 4 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END END AS pred_status,
       CASE WHEN success THEN CASE WHEN o.o_orderkey % 6 = 0 THEN '3-MEDIUM' ELSE o_orderpriority END END AS pred_priority,
       CASE WHEN success THEN CAST(floor(CAST(CAST(round(o_totalprice * 100.0) AS BIGINT) * (100 + o.o_orderkey % 9) AS DOUBLE) / 100)
            AS DOUBLE) / 100.0 END AS pred_totalprice
FROM results JOIN orders o ON o.o_orderkey = results.o_orderkey WHERE sample_id = '{DETAIL_ID}'""")
