"""Filters, selectors, derived keys and sampling.

Filters are plain Catalyst predicates so they push into the Parquet scan.
Sampling orders by a deterministic hash of (seed, id), so it is independent
of the partitioning and repeatable on any cluster size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafwise.functions.values import truthy
from leafwise.sources import dims

TAKE_ORDERED = 10_000       # rows that one task may sort
DIGIT_BITS = 12


def filter_samples(samples: DataFrame, categories: list[str] | None = None,
                   min_depth: int | None = None, max_depth: int | None = None,
                   max_text_length: int = 0) -> DataFrame:
    """Category IN-list (empty/None = no filter), inclusive depth range, and
    max text length in characters (0 disables)."""
    out = samples
    if categories:
        out = out.filter(F.col("category").isin(list(categories)))
    if min_depth is not None:
        out = out.filter(F.col("true_depth") >= min_depth)
    if max_depth is not None:
        out = out.filter(F.col("true_depth") <= max_depth)
    if max_text_length and max_text_length > 0:
        out = out.filter(F.length("text") <= max_text_length)
    return out


def sample_key(seed: int | None, id_col: str = "id") -> Column:
    """Deterministic pseudo-random order key; ``seed=None`` draws a fresh seed."""
    if seed is None:
        import random
        seed = random.randrange(1 << 31)
    return F.xxhash64(F.lit(seed), F.col(id_col))


def seeded_sample(df: DataFrame, n: int | None, order_key: Column, id_col: str = "id") -> DataFrame:
    """Exactly ``n`` rows without replacement, only when there are more than ``n``.

    A small sample runs as TakeOrderedAndProject (per-partition top-n, then one merge of n·partitions rows); a large
    one finds its largest key first (``smallest_by_key``), so that no task holds the sample.  The rows are the same.
    """
    if not n or n <= 0:
        return df
    if n > TAKE_ORDERED:
        return smallest_by_key(df, n, order_key, id_col)
    return df.orderBy(order_key, F.col(id_col)).limit(n)


def smallest_by_key(df: DataFrame, n: int, order_key: Column, id_col: str = "id") -> DataFrame:
    """The ``n`` rows that come first by (order_key LONG, id), each row decided where it stands.

    The n-th key is found from its leading bits on: one histogram of ``DIGIT_BITS`` more bits per pass, over the rows
    that share the bits found so far, until few rows share them.  Rows below those bits belong to the sample; only
    the few that share them are sorted."""
    # Order of signed keys as unsigned numbers.
    keyed = df.withColumn("_key", order_key.cast("long"))
    bits = F.col("_key").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    shift, among, left, inside = 64, None, n, None
    while shift > 0:
        step = min(DIGIT_BITS, shift)
        shift -= step
        digit = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << step) - 1))
        rows = keyed if among is None else keyed.where(among)
        counts = sorted((r["d"], r["count"]) for r in rows.groupBy(digit.alias("d")).count().collect())
        if among is None and sum(c for _, c in counts) <= n:
            return df
        for d, c in counts:
            if left <= c:
                break
            left -= c
        below = digit < d if among is None else among & (digit < d)
        inside = below if inside is None else inside | below
        among = digit == d if among is None else among & (digit == d)
        if c <= TAKE_ORDERED:
            break
    edge = keyed.where(among).orderBy("_key", id_col).limit(left)
    return keyed.where(inside).unionByName(edge).drop("_key")


def stratified_cap(df: DataFrame, group_col: str, per_group: int, order_key: Column,
                   id_col: str = "id") -> DataFrame:
    """At most ``per_group`` rows per group, picked by ``order_key``.

    ``row_number() <= k`` is planned with a window group-limit that keeps only the
    top k per group inside every map task before the shuffle, so a hot group
    sends at most k rows per task.
    """
    w = Window.partitionBy(group_col).orderBy(order_key, F.col(id_col))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= per_group).drop("_rn")


def select_modes(spark: SparkSession, tokens: list[str] | None) -> DataFrame:
    """Mode selector: ``fw/mode`` (not validated), bare ``fw`` = all its default
    modes (unknown bare names are dropped), ``all``/empty = every default mode."""
    catalogue = dims.modes(spark).select("framework", "mode")
    if not tokens or tokens == ["all"]:
        return catalogue
    toks = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "tok_idx INT, token STRING")
    parts = F.split(F.col("token"), "/", 2)
    explicit = (toks.filter(F.col("token").contains("/"))
                .select("tok_idx", parts[0].alias("framework"), parts[1].alias("mode")))
    bare = (toks.filter(~F.col("token").contains("/"))
            .join(F.broadcast(catalogue), F.col("token") == F.col("framework"))
            .select("tok_idx", "framework", "mode"))
    return explicit.unionByName(bare).drop("tok_idx")


def runnable_modes(spark: SparkSession) -> DataFrame:
    """Per adapter, its modes with the ``default`` alias dropped unless it is the only one."""
    sm = dims.supported_modes(spark)
    w = Window.partitionBy("framework")
    return (sm.withColumn("_n", F.count(F.lit(1)).over(w))
            .filter((F.col("_n") == 1) | (F.col("mode") != "default")).drop("_n"))


def mode_catalogue(spark: SparkSession) -> DataFrame:
    """Framework names (sorted) with their supported modes."""
    return (dims.supported_modes(spark).groupBy("framework")
            .agg(F.collect_list("mode").alias("modes")).orderBy("framework"))


def with_display_combination(df: DataFrame) -> DataFrame:
    """Map combination ids to display names; unknown ids map to themselves."""
    m = F.create_map(*[x for kv in dims.COMBO_DISPLAY.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return df.withColumn("combination", F.coalesce(m[F.col("combination")], F.col("combination")))


def fw_mode(df: DataFrame) -> Column:
    return F.concat_ws("/", "framework", "mode")


def safe_name(c: Column) -> Column:
    """'/', '-' and '.' replaced by '_' (file / model names)."""
    return F.translate(c, "/-.", "___")


def with_dataset_fallback(df: DataFrame) -> DataFrame:
    """``dataset`` := ``_source`` when the column is absent."""
    if "dataset" not in df.columns and "_source" in df.columns:
        return df.withColumn("dataset", F.col("_source"))
    return df


def error_projection(success: Column, error: Column) -> Column:
    """The error of a failed row ('' when it has none), NULL on success; whole, as reports cut it themselves."""
    return F.when(~success, F.coalesce(error, F.lit("")))


def short_error(error: Column, chars: int = 200) -> Column:
    """The beginning of an error for a report's column."""
    return F.substring(error, 1, chars)


def scored_flag(success: Column, data: Column) -> Column:
    """A row counts as scored when it succeeded and its document is not empty (``success`` itself stays)."""
    return success & F.coalesce(truthy(data), F.lit(False))


def drop_predictions(results: DataFrame) -> DataFrame:
    """Results without the bulky per-row documents (``--no-save-predictions``)."""
    return results.drop("ground_truth", "predicted", "field_scores")


def board_filters(results: DataFrame, datasets: list[str] | None = None, combinations: list[str] | None = None,
                  fw_modes: list[str] | None = None) -> DataFrame:
    out = results
    if datasets is not None:
        out = out.filter(F.col("dataset").isin(list(datasets)))
    if combinations is not None:
        out = out.filter(F.col("combination").isin(list(combinations)))
    if fw_modes is not None:
        out = out.filter(fw_mode(out).isin(list(fw_modes)))
    return out


def detail_view(results: DataFrame, documents: DataFrame, sample_id: str, fields: dict[str, str]) -> DataFrame:
    """One sample as every mode saw it: a row per (combination, framework, mode) with the fields (JSON path -> type) of the
    ground truth and, where the mode succeeded, of its prediction.  ``documents``: doc_key, gt, pred.  The id reaches
    both scans as a filter; a sample without ground truth has no rows."""
    doc = documents.where((F.col("doc_key") == sample_id) & F.col("gt").isNotNull())
    rows = results.where(F.col("sample_id") == sample_id).join(doc, F.col("sample_id") == F.col("doc_key"))
    shown = [c for path, kind in fields.items() for c in (
        F.try_variant_get("gt", path, kind).alias("gt_" + path.split(".")[-1]),
        F.when(F.col("success"), F.try_variant_get("pred", path, kind)).alias("pred_" + path.split(".")[-1]))]
    return rows.select("sample_id", "combination", "framework", "mode", "success", *shown)
