"""Operator 9, quality rules: robust multivariate outliers.

``document_statistics`` counts words, symbols, repeated lines and repeated 8-word windows of whole texts.
``mcd_models`` estimates centre and scatter of the transformed statistics by the minimum covariance
determinant for every (language, source), every language and all rows.  Distributed concentration steps, each
keeping the share ``support`` of rows that lie closest, run from several starts: medians with quartile ranges, and
small parts of the rows picked by a hash.  The start with the smallest determinant goes on until it no longer falls.
``quality_rules`` rejects a document by two plain rules or by its Mahalanobis distance.

Defined results: null text counts as empty (no words, so the plain rule rejects it); null language or
source forms a group of its own; a group under ``min_group`` rows uses the model of its language, and that
of all rows if the language is small as well; repeated rows are judged one by one; an empty table gives an
empty result; columns other than doc_id, text, lang and source are not read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.llm.common import documents, map_columns, saved, small

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbol_share", "dup_line_share", "repeat_share", "variety", "word_length", "capital_share"]
#: Smallest standard deviation that counts as natural spread, per feature: statistics that are constant in
#: most documents (no symbols, no repeated line) would otherwise make any deviation infinitely far.
SPREAD_FLOOR = [0.35, 0.08, 0.06, 0.05, 0.12, 0.08]
PART = 16                        # a start from a part of the rows takes one in so many
STATS_SCHEMA = ("doc_id long, text_hash long, lang string, source string, n_words long, word_chars long, n_symbols long, "
                "n_dup_lines long, n_repeat_words long, " + ", ".join(f"{f} double" for f in FEATURES))


def repeated_words(words: list[str]) -> int:
    """Words that lie in an 8-word window found at least twice in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    m = n - WINDOW + 1
    w = np.zeros(m, np.uint64)
    for k in range(WINDOW):
        w = w * np.uint64(0x9E3779B97F4A7C15) + (h[k:k + m] ^ (h[k:k + m] >> np.uint64(29)))
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.nonzero(np.isin(w, twice))[0]
    step = np.zeros(n + 1, np.int64)
    step[:m][at] += 1
    step[at + WINDOW] -= 1
    return int((np.cumsum(step[:n]) > 0).sum())


def text_statistics(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, *features) of one text."""
    t = text or ""
    words = WORD.findall(t)
    n = len(words)
    chars = len(t) - sum(map(t.count, BLANKS))
    symbols = sum(map(t.count, SYMBOLS))
    lines = [x for x in t.split("\n") if x.strip(BLANKS)]
    dup = len(lines) - len(set(lines))
    rep = repeated_words(words)
    if n == 0:
        return 0, 0, symbols, 0, 0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0
    distinct = len(set(words))
    capitals = sum(1 for w in words if w[0].isupper())
    return (n, chars, symbols, dup, rep,
            float(np.arcsinh(100.0 * symbols / chars)), dup / len(lines), rep / n,
            float(np.log(distinct + 1.0) / np.log(n + 1.0)), float(np.log(chars / n)), capitals / n)


def document_statistics(docs: DataFrame) -> DataFrame:
    """Counts and transformed statistics per row; one narrow pass over whole texts."""
    def start():
        def step(ids, marks, texts, langs, sources):
            cols = list(zip(*[text_statistics(t) for t in texts]))
            return {"doc_id": ids, "text_hash": marks, "lang": langs, "source": sources} | dict(zip(COUNTS + FEATURES, cols))
        return step
    return map_columns(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", "lang", "source"),
                       ["doc_id", "text_hash", "text", "lang", "source"], STATS_SCHEMA, start)


def _levels():
    """Model keys of a row, most specific first."""
    return [F.concat(F.lit("s"), F.to_json(F.struct("lang", "source"))),
            F.concat(F.lit("l"), F.to_json(F.struct("lang"))), F.lit("all")]


def _distance(p: int):
    """Squared Mahalanobis distance of the row's features under columns ``mu`` and ``prec``."""
    z = [F.col(f) - F.col("mu")[i] for i, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i in range(p):
        row = F.lit(0.0)
        for j in range(p):
            row = row + F.col("prec")[i * p + j] * z[j]
        total = total + z[i] * row
    return total


def _fit(sums: DataFrame) -> DataFrame:
    """Centre and inverse scatter per key and start from n, sums and the upper triangle of cross sums (one small row
    for each)."""
    p = len(FEATURES)
    floor = np.diag(np.square(SPREAD_FLOOR))
    upper = np.triu_indices(p)

    def start():
        def step(keys, starts, ns, s1s, s2s):
            mus, precs, dets = [], [], []
            for n, s1, s2 in zip(ns, s1s, s2s):
                mu = np.array(s1) / n
                cross = np.zeros((p, p))
                cross[upper] = s2
                cov = (cross + np.triu(cross, 1).T) / n - np.outer(mu, mu) + floor
                mus.append(mu.tolist())
                precs.append(np.linalg.inv(cov).ravel().tolist())
                dets.append(float(np.linalg.slogdet(cov)[1]))
            return {"key": keys, "start": starts, "mu": mus, "prec": precs, "log_det": dets}
        return step
    return map_columns(sums, ["key", "start", "n", "s1", "s2"],
                       "key string, start int, mu array<double>, prec array<double>, log_det double", start)


def _concentrated(rows: DataFrame, model: DataFrame, support: float) -> DataFrame:
    """One concentration step for every (key, start) of ``model``: the model of the rows that lie closest to it."""
    far = rows.join(small(model.select("key", "start", "mu", "prec")), "key").withColumn("d2", _distance(len(FEATURES)))
    edge = saved(far.groupBy("key", "start").agg(F.percentile_approx("d2", support, 1000).alias("edge")), "mcd")
    near = far.drop("mu", "prec").join(small(edge), ["key", "start"]).where("d2 <= edge")
    return saved(_fit(_sums(near)), "mcd")


def _sums(rows: DataFrame) -> DataFrame:
    cross = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(FEATURES) for b in FEATURES[i:]]
    return rows.groupBy("key", "start").agg(F.count("*").alias("n"), F.array(*[F.sum(f) for f in FEATURES]).alias("s1"),
                                            F.array(*cross).alias("s2"))


def mcd_models(stats: DataFrame, support: float = 0.75, starts: int = 3, trial_steps: int = 2, steps: int = 8,
               tolerance: float = 1e-3) -> DataFrame:
    """One row per model key: n, mu, prec (row-major inverse scatter), scale, log_det.

    ``starts`` models per key (the first from medians and quartile ranges, the others from one ``PART``-th of the
    rows each, by a hash) take ``trial_steps`` steps; the one with the smallest determinant goes on until no key's log
    determinant falls by more than ``tolerance``, ``steps`` further steps at most.  A key keeps the smallest
    determinant it met.

    Every step is two grouped aggregations with map-side partial sums, so a source that holds a third of all
    rows is summed in all tasks; only one row per key is ever gathered.  Models meet the rows by a broadcast
    while there are few keys (counted), else by a shuffle join."""
    p = len(FEATURES)
    part = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(PART)) + 1
    rows = stats.where("n_words > 0").select(F.explode(F.array(*_levels())).alias("key"), part.cast("int").alias("start"), *FEATURES)
    quart = F.array(*[F.percentile_approx(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000) for f in FEATURES])
    begin = rows.groupBy("key").agg(F.count("*").alias("n"), quart.alias("q"))
    precs = [F.lit(1.0) / (F.pow((F.col("q")[i][2] - F.col("q")[i][0]) / 1.349, 2) + SPREAD_FLOOR[i] ** 2)
             for i in range(p)]
    middle = saved(begin.select(
        "key", "n", F.lit(0).alias("start"), F.array(*[F.col("q")[i][1] for i in range(p)]).alias("mu"),
        F.array(*[precs[i] if i == j else F.lit(0.0) for i in range(p) for j in range(p)]).alias("prec")), "mcd")
    model = middle.drop("n")
    if starts > 1:
        model = saved(model.unionByName(_fit(_sums(rows.where(F.col("start") < starts))).select(*model.columns)), "mcd")
    rows = rows.drop("start")
    for _ in range(trial_steps):
        model = _concentrated(rows, model, support)
    model = saved(model.groupBy("key").agg(F.min(F.struct("log_det", "start", "mu", "prec")).alias("m"))
                  .select("key", "m.start", "m.mu", "m.prec", "m.log_det"), "mcd")
    for _ in range(steps):
        new = _concentrated(rows, model, support).select(
            "key", F.struct("start", "mu", "prec", "log_det").alias("new"))
        met = saved(model.join(new, "key", "left").withColumn("fall", F.col("log_det") - F.col("new.log_det")), "mcd")
        take = F.when(F.col("fall") > 0, F.col("new")).otherwise(F.struct("start", "mu", "prec", "log_det"))
        model = met.select("key", take.alias("m")).select("key", "m.*")
        if met.where(F.col("fall") > tolerance).isEmpty():
            break
    far = rows.join(small(model.select("key", "mu", "prec")), "key").withColumn("d2", _distance(p))
    scale = far.groupBy("key").agg(F.percentile_approx("d2", 0.5, 1000).alias("half"))
    # Median of chi squared with p degrees of freedom (Wilson and Hilferty).
    chi_half = p * (1 - 2 / (9 * p)) ** 3
    return saved(model.join(middle.select("key", "n"), "key").join(scale, "key")
                 .withColumn("scale", F.greatest(F.lit(1.0), F.col("half") / chi_half))
                 .select("key", "n", "mu", "prec", "scale", "log_det"), "mcd")


def quality_rules(docs: DataFrame, cutoff: float = 45.0, min_group: int = 60, support: float = 0.75) -> DataFrame:
    """Columns doc_id, text_hash, lang, source, the five counts, base_failed, distance (squared, scaled; null
    without words), kept.

    ``cutoff`` is the largest squared distance kept; 45 leaves out about 5e-8 of a normal population in six
    dimensions, so only documents far outside their group's bulk go."""
    p = len(FEATURES)
    stats = saved(document_statistics(docs), "stats")
    model = mcd_models(stats, support)
    usable = saved(model.where(F.col("n") >= min_group), "mcd")
    # The model of all rows is one row; it comes as literals.
    whole = model.where("key = 'all'").first()
    every = F.lit(None).cast("struct<mu:array<double>,prec:array<double>,scale:double>") if whole is None else F.struct(
        F.array(*map(F.lit, whole.mu)).alias("mu"), F.array(*map(F.lit, whole.prec)).alias("prec"), F.lit(whole.scale).alias("scale"))
    out = stats
    for i, key in enumerate(_levels()[:-1]):
        out = out.withColumn(f"key{i}", key).join(small(usable.select(
            F.col("key").alias(f"key{i}"), F.struct("mu", "prec", "scale").alias(f"m{i}"))), f"key{i}", "left")
    out = (out.withColumn("m", F.coalesce("m0", "m1", every))
           .withColumns({"mu": F.col("m.mu"), "prec": F.col("m.prec"), "scale": F.col("m.scale")})
           .withColumn("distance", F.when(F.col("n_words") > 0, _distance(p) / F.col("scale"))))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select("doc_id", "text_hash", "lang", "source", *COUNTS, failed.alias("base_failed"), "distance",
                      (~failed & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(documents(spark, sf_dir, "doc_id", "text", "lang", "source"))
    return judged.drop("text_hash", "lang", "source")


Q = {"op9_quality_rules": op9_quality_rules}
SQL: dict[str, str] = {}
