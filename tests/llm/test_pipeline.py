"""The pipeline: every stage against its operator's plain version on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from leafwise.llm import quality_rules, secret_scan, toxicity
from leafwise.llm.common import documents, saved
from leafwise.sources.tables import table
from tests.llm.conftest import SF, docs_frame
from tests.llm.test_jaccard_join import plain as groups
from tests.llm.test_packing import check, whole


def rows_of(df):
    return sorted((tuple(r[c] for c in P.COLUMNS) for r in df.collect()), key=str)


def test_stages(spark):
    docs = documents(spark, SF, *P.COLUMNS)
    before = rows_of(docs)
    assert [name for name, _ in P.STAGES] == ["quality_rules", "toxicity", "jaccard_join", "secret_scan", "packing"]

    kept = saved(P.STAGES[0][1](spark, docs, SF), "t")
    verdict = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs).collect()}
    assert rows_of(kept) == [r for r in before if verdict[r[0]]] and 0 < kept.count() < len(before)

    clean = saved(P.STAGES[1][1](spark, kept, SF), "t")
    scores = {r.doc_id: r.score for r in toxicity.score_documents(kept, toxicity.fit(kept, table(spark, SF, "labels"))).collect()}
    assert rows_of(clean) == [r for r in rows_of(kept) if scores[r[0]] < P.TOXIC_FROM]

    single = saved(P.STAGES[2][1](spark, clean, SF), "t")
    heads = {c for _, c, _ in groups([(r[0], r[1]) for r in rows_of(clean)])}
    assert rows_of(single) == [r for r in rows_of(clean) if r[0] in heads]

    safe = saved(P.STAGES[3][1](spark, single, SF), "t")
    want = []
    for i, text, lang, source, n in rows_of(single):
        new = secret_scan.redact_text(text, secret_scan.scan_text(text))
        want.append((i, new, lang, source, len(new)))
    assert rows_of(safe) == want

    texts = {r[0]: r[1] for r in rows_of(safe)}
    packed = [tuple(r) for r in P.STAGES[4][1](spark, safe, SF).collect()]
    check(packed, dict(zip(texts, whole(texts.values()))))


def test_run_is_its_stages(spark):
    packed = P.run(spark, SF)
    assert packed.select("doc_id").distinct().count() > 50


def test_repeated_rows_and_nulls(spark):
    same = "some words that are here more than once and again"
    df = docs_frame(spark, [(1, same), (1, same), (2, same), (None, "other words stand alone in here"), (3, None), (3, None), (4, "")])
    df = df.withColumns({"text_hash": F.lit(1), "head": F.lit(2), "rows": F.lit(3)})
    got = P.stage_jaccard_join(spark, df, SF)
    assert got.columns == P.COLUMNS
    assert [r[0] for r in rows_of(got)] == [1, 3, 3, 4, None]
    assert P.stage_jaccard_join(spark, df.limit(0), SF).count() == 0
    assert rows_of(P.stage_secret_scan(spark, df, SF)) == rows_of(df)
    assert P.stage_toxicity(spark, df, SF).count() == 7
