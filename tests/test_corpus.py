"""Directory corpus scan on a small fixture derived from the order table."""

import json
import os

import duckdb
from pyspark.sql import functions as F

from leafwise.session import ship_package
from leafwise.sources.corpus import scan_corpus, scan_keyed_texts
from leafwise.sources.corpus_files import read_corpus, write_files


def test_scan_corpus(spark, tmp_path):
    rows = duckdb.sql("SELECT o_orderkey, o_orderstatus FROM '/root/testdata/sf0.001/orders.parquet' "
                      "ORDER BY o_orderkey LIMIT 40").fetchall()
    root, texts = tmp_path / "dataset", tmp_path / "texts"
    texts.mkdir()
    expected = set()
    for k, status in rows:
        d = root / f"status_{status}" / f"v{k % 2}" / "pdf+gold"
        d.mkdir(parents=True, exist_ok=True)
        (d.parent / "a-schema.json").write_text(json.dumps({"type": "object", "properties": {"k": {"type": "integer"}}}))
        (d.parent / "b-schema.json").write_text(json.dumps({"type": "string"}))
        (d / f"doc{k}.pdf").write_bytes(b"%PDF-1.4")
        if k % 5 != 0:                                   # documents without gold are skipped
            (d / f"doc{k}.gold.json").write_text(json.dumps({"k": k}))
            expected.add(f"status_{status}__v{k % 2}__doc{k}")
        (texts / f"status_{status}__v{k % 2}__doc{k}.txt").write_text(f"order {k}")
    (root / "orphan" / "v9" / "pdf+gold").mkdir(parents=True)   # no schema: skipped
    (root / "orphan" / "v9" / "pdf+gold" / "x.pdf").write_bytes(b"x")
    (root / "orphan" / "v9" / "pdf+gold" / "x.gold.json").write_text("{}")
    df = scan_corpus(spark, str(root), str(texts))
    got = {r["id"]: r for r in df.select("id", "text", "schema_key",
                                         df.schema_key.alias("sk")).collect()}
    assert set(got) == expected
    some = next(iter(expected))
    assert got[some]["text"].startswith("order ")
    first = df.selectExpr("to_json(schema) AS s").first()["s"]
    assert json.loads(first)["type"] == "object"                 # first schema file (a-) wins
    st = scan_keyed_texts(spark, os.path.join(str(texts), "*.txt"))
    assert st.count() == len(rows)


def test_numbered_lines_keep_trailing_blank_line(spark, tmp_path):
    from leafwise.sources.jsonl import numbered_lines
    (tmp_path / "part-00000.txt").write_text("a\nb\n\n")     # ends with a blank line
    (tmp_path / "part-00001.txt").write_text("\nc\n")
    got = [(r["line_idx"], r["line"]) for r in numbered_lines(spark, str(tmp_path)).orderBy("line_idx").collect()]
    assert got == [(0, "a"), (1, "b"), (2, ""), (3, ""), (4, "c")]


def _small_corpus(spark, root):
    ship_package(spark)
    names = []
    for domain in ("tax", "law 1"):
        for schema in ("x", "y"):
            names += [(f"{domain}/{schema}/{n}-schema.json", f'"{n}"') for n in ("b", "a")]
            for i in range(3):
                names += [(f"{domain}/{schema}/pdf+gold/d{i}.pdf", "%PDF"), (f"{domain}/{schema}/pdf+gold/d{i}.gold.json", f'"\u00e9{i}"')]
    names += [("tax/x/pdf+gold/lone.pdf", "no gold"), ("tax/none/pdf+gold/d.pdf", ""), ("tax/none/pdf+gold/d.gold.json", "1"),
              ("tax/bare/a-schema.json", "1"), ("readme.txt", "a file beside the domains")]
    assert write_files(spark.createDataFrame(names, "name string, content string").repartition(4), root) == len(names)
    return {(d, s, f"d{i}") for d in ("tax", "law 1") for s in ("x", "y") for i in range(3)}


def test_corpus_source_pairs_and_prunes(spark, tmp_path, capsys):
    root = str(tmp_path / "corpus")
    expected = _small_corpus(spark, root)
    for per_task in (1, 5, 500):
        df = read_corpus(spark, root, files_per_task=per_task)
        rows = df.collect()
        assert {(r.domain, r.schema_name, r.stem) for r in rows} == expected and len(rows) == len(expected)
        assert all(r.schema_text == '"a"' and r.text is None and r.gold_text == f'"\u00e9{r.stem[1:]}"' for r in rows)
        assert df.rdd.getNumPartitions() == -(-len(expected) // per_task)
    one = read_corpus(spark, root, files_per_task=1).where("domain = 'tax' and schema_name in ('x', 'z') and stem <> 'd0'")
    assert {(r.domain, r.schema_name, r.stem) for r in one.collect()} == {("tax", "x", "d1"), ("tax", "x", "d2")}
    assert one.rdd.getNumPartitions() == 3          # only the folder tax/x was listed
    one.explain("formatted")
    plan = capsys.readouterr().out
    assert "domain" in plan.split("PushedFilters")[1].splitlines()[0]
    same = scan_corpus(spark, root)
    assert {tuple(r) for r in same.select("domain", "schema_name", F.element_at(F.split("id", "__"), 3)).collect()} == expected


def test_keyed_texts_have_the_names_of_their_files(spark, tmp_path):
    names = ["a b", "a+b", "a%20b", "ä", "c.d"]
    for n in names:
        (tmp_path / f"{n}.txt").write_text(n)
    assert all(r.stem == r.text for r in scan_keyed_texts(spark, str(tmp_path / "*.txt")).collect())


def test_corpus_source_without_files(spark, tmp_path):
    ship_package(spark)
    assert read_corpus(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "empty").mkdir()
    assert read_corpus(spark, str(tmp_path / "empty"), str(tmp_path / "missing")).count() == 0
