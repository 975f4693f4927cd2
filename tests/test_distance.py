"""Edit distances in batches against the plain table, and inside the weights."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from leafwise.functions import distance as D
from leafwise.operators import align


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def some_texts(seed):
    rng = random.Random(seed)
    texts = ["", "a", "\x00", "a\x00", "x" * 64, "x" * 65, "y" * 63 + "x", "é" * 70, "🙂a", "a" * 128, "b" * 129]
    for alphabet in ("ab", "abcdefghij", "aé漢🙂"):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 5, 30, 63, 64, 65, 100, 127, 128, 140]))) for _ in range(12)]
    return texts


def test_distances_against_the_plain_table():
    texts = some_texts(1)
    rng = random.Random(2)
    pairs = [(rng.randrange(len(texts)), rng.randrange(len(texts))) for _ in range(400)]
    left, right = map(np.array, zip(*pairs))
    want = [plain(texts[i], texts[j]) for i, j in pairs]
    assert D.distances(texts, left, right).tolist() == want
    assert [D.one_distance(texts[i], texts[j]) for i, j in pairs] == want


def test_long_texts_and_small_batches(monkeypatch):
    monkeypatch.setattr(D, "BATCH", 7)
    monkeypatch.setattr(D, "LONG", 100)
    texts = some_texts(3)
    left, right = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    keep = np.arange(0, len(left), 5)
    assert D.distances(texts, left[keep], right[keep]).tolist() == [plain(texts[i], texts[j]) for i, j in zip(left[keep], right[keep])]


def test_rows_in_parts(monkeypatch):
    monkeypatch.setattr(D, "TEXTS", 5)
    rows = [(["ab", ""], ["abc"]), None, (["x"] * 3, ["y", "xy"]), ([], ["a"]), (["q"], ["q"])]
    left, right = (pd.Series([None if r is None else r[k] for r in rows]) for k in (0, 1))
    got = D.edit_distances.func(left, right).tolist()
    assert got == [[[1], [3]], None, [[1, 1]] * 3, [], [[0]]]


def test_weights_are_those_of_the_jvm_distance(spark):
    """The whole matrix comes from one batch function, not from an edit distance a pair in the JVM."""
    df = spark.createDataFrame([("o", '[{"a":"one","b":1},{"a":"two"},{}]', '[{"a":"one"},{"b":12,"a":"twö"}]'), ("e", "[]", '[{"a":1}]'), ("n", "null", '[{"a":1}]')],
                               "doc_key string, g string, p string")
    for kind in ("object", "string"):
        fr = df.select("doc_key", F.parse_json("g").alias("gt"), F.parse_json("p").alias("pred"))
        out = align.array_matching(fr, align.as_array(F.col("gt")), align.as_array(F.col("pred")), F.lit(kind), keep_weights=True)
        assert "levenshtein" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = {r.doc_key: r._w for r in out.select("doc_key", "_w").collect()}
        assert got["e"] is None and got["n"] is None and len(got["o"]) == 3 and len(got["o"][0]) == 2
        if kind == "object":
            assert got["o"][0][0] == 1003.0 - 0.1 * plain("{a:one,b:1}", "{a:one}") and got["o"][2][1] == -0.1 * plain("{}", "{a:twö,b:12}")
