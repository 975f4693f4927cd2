import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = os.environ.get("LEAFWISE_TEST_SF", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, texts, **more):
    """A table of documents: texts, or (doc_id, text) pairs; further columns by name."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows], DOCS)
