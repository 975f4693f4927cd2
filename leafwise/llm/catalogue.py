"""Queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and SQL where it exists."""

from __future__ import annotations

from leafwise.llm import (ann_search, chat_format, collocations, exact_dedup, hard_negatives, jaccard_join, packing, pii_bootstrap,
                          quality_classifier, quality_rules, secret_scan, sentencepiece_codec, toxicity)

MODULES = [ann_search, packing, secret_scan, toxicity, chat_format, jaccard_join, quality_classifier,
           quality_rules, pii_bootstrap, sentencepiece_codec, exact_dedup, hard_negatives, collocations]


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.Q.items()}


def oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
