"""The registered query catalogue: name -> (spark, sf_dir) -> DataFrame, and the
matching DuckDB oracle SQL where the query is SQL-expressible."""

from __future__ import annotations

from leafwise.plans import q_align, q_boards, q_requests, q_rubric, q_schema, q_select, q_sources, q_stream

_MODULES = [q_boards, q_select, q_align, q_schema, q_requests, q_rubric, q_stream, q_sources]


def queries() -> dict:
    out = {}
    for m in _MODULES:
        out.update(m.Q)
    return out


def oracles() -> dict:
    out = {}
    for m in _MODULES:
        out.update(m.SQL)
    return out


def flagship(spark, sf_dir):
    q = queries()
    if "doc_score" in q:
        return q["doc_score"](spark, sf_dir)
    return q["run_stats"](spark, sf_dir)
