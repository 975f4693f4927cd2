"""SQL fragments shared by the DuckDB oracle queries (same derivations as
``leafwise.plans.carriers``, written independently in plain SQL)."""

from __future__ import annotations

from leafwise.sources import dims


def _b(x: bool) -> str:
    return "TRUE" if x else "FALSE"


def catalogue_values() -> str:
    rows = []
    for ci, (cid, _l, ud, ur) in enumerate(dims.COMBINATIONS):
        for mi, (fw, mode, _a) in enumerate(dims.FW_MODES):
            rows.append(f"({ci}, '{cid}', {_b(ud)}, {_b(ur)}, {mi}, '{fw}', '{mode}')")
    return ("SELECT * FROM (VALUES " + ", ".join(rows) +
            ") t(combo_idx, combination, use_desc, use_rich, mode_idx, framework, mode)")


SAMPLES = """
SELECT o_orderkey,
       'ord_' || CAST(o_orderkey AS VARCHAR) AS id,
       'Order ' || CAST(o_orderkey AS VARCHAR) || ' of customer ' || CAST(o_custkey AS VARCHAR)
         || ' has status ' || o_orderstatus || ' and priority ' || o_orderpriority || '.' AS text,
       o_orderpriority AS category,
       o_orderstatus AS domain,
       CAST(o_orderkey % 5 + 3 AS INTEGER) AS true_depth,
       'v' || CAST(o_orderkey % 3 AS VARCHAR) AS schema_name
FROM orders
"""


def results_sql() -> str:
    return f"""
SELECT 'orders' AS dataset, 'openai/gpt-oss-120b' AS model, c.combo_idx, c.combination, c.mode_idx,
       c.framework, c.mode, s.id AS sample_id, s.o_orderkey,
       (s.o_orderkey * 7 + c.combo_idx * 3 + c.mode_idx * 5) % 11 <> 0 AS success,
       ((s.o_orderkey * 7 + c.combo_idx * 3 + c.mode_idx * 5) % 11 <> 0)
         AND ((s.o_orderkey + c.combo_idx * 5 + c.mode_idx * 3) % 13 <> 0) AS scored,
       CASE WHEN ((s.o_orderkey * 7 + c.combo_idx * 3 + c.mode_idx * 5) % 11 <> 0)
                  AND ((s.o_orderkey + c.combo_idx * 5 + c.mode_idx * 3) % 13 <> 0)
            THEN CAST((s.o_orderkey * 37 + c.combo_idx * 101 + c.mode_idx * 53) % 1001 AS BIGINT)
            ELSE CAST(0 AS BIGINT) END AS t10,
       CAST(100 + (s.o_orderkey * 13 + c.mode_idx * 17) % 900 AS DOUBLE) AS latency_ms,
       s.category, s.true_depth, s.domain, s.schema_name
FROM ({SAMPLES}) s CROSS JOIN ({catalogue_values()}) c
"""


def with_results(body: str) -> str:
    """``body`` may refer to ``results`` (with t10 = score tenths, score_pct) and ``samples``."""
    return (f"WITH samples AS ({SAMPLES}), "
            f"results0 AS ({results_sql()}), "
            f"results AS (SELECT *, CAST(t10 AS DOUBLE) / 10 AS score_pct FROM results0) "
            + body)


def ratio(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) <> 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END)"


def round_ratio(num: str, den: str, digits: int = 1) -> str:
    s = 10 ** digits
    return (f"(CASE WHEN ({den}) <> 0 THEN CAST(floor(CAST(2 * ({num}) * {s} + ({den}) AS DOUBLE) "
            f"/ CAST(2 * ({den}) AS DOUBLE)) AS DOUBLE) / {float(s)} END)")


def round_half_up(x: str, digits: int = 1) -> str:
    s = float(10 ** digits)
    return f"(CAST(floor(({x}) * {s} + 0.5) AS DOUBLE) / {s})"
