"""Extension points: dataset adapters and execution modes by name (leaf metrics: ``functions.leaf.register_metric``)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from leafwise.operators import requests
from leafwise.sources import dims

SAMPLE_COLUMNS = ("id", "text")


@dataclass(frozen=True)
class DatasetAdapter:
    """How a corpus becomes samples: ``load(spark, **options) -> samples`` (id, text, ...), ``schemas`` -> (schema_id,
    schema_text), prompts as columns or literals, and the name of the column that says which schema a sample has."""

    name: str
    load: Callable[..., DataFrame]
    schemas: Callable[..., DataFrame]
    rich_prompts: Callable[[DataFrame], DataFrame]
    minimal_prompt: str = dims.DEFAULT_MINIMAL_PROMPT
    schema_key: str = "schema_id"


_DATASETS: dict[str, DatasetAdapter] = {}


def register_dataset(adapter: DatasetAdapter) -> DatasetAdapter:
    _DATASETS[adapter.name] = adapter
    return adapter


def dataset(name: str) -> DatasetAdapter:
    if name not in _DATASETS:
        raise KeyError(f"dataset {name!r} not found. Available: {', '.join(sorted(_DATASETS))}")
    return _DATASETS[name]


def load_samples(spark: SparkSession, name: str, **options) -> DataFrame:
    """Samples of a registered dataset; a loader that leaves out a contract column is refused."""
    df = dataset(name).load(spark, **options)
    missing = [c for c in SAMPLE_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"dataset {name!r} gives no column {', '.join(missing)}")
    return df


def register_mode(framework: str, mode: str, approach: str, wording: tuple[str, str] | None = None) -> None:
    """Add an execution mode to the catalogue; ``wording`` puts the schema text into its system prompt."""
    if not any(f == framework and m == mode for f, m, _ in dims.FW_MODES):
        dims.FW_MODES.append((framework, mode, approach))
    known = dims.SUPPORTED_MODES.setdefault(framework, [])
    if mode not in known:
        known.append(mode)
    if wording:
        requests.SCHEMA_WORDING[f"{framework}/{mode}"] = wording


def unregister_mode(framework: str, mode: str) -> None:
    dims.FW_MODES[:] = [r for r in dims.FW_MODES if r[:2] != (framework, mode)]
    dims.SUPPORTED_MODES[framework] = [m for m in dims.SUPPORTED_MODES.get(framework, []) if m != mode]
    if not dims.SUPPORTED_MODES[framework]:
        del dims.SUPPORTED_MODES[framework]
    requests.SCHEMA_WORDING.pop(f"{framework}/{mode}", None)

