"""Fixed dimension tables of the benchmark grid.

These are small, bounded catalogues (4 combinations, 22 modes, 2 prompt
templates); every query that uses them joins them with ``F.broadcast``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values (must equal the evaluated benchmark's catalogue) ---------
# Combinations: id, label, use_desc, use_rich (in this order).
COMBINATIONS = [
    ("A_desc", "Schema(desc)+Prompt(min)", True, False),
    ("B_nodesc", "Schema(nodesc)+Prompt(min)", False, False),
    ("C_rich", "Schema(nodesc)+Prompt(rich)", False, True),
    ("D_both", "Schema(desc)+Prompt(rich)", True, True),
]

# Dashboard display names of the combinations.
COMBO_DISPLAY = {
    "A_desc": "Prompt(min) + Desc(O)",
    "B_nodesc": "Prompt(min) + Desc(X)",
    "C_rich": "Prompt(rich) + Desc(X)",
    "D_both": "Prompt(rich) + Desc(O)",
}

# Framework modes run by default (aliases excluded), with their approach.
FW_MODES = [
    ("instructor", "tools", "Tool Calling"),
    ("instructor", "tools_strict", "Tool Calling"),
    ("instructor", "json", "JSON Schema"),
    ("instructor", "json_schema", "JSON Schema"),
    ("instructor", "md_json", "JSON Schema"),
    ("openai", "default", "JSON Schema"),
    ("openai", "tool_calling", "Tool Calling"),
    ("openai", "json_object", "JSON Object"),
    ("langchain", "json_schema", "JSON Schema"),
    ("langchain", "function_calling", "Tool Calling"),
    ("langchain", "json_mode", "JSON Object"),
    ("marvin", "cast", "Tool Calling"),
    ("marvin", "extract", "Tool Calling"),
    ("pydantic_ai", "tool", "Tool Calling"),
    ("pydantic_ai", "json", "JSON Schema"),
    ("pydantic_ai", "text", "Text Parsing"),
    ("mirascope", "tool", "Tool Calling"),
    ("mirascope", "json", "JSON Mode"),
    ("mirascope", "strict", "JSON Schema"),
    ("guardrails", "default", "JSON Schema"),
    ("llamaindex", "text", "Text Completion"),
    ("llamaindex", "function_calling", "Tool Calling"),
]

# Modes each adapter accepts, including the "default" aliases.
SUPPORTED_MODES = {
    "guardrails": ["default"],
    "instructor": ["default", "tools", "tools_strict", "json", "json_schema", "md_json"],
    "langchain": ["default", "json_schema", "function_calling", "json_mode"],
    "llamaindex": ["default", "text", "function_calling"],
    "marvin": ["cast", "extract"],
    "mirascope": ["default", "tool", "json", "strict"],
    "openai": ["default", "tool_calling", "json_object"],
    "pydantic_ai": ["default", "tool", "json", "text"],
}

DEFAULT_MINIMAL_PROMPT = (
    "You are a data extraction assistant.\n"
    "Extract structured information from the given text into the specified JSON schema.\n"
    "The output must be a valid JSON object conforming to the provided schema.\n"
    "Preserve original values as they appear in the text (numbers, dates, names, etc.).\n"
    "If a field is not present in the text, use null or the appropriate default value."
)

# Prompt templates: name, description, version, system_prompt.
PROMPTS = [
    ("extract_deepjsoneval_minimal",
     "DeepJSONEval deep-nested JSON extraction (minimal prompt - no field descriptions)", "1.0",
     DEFAULT_MINIMAL_PROMPT + "\n"),
    ("extract_extractbench_minimal", "ExtractBench document extraction (minimal prompt)", "1.0",
     "You are a data extraction assistant.\n"
     "Extract structured information from the given document text.\n"
     "Follow the schema exactly.\n"
     "If a field is not present, use null or empty default.\n"),
]
# ---------------------------------------------------------------------------


def combos(spark: SparkSession) -> DataFrame:
    """4-row combination dimension with its ordinal ``combo_idx`` (0..3)."""
    rows = [(i, *c) for i, c in enumerate(COMBINATIONS)]
    return spark.createDataFrame(
        rows, "combo_idx INT, combination STRING, label STRING, use_desc BOOLEAN, use_rich BOOLEAN")


def modes(spark: SparkSession) -> DataFrame:
    """22-row framework/mode dimension with its ordinal ``mode_idx`` (0..21)."""
    rows = [(i, *m) for i, m in enumerate(FW_MODES)]
    return spark.createDataFrame(rows, "mode_idx INT, framework STRING, mode STRING, approach STRING")


def supported_modes(spark: SparkSession) -> DataFrame:
    rows = [(fw, m) for fw, ms in SUPPORTED_MODES.items() for m in ms]
    return spark.createDataFrame(rows, "framework STRING, mode STRING")


def prompts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROMPTS, "name STRING, description STRING, version STRING, system_prompt STRING")


def prompt(spark: SparkSession, name: str) -> DataFrame:
    """Look up one prompt template; an unknown name lists the available ones."""
    names = [p[0] for p in PROMPTS]
    if name not in names:
        raise KeyError(f"prompt {name!r} not found. Available: {', '.join(sorted(names))}")
    return prompts(spark).filter(F.col("name") == name)
