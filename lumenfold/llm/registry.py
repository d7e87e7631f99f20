"""The subpackage's queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "op1_packing",
    "op2_toxicity",
    "op3_line_dedup",
    "op4_token_files",
    "op5_secrets",
    "op6_sharding",
    "op7_quality_rules",
    "op8_decontamination",
    "op9_quality",
    "op10_near_dedup",
    "op11_hard_negatives",
    "op12_source_divergence",
    "op13_url_filters",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"lumenfold.llm.{name}").query for name in MODULES}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"lumenfold.llm.{name}"), "SQL", None) for name in MODULES}
    return {name: sql for name, sql in found.items() if sql}
