"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query name -> module of this subpackage that has the function of that name
_QUERIES = {
    "op1_jaccard_join": "jaccard_join",
    "op2_license_scan": "license_scan",
    "op3_quality_rules": "quality_rules",
    "op4_token_files": "token_files",
    "op5_toxicity": "toxicity",
    "op6_decontamination": "decontamination",
    "op7_html_extraction": "html_extraction",
    "op8_quality_mil": "quality_mil",
    "op9_packing": "packing",
    "op10_sharding": "sharding",
    "op11_spelling_variants": "spelling",
    "op12_url_filters": "url_filters",
    "op13_phrases": "phrases",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f".{module}", __package__), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in _QUERIES.items():
        sql = getattr(import_module(f".{module}", __package__), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
