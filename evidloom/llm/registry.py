"""The queries of this subpackage, one opN_<name> for each operator, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("quality_rules", "simhash", "url_filters", "decontamination", "line_dedup", "packing", "warc", "html_extraction", "secret_scan", "chat_formatting", "pii", "merkle", "resampling")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in import_module(f"evidloom.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"evidloom.llm.{m}").ORACLES.items()}
