"""Every query of the engine's own operators, with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES (name -> callable) and ORACLES (name -> SQL).
MODULES = ("evidloom.plans.text_queries", "evidloom.plans.graph_queries", "evidloom.plans.merge_queries", "evidloom.plans.stage2_queries", "evidloom.plans.ledger_queries", "evidloom.plans.ingest_queries", "evidloom.plans.contract_queries", "evidloom.plans.part_queries", "evidloom.plans.graph_dir_queries", "evidloom.plans.stage1_queries", "evidloom.plans.sink_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(m).ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["prj_01_chunks"](spark, sf_dir)
