"""Every query over the reference tables, with its SQL equivalent for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

PLANS = ("duplication", "relational", "code", "trees", "streams", "ordering")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for plan in PLANS for name, f in import_module(f"gristmill.plans.{plan}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in import_module(f"gristmill.plans.{plan}").ORACLES.items()}
