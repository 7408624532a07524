"""All queries of the core, by name, with the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules that each offer QUERIES (name -> function of session and data folder) and SQL (name -> text).
MODULES: list[str] = ["general", "integrity", "metadata", "scoring", "history", "calibration", "adapters", "audit"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        out.update(importlib.import_module(f"veridoc.plans.{name}").QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out.update(importlib.import_module(f"veridoc.plans.{name}").SQL)
    return out
