"""The registry: query name to builder and, where SQL can say it, oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import let_workers_import

Builder = Callable[[SparkSession, str], DataFrame]

MODULES = ("splitting", "ordering", "auditing", "texts", "scoring", "graphs", "connectors", "composites", "evaluations", "records", "answers", "continuations", "phrases", "fallbacks")


def _entries() -> dict[str, tuple[Builder, str | None]]:
    found: dict[str, tuple[Builder, str | None]] = {}
    for name in MODULES:
        for key, entry in importlib.import_module(f"tidemill.plans.{name}").QUERIES.items():
            if key in found:
                raise ValueError(f"{key} is registered twice")
            found[key] = entry
    return found


def _ready(builder: Builder) -> Builder:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        let_workers_import(spark)
        return builder(spark, sf_dir)

    return run


def queries() -> dict[str, Builder]:
    return {k: _ready(builder) for k, (builder, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _entries().items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["split_summary"](spark, sf_dir)
