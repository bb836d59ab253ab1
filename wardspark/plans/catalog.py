"""Query catalog: key -> (Spark builder, DuckDB oracle text).

Each ``q_*`` module registers its queries with ``@query(key, sql)``. A builder takes
``(spark, sf_dir)`` and returns a DataFrame. Builders run jobs where a stage is written (range-numbered
tables, lineage cuts), for profiles of all-null columns and for training rounds; the rest is lazy.
Outputs are flattened to scalars (arrays as joined text, doubles rounded to 6 places)
so the value hash compares engines, not container types.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}

_MODULES = ("q_cohort", "q_codes", "q_events", "q_text", "q_tokens", "q_folds", "q_fed")


def query(key: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    for m in _MODULES:
        try:
            importlib.import_module(f"wardspark.plans.{m}")
        except ModuleNotFoundError as e:  # module not written yet
            if e.name != f"wardspark.plans.{m}":
                raise


def queries() -> dict[str, Builder]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
