"""Compiles source specs into plans (A11): one event table and one cohort a source, from the same configuration.

Every column that a spec names is checked against the table before anything is planned, and all faults are told at
once. The plan of a table is: rename time and id, drop, keep the selected columns, map codes by the dictionary, numbers
for value columns, ``<column>_<value>`` for category columns, observation window; then the tables of a source
are united, patients with few events dropped, and events ordered. Sources are united last, told apart by
``source``, so a patient number means one patient inside one source only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.operators import cohort as C
from wardspark.operators import events as V
from wardspark.operators.buckets import numeric_or_null
from wardspark.spec import SourceSpec, SpecError, TableSpec

KEYS = ("ID", "TIME", "TABLE_NAME")
COHORTS: dict[str, Callable[..., DataFrame]] = {"absolute": C.cohort_absolute, "relative": C.cohort_relative, "anchored": C.cohort_anchored}


@dataclass(frozen=True)
class Inputs:
    """The tables of one source: events by name, the cohort builder's tables in order, the stays (id, intime)
    that windows open with, and the code dictionary."""

    events: Mapping[str, DataFrame]
    cohort: tuple[DataFrame, ...] = ()
    stays: DataFrame | None = None
    dictionary: DataFrame | None = None


def faults(source: SourceSpec, inputs: Inputs) -> list[str]:
    """What in the spec doesn't fit the tables."""
    out = []
    for t in source.tables:
        where = f"{source.name}.{t.name}"
        if t.name not in inputs.events:
            out.append(f"{where}: no such table")
            continue
        have = set(inputs.events[t.name].columns)
        named = {"time_column": (t.time_column,), "id_column": (t.id_column,), "row_key": (source.row_key,), "code_column": (t.code_column,) if t.code_column else (),
                 **{f: getattr(t, f) for f in ("time_excluded", "id_excluded", "value_columns", "category_columns", "selected")}}
        out += [f"{where}: {field} names unknown column {c}" for field, cols in named.items() for c in cols if c not in have]
        out += [f"{where}: {c} is a value and a category" for c in set(t.value_columns) & set(t.category_columns)]
        if t.selected:
            out += [f"{where}: {c} is used but not selected" for c in {*t.value_columns, *t.category_columns, *([t.code_column] if t.code_column else [])} - set(t.selected)]
        if t.dictionary and (inputs.dictionary is None or not t.code_column):
            out.append(f"{where}: a dictionary needs a code column and a table")
    if not source.relative_time and inputs.stays is None:
        out.append(f"{source.name}: absolute times need stays")
    return out


def _number(df: DataFrame, c: str) -> Column:
    return numeric_or_null(F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c).cast("double")


def compile_table(spec: TableSpec, source: SourceSpec, inputs: Inputs) -> DataFrame:
    t = V.canonical(inputs.events[spec.name], spec)
    if spec.selected:
        t = t.select(source.row_key, *KEYS, *spec.selected)
    if spec.dictionary:
        t = V.map_dictionary(t, spec.code_column, inputs.dictionary)
    t = t.withColumns({c: _number(t, c) for c in spec.value_columns} | {c: V.categorize(F.col(c), c) for c in spec.category_columns})
    if source.relative_time:
        return t.where((F.col("TIME") > 0) & (F.col("TIME") < source.window)).withColumn("TIME", F.col("TIME").cast("bigint"))
    return V.window_absolute(t, inputs.stays, source.window)


def compile_source(source: SourceSpec, inputs: Inputs, stored: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The ordered events of one source. ``stored`` may write the united table, which ordering reads twice."""
    if found := faults(source, inputs):
        raise SpecError("; ".join(found))
    u = V.union_outer([compile_table(t, source, inputs) for t in source.tables])
    u = stored(V.min_events(u, source.min_events))
    return V.with_order(u, [t.name for t in source.tables], source.row_key).withColumn("source", F.lit(source.name))


def compile_events(sources: Mapping[SourceSpec, Inputs], stored: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The events of all sources in one table. Faults of every source are told before any is planned."""
    if found := [f for s, i in sources.items() for f in faults(s, i)]:
        raise SpecError("; ".join(found))
    return V.union_outer([compile_source(s, i, stored) for s, i in sources.items()])


def compile_cohorts(sources: Mapping[SourceSpec, Inputs], columns: list[str]) -> DataFrame:
    """The cohorts of all sources in one table, each by its flavour's builder and its own rules."""
    parts = [COHORTS[s.flavour](*i.cohort, s.cohort).select(F.lit(s.name).alias("source"), *columns) for s, i in sources.items()]
    return reduce(DataFrame.unionByName, parts)
