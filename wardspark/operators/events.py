"""Canonical event tables, observation windows and per-patient ordering
(A2, B1-B5, B10-B14, C5, C6, D6, E1, E2, F1, F3, F4, G5, G17, H6).

Per-ID counts are aggregates joined back (combinable, skew-safe). The per-ID order and the
gap to the previous event come from one pass over ranges of the sort key, so no window is
partitioned by patient; the sort key is a total order (ID, TIME, table rank, event key) so
results never depend on file order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspark.functions.clinical import minutes_between
from wardspark.operators.buckets import qcut_global
from wardspark.operators.codes import map_codes
from wardspark.operators.util import along_ranges, range_number
from wardspark.spec import TableSpec

KEYS = ("ID", "TIME", "TABLE_NAME", "ORDER", "time_gap", "time_bucket")


def canonical(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Drop excluded time/id columns, rename the time and id columns, tag the table."""
    out = df.drop(*spec.time_excluded, *spec.id_excluded)
    out = out.withColumnsRenamed({spec.time_column: "TIME", spec.id_column: "ID"})
    return out.withColumn("TABLE_NAME", F.lit(spec.name))


def union_outer(tables: Sequence[DataFrame]) -> DataFrame:
    """Outer-column union (missing columns become NULL)."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, n_nonnull) for every column, in one aggregate pass."""
    cols = df.columns
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in cols])
    stack = "stack({n}, {args}) as (column_name, n_nonnull)".format(
        n=len(cols), args=", ".join(f"'{c}', `{c}`" for c in cols))
    return row.selectExpr(stack)


def upper_columns(df: DataFrame) -> DataFrame:
    """All column names in upper case; two names that differ in case alone are an error."""
    names = [c.upper() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names clash in upper case: {df.columns}")
    return df.toDF(*names)


def drop_all_null(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns that hold no value at all (one profile pass; returns a new plan)."""
    counts = null_profile(df).collect()  # one row per column: bounded by the schema width
    empty = [r["column_name"] for r in counts if r["n_nonnull"] == 0 and r["column_name"] not in keep]
    return df.drop(*empty)


def map_dictionary(df: DataFrame, col: str, dictionary: DataFrame, key: str = "ITEMID",
                   value: str = "LABEL", drop_missing: bool = True) -> DataFrame:
    """Replace codes by dictionary labels; rows whose code has no label are removed."""
    out = map_codes(df, col, dictionary, key, value, "_label").drop(col).withColumnRenamed("_label", col)
    return out.where(F.col(col).isNotNull()) if drop_missing else out


def window_absolute(events: DataFrame, stays: DataFrame, minutes: int, bin_minutes: int | None = None) -> DataFrame:
    """Keep events strictly inside (intime, intime + window); TIME becomes whole minutes.

    An interval join by time bins: each stay is written into the bins of ``bin_minutes`` (the window's length unless
    given) that its window touches, each event lies in one, and both meet on (ID, bin). The exact bounds are a residual
    predicate. A patient with half of all events and many stays is spread over the bins, and an event meets the
    stays around it alone.
    """
    width = 60 * (bin_minutes or max(1, minutes))
    end = F.timestamp_add("MINUTE", F.lit(minutes), F.col("intime"))

    def bin_of(t: Column) -> Column:
        return F.floor(F.unix_timestamp(t) / width)

    s = stays.select(F.col("id").alias("ID"), "intime").where(F.col("intime").isNotNull())
    s = s.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("intime")), bin_of(end))))
    e = events.withColumn("_bin", bin_of(F.col("TIME")))
    j = e.join(s, ["ID", "_bin"]).where((F.col("TIME") > F.col("intime")) & (F.col("TIME") < end))
    return j.select(*[F.col(f"`{c}`") for c in events.columns], "intime") \
        .withColumn("TIME", minutes_between(F.col("intime"), F.col("TIME"))).drop("intime")


def window_relative(events: DataFrame, ids: DataFrame, minutes: int, t: str = "TIME") -> DataFrame:
    """Offsets already relative: semi join on the cohort ids, then 0 < t < window."""
    e = events.join(ids.select(F.col("id").alias("ID")).distinct(), "ID", "left_semi")
    return e.where((F.col(t) > 0) & (F.col(t) < minutes))


def min_events(df: DataFrame, n: int = 10, key: str = "ID") -> DataFrame:
    """Keep IDs with at least ``n`` events (count aggregate joined back)."""
    c = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_events")).where(F.col("n_events") >= n)
    return df.join(c, key)


def with_order(df: DataFrame, tables: Sequence[str], row_key: str = "event_id", time: str = "TIME") -> DataFrame:
    """ORDER = position of the event inside its ID by (TIME, table rank, row key), and time_gap = TIME - TIME of the
    event before (0 for the first), in one ordered pass.

    Events are cut into ranges of (ID, TIME, row key); a range's number is an expression of the row, so no column
    is stored and no window is partitioned by ID: one patient holding a third of all events is split over many tasks.
    Counts, and the last time, of the ranges before are carried into each by a small table.
    """
    rank = F.array_position(F.array(*[F.lit(t) for t in tables]), F.col("TABLE_NAME"))
    x = df.withColumns({"_one": F.lit(1), "_rank": rank})
    x = x.withColumn("_pid", range_number(x, ["ID", "TIME", "_rank", row_key]))
    x = along_ranges(x, ["ID"], [F.col("TIME"), F.col("_rank"), F.col(row_key)], ["_one"], [time])
    gap = F.coalesce(F.col(time) - F.col(f"prev_{time}"), F.lit(0)).cast("bigint")
    return x.withColumns({"ORDER": F.col("cum__one").cast("int"), "time_gap": gap}).drop("_one", "_rank", "cum__one", f"prev_{time}")


def with_time_bucket(df: DataFrame, q: int = 20) -> DataFrame:
    """Zero gaps -> bucket 0; other gaps -> global exact quantile bucket 1..q (one pass,
    no split/union)."""
    nz = df.withColumn("_g", F.when(F.col("time_gap") != 0, F.col("time_gap")))
    b = qcut_global(nz, "_g", "_b", q)
    return b.withColumn("time_bucket", F.coalesce(F.col("_b"), F.lit(0))).drop("_g", "_b")


def blank(c: Column) -> Column:
    """NULL and the text 'nan' -> ' ' (the text-boundary spelling of a missing cell)."""
    s = c.cast("string")
    return F.when(s.isNull() | (s == "nan"), F.lit(" ")).otherwise(s)


def categorize(c: Column, name: str) -> Column:
    """'<name>_<value>'; a missing cell stays blank."""
    return F.when(c.isNull() | (c.cast("string") == "nan"), F.lit(" ")).otherwise(
        F.concat(F.lit(name + "_"), c.cast("string")))


def cells(df: DataFrame, cols: Sequence[str]) -> Column:
    """array<struct<col,val>> of the non-blank cells, in column order."""
    arr = F.array(*[F.struct(F.lit(c).alias("col"), blank(F.col(c)).alias("val")) for c in cols])
    return F.filter(arr, lambda s: s["val"] != " ")


def code_event(df: DataFrame, cols: Sequence[str], bucket: str = "time_bucket") -> DataFrame:
    """Code-embedding form of an event: raw values, then '<TABLE>_<col>' types, then time."""
    c = cells(df, cols)
    ev = F.concat(F.transform(c, lambda s: s["val"]), F.array(F.concat(F.lit("TB_"), F.col(bucket).cast("string"))))
    ty = F.concat(F.transform(c, lambda s: F.concat(F.col("TABLE_NAME"), F.lit("_"), s["col"])), F.array(F.lit("[TIME]")))
    return df.withColumn("event_list", ev).withColumn("type_list", ty)
