"""Exact quantile buckets.

pandas ``qcut(x, min(nunique, q), duplicates='drop')`` is reproduced exactly:
edges are the linear-interpolation quantiles at i/k (k = min(distinct, q)), rounded to
6 places (engines agree only to ~1e-14), duplicates dropped, and a value's label is the
number of edges strictly below it (at least 1, so the minimum lands in the first bin).

Scale: values are first reduced to ``(value, freq)`` - a combinable aggregate - and the
edges are read off the running sums of that table, which range partitions compute, so no
task holds the distinct values of a hot group or of a global column. The global edges are
attached as a scalar subquery (one row), never through a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.operators.util import rank_within, running_sums

NUMERIC_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def quantile_edges(freq: DataFrame, value: str, q: int, keys: list[str] | None = None) -> DataFrame:
    """``freq`` has (keys..., value, n), one row per distinct value. Returns (keys..., edges array<double>).

    Edge i of k lies at the 0-based rank i (N - 1) / k, between the values at its floor and its
    ceiling. A value holds the ranks from the count of smaller rows up to its running count, so each
    row knows by itself which edges it takes part in; at most two rows an edge go on.
    """
    keys = keys or []
    x = running_sums(freq, keys, [F.col(value)], ["n"])
    total = x.groupBy(*keys).agg(F.sum("n").alias("_rows"), F.least(F.count(F.lit(1)), F.lit(q)).alias("_k"))
    if keys:
        total = total.withColumnsRenamed({c: f"_t{i}" for i, c in enumerate(keys)})
        x = x.join(total, [x[c].eqNullSafe(total[f"_t{i}"]) for i, c in enumerate(keys)])
    else:  # one row: a scalar subquery, projected before the lambdas use it
        x = x.withColumn("_total", total.select(F.struct("_rows", "_k")).scalar())
        x = x.withColumns({"_rows": F.col("_total._rows"), "_k": F.col("_total._k")})

    def at(i: Column) -> Column:
        return i * (F.col("_rows") - 1)

    def holds(rank: Column) -> Column:
        return (rank >= F.col("cum_n") - F.col("n")) & (rank < F.col("cum_n"))

    def low(i: Column) -> Column:
        return F.floor(at(i) / F.col("_k"))

    def high(i: Column) -> Column:
        return F.ceil(at(i) / F.col("_k"))

    mine = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("_k")), lambda i: holds(low(i)) | holds(high(i)))
    i, v = F.col("_i"), F.col(value).cast("double")
    ends = x.withColumn("_i", F.explode(mine)).select(
        *keys, "_i", F.when(holds(low(i)), v).alias("_lo"), F.when(holds(high(i)), v).alias("_hi"),
        (F.pmod(at(i), F.col("_k")) / F.col("_k")).alias("_w"))
    edges = ends.groupBy(*keys, "_i").agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_w").alias("_w"))
    edge = F.round(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w"), 6)
    rows = F.array_sort(F.collect_list(F.struct("_i", edge.alias("e"))))
    return edges.groupBy(*keys).agg(F.array_distinct(F.transform(rows, lambda r: r["e"])).alias("edges"))


def label_from_edges(x: Column, edges: Column) -> Column:
    return F.greatest(F.lit(1), F.size(F.filter(edges, lambda e: e < x))).cast("int")


def qcut_global(df: DataFrame, value: str, out: str, q: int = 20) -> DataFrame:
    """Bucket label of ``value`` over the whole column (rows with NULL value get NULL)."""
    freq = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    edges = quantile_edges(freq, value, q).scalar()
    # the subquery is projected first: Spark does not allow it inside the filter lambda
    x = df.withColumn("_edges", edges)
    x = x.withColumn(out, F.when(F.col(value).isNotNull(),
                                 label_from_edges(F.col(value).cast("double"), F.col("_edges"))))
    return x.drop("_edges")


def qcut_by(df: DataFrame, key: str, value: str, out: str, q: int = 20) -> DataFrame:
    """Bucket label of ``value`` within each ``key`` group (per-code edges, joined back)."""
    freq = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    edges = quantile_edges(freq, value, q, [key])
    j = df.join(edges, key, "left")
    return j.withColumn(out, F.when(F.col(value).isNotNull(),
                                    label_from_edges(F.col(value).cast("double"), F.col("edges")))).drop("edges")


def dense_rank_by(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``groupby(key)[value].rank(method='dense')``: the rank of each distinct value inside
    its key, computed on the distinct (key, value) table without a window partitioned by
    the key (a hot code is spread over all tasks), then joined back."""
    d = df.select(key, value).where(F.col(value).isNotNull()).distinct()
    r = rank_within(d, [key], [F.col(value)], out).drop(f"{out}_n").withColumn(out, F.col(out).cast("int"))
    return df.join(r, [key, value], "left")


def numeric_or_null(text: Column) -> Column:
    """pandas ``to_numeric(errors='coerce')``: a regex guard first (Spark's bare cast takes '5d')."""
    return F.when(text.rlike(NUMERIC_RE), F.trim(text).try_cast("double"))


def bucketize_values(df: DataFrame, code: str, value: str, out: str, q: int = 20) -> DataFrame:
    """Numeric cells -> 'B_<k>' by per-code quantile of their dense rank; other cells unchanged."""
    x = df.withColumn("_num", numeric_or_null(F.col(value)))
    x = dense_rank_by(x, code, "_num", "_rk")
    x = qcut_by(x, code, "_rk", "_b", q)
    return x.withColumn(out, F.when(F.col("_num").isNotNull(), F.concat(F.lit("B_"), F.col("_b").cast("string")))
                        .otherwise(F.col(value))).drop("_num", "_rk", "_b")
