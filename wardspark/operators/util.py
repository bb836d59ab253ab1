"""Shared operator building blocks.

All of them are skew-tolerant by construction: per-group picks use aggregate functions
(partial aggregation runs map-side, so a hot key is reduced before the shuffle) instead
of a window over the group. Data-derived tables carry no broadcast hint: AQE turns a join into
a broadcast at runtime from real sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspark.sources.stage import cut

def first_row_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                 cols: Sequence[str], desc: bool = False) -> DataFrame:
    """Whole row with the smallest (or largest) ``order`` tuple per ``keys``.

    ``min(struct(order..., cols...))`` is an ordinary aggregate, so it is combined map-side
    and a key holding a third of the rows never lands whole in one task.
    """
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    fields = [c.alias(f"_o{i}") for i, c in enumerate(order_cols)] + [F.col(c).alias(c) for c in cols]
    agg = (F.max if desc else F.min)(F.struct(*fields)).alias("_pick")
    out = df.groupBy(*keys).agg(agg)
    return out.select(*keys, *[F.col(f"_pick.{c}").alias(c) for c in cols])


def first_nonnull_by(df: DataFrame, keys: Sequence[str], order: Column | str,
                     cols: Sequence[str]) -> DataFrame:
    """Per column, the first non-null value in ``order`` (pandas ``sort().groupby().first()``)."""
    o = F.col(order) if isinstance(order, str) else order
    aggs = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), o)).alias(c) for c in cols]
    return df.groupBy(*keys).agg(*aggs)


def category_codes(df: DataFrame, col: str, out: str) -> tuple[DataFrame, DataFrame]:
    """pandas ``astype('category').cat.codes``: rank of the sorted distinct value - 1, NULL -> -1.

    Returns (df with ``out``, code table). The distinct set of a category column is small;
    the window over it has no partition key on purpose (it is the category table, not data).
    """
    cats = df.select(F.col(col).alias("_v")).where(F.col(col).isNotNull()).distinct()
    codes = cats.select("_v", (F.row_number().over(Window.orderBy("_v")) - 1).cast("int").alias(out))
    j = df.join(codes, df[col].eqNullSafe(codes["_v"]), "left").drop("_v")
    return j.withColumn(out, F.coalesce(F.col(out), F.lit(-1))), codes.withColumnRenamed("_v", col)


def mode_smallest(df: DataFrame, keys: Sequence[str], value: str, out: str = "mode") -> DataFrame:
    """Most frequent ``value`` per key; ties -> smallest value (pandas ``Series.mode().iloc[0]``)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    pick = F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(pick.alias("_m")).select(*keys, F.col("_m.v").alias(out))


def share(df: DataFrame, keys: Sequence[str], out_n: str = "n", out_pct: str = "pct") -> DataFrame:
    """Value counts with percentage of the total (groupBy + one global sum of the small result)."""
    c = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out_n))
    tot = F.sum(out_n).over(Window.partitionBy())
    return c.withColumn(out_pct, F.round(F.col(out_n) * 100.0 / tot, 6))


def hash_bucket(col: Column, buckets: int) -> Column:
    """Deterministic bucket from md5 (same digest in Spark and DuckDB)."""
    h = F.conv(F.substring(F.md5(col.cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(buckets))


def ranged(df: DataFrame, order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """``df`` with ``_pid``, the number of the row's range of ``order``, written to the shared folder.

    Range bounds come from a sample that Spark takes anew for every exchange. Both users of the
    ranges (rows and totals per range) therefore read one stored table: a row's range is a stored
    value, the same in every branch whatever the optimizer prunes or reuses. Give it the columns that
    the ranks need and no payload; wide tables take ``range_number`` instead.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))


def range_number(df: DataFrame, cols: Sequence[str], parts: int | None = None, per_range: int = 40) -> Column:
    """The number of the row's range of ``cols`` (ascending, nulls first), as an expression of the row.

    Bounds are read once from a sample of ``per_range`` rows a range, so the number is the same in every
    branch and on every retry, and nothing is stored. They only steer the sizes of ranges. A row finds
    its range in two steps: among the first bounds of groups of bounds, then inside its group.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(*cols)
    total = keys.count()
    rows = keys.sample(min(1.0, per_range * n / max(1, total)), seed=17).collect()  # bounded by the ranges
    rows.sort(key=lambda r: [(v is not None, v) if v is not None else (False,) for v in r])
    cuts = sorted({i * len(rows) // n for i in range(1, n)}) if rows else []
    types = [df.schema[c].dataType for c in cols]
    bounds = [F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(rows[i], types, cols)]) for i in cuts]
    if not bounds:
        return F.lit(0)
    mine = F.struct(*[F.col(c).alias(c) for c in cols])
    width = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i:i + width] for i in range(0, len(bounds), width)]

    def passed(some: Sequence[Column]) -> Column:
        return F.size(F.filter(F.array(*some), lambda b: b <= mine))

    group = passed([g[0] for g in groups])
    inside = F.array(F.array().cast(f"array<{_ddl(cols, types)}>"), *[F.array(*g) for g in groups])
    return ((F.greatest(group - 1, F.lit(0)) * width) + F.size(F.filter(F.get(inside, group), lambda b: b <= mine))).cast("int")


def _ddl(cols: Sequence[str], types) -> str:
    return "struct<" + ",".join(f"`{c}`:{t.simpleString()}" for c, t in zip(cols, types)) + ">"


def global_rank(df: DataFrame, order: Sequence[Column], out: str, parts: int | None = None) -> DataFrame:
    """1-based rank of every row in ``order`` (a total order) without a one-partition sort.

    Rows are range-partitioned on the order, numbered inside each range, and shifted by
    the row counts of all earlier ranges. The offsets table has one row per partition,
    so broadcasting it is bounded by the partition count, not by the data.
    """
    r = ranged(df, order, parts)
    r = r.withColumn("_local", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
    counts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (r.join(F.broadcast(offs), "_pid")
             .withColumn(out, (F.col("_off") + F.col("_local")).cast("bigint"))
             .drop("_pid", "_local", "_off"))


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str],
                 parts: int | None = None) -> DataFrame:
    """Inclusive running sums of ``values`` within ``keys`` along ``order`` (a total order
    inside each key), without a window partitioned by the key.

    Rows are range-partitioned on (keys, order); sums are taken inside each (range, key)
    piece, and each piece is shifted by the totals of the same key in earlier ranges
    (a table of at most partitions x keys rows). A key holding a third of all rows is
    therefore spread over many tasks. Adds ``cum_<value>`` columns. Every column of ``df`` is stored with
    its range number: give it keys, order and values alone.
    """
    return along_ranges(ranged(df, [*[F.col(k) for k in keys], *order], parts), keys, order, values)


def along_ranges(r: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str] = (),
                 previous: Sequence[str] = ()) -> DataFrame:
    """Running sums (``cum_<value>``) and the values of the row before (``prev_<column>``, null for a key's first row)
    within ``keys`` along ``order``, for rows whose range of (keys, order) is ``_pid``; drops ``_pid``.

    Both are windows inside one (range, key) piece; a small table of pieces carries the totals of earlier ranges,
    and the last row of the nearest one, into the next. The rows themselves meet in one exchange. With ``previous``,
    ``order`` is plain ascending columns.
    """
    piece = Window.partitionBy("_pid", *keys).orderBy(*order)
    so_far = piece.rowsBetween(Window.unboundedPreceding, 0)
    new = {f"_l_{v}": F.sum(v).over(so_far) for v in values}
    new |= {f"_b_{c}": F.lag(F.struct(c)).over(piece) for c in previous}
    x = r.withColumns(new)
    last = [F.max(F.struct(*[o.alias(f"_s{i}") for i, o in enumerate(order)], F.struct(c).alias("_v")))["_v"].alias(f"_e_{c}") for c in previous]
    tot = r.groupBy("_pid", *keys).agg(*[F.sum(v).alias(f"_t_{v}") for v in values], *last)
    by_key = Window.partitionBy(*keys).orderBy("_pid")
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(F.col("_pid").alias("_op"), *[F.col(k).alias(f"_ok{i}") for i, k in enumerate(keys)],
                      *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values],
                      *[F.lag(f"_e_{c}").over(by_key).alias(f"_c_{c}") for c in previous])
    on = [x["_pid"] == offs["_op"], *[x[k].eqNullSafe(offs[f"_ok{i}"]) for i, k in enumerate(keys)]]
    j = x.join(offs, on)
    j = j.withColumns({f"cum_{v}": F.col(f"_o_{v}") + F.col(f"_l_{v}") for v in values}
                      | {f"prev_{c}": F.coalesce(f"_b_{c}", f"_c_{c}")[c] for c in previous})
    return j.drop("_pid", "_op", *[f"_ok{i}" for i in range(len(keys))], *[f"_{p}_{v}" for v in values for p in "lo"],
                  *[f"_{p}_{c}" for c in previous for p in "bc"])


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """1-based rank inside each ``keys`` group along ``order`` (a total order), plus the
    group size ``<out>_n``, without a window partitioned by the key: a global rank over
    (keys, order) minus the number of rows in all earlier groups. The per-group table
    (one row per key) gets cumulative offsets from ``running_sums`` and is joined back. Every column of ``df`` is
    stored: give it keys and order alone.
    """
    kcols = [F.col(k).asc_nulls_first() for k in keys]
    ranked = global_rank(df, [*kcols, *order], "_g")
    if not keys:  # one group: the size is a one-row scalar subquery
        return (ranked.withColumnRenamed("_g", out)
                      .withColumn(f"{out}_n", df.agg(F.count(F.lit(1))).scalar()))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_gn"))
    sizes = running_sums(sizes.withColumn("_one", F.lit(0)), ["_one"], kcols, ["_gn"]) \
        .withColumn("_off", F.col("cum__gn") - F.col("_gn")).drop("_one", "cum__gn")
    sizes = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_gn", "_off")
    j = ranked.join(sizes, [ranked[k].eqNullSafe(sizes[f"_k{i}"]) for i, k in enumerate(keys)])
    j = j.drop(*[f"_k{i}" for i in range(len(keys))])
    return (j.withColumn(out, (F.col("_g") - F.col("_off")).cast("bigint"))
             .withColumnRenamed("_gn", f"{out}_n").drop("_g", "_off"))


def rank_by_hash(df: DataFrame, keys: Sequence[str], key: Column, more: Sequence[Column], out: str,
                 parts: int | None = None) -> DataFrame:
    """1-based rank inside each ``keys`` group along (``key``, ``more``), where ``key`` is a uniform hex digest, plus
    the group size ``<out>_n``.

    The digest is uniform, so equal cells of its range need no sampled bounds: a row's cell is an expression of the
    row and nothing is stored. Ranks are taken inside (group, cell) and shifted by the earlier cells' counts,
    a table of at most groups x cells rows.
    """
    n = max(16, parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cell = F.floor(F.conv(F.substring(key, 1, 6), 16, 10).cast("bigint") * n / F.lit(1 << 24)).cast("int")
    x = df.withColumns({"_cell": cell, "_h": F.unhex(key)})  # bytes sort as their hex text does, at half the size
    group = Window.partitionBy(*keys)
    cells = x.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.select(F.col("_cell").alias("_c"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                         F.sum("_n").over(group).alias(f"{out}_n"),
                         F.coalesce(F.sum("_n").over(group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    x = x.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy("_h", *more)))
    j = x.join(cells, [x["_cell"] == cells["_c"], *[x[k].eqNullSafe(cells[f"_k{i}"]) for i, k in enumerate(keys)]])
    j = j.withColumn(out, (F.col("_local") + F.col("_before")).cast("bigint"))
    return j.drop("_h", "_cell", "_c", "_local", "_before", *[f"_k{i}" for i in range(len(keys))])
