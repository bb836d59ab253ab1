"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of the ring; a key belongs to the arc that ends at the next
point clockwise. A shard takes the keys of its own arcs, in ring order, up to its quota; the keys
that overflow continue clockwise to the next shard with room, again in ring order. Quotas are the
row count divided by the shards, the first shards taking the remainder, so counts differ by one at
most. Where a key goes depends on the number of keys before it in its arc alone, so only counts per
(arc, cell) reach the driver: at most vnodes x shards + cells rows, whatever the input.

Cases: a null text has 0 bytes; null ids share one point of the ring; equal ids share a point and
are ordered by (size, crc); repeated rows are interchangeable; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardspark.llm.common import parallelism, stage, take_columns

RING_BITS = 32


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(point, shard) in ring order."""
    at = {}
    for s in range(shards):
        for v in range(vnodes):
            at.setdefault(int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:8], 16), s)
    return sorted(at.items())


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def allot(arcs: list[tuple[int, int]], points: list[tuple[int, int]], quota: list[int]) -> dict[int, list[tuple[int, int, int, int]]]:
    """(arc, keys) in ring order -> per arc its runs (first rank, end rank, shard, first slot)."""
    room, used, out, over = list(quota), [0] * len(quota), {}, []

    def give(arc: int, lo: int, hi: int, shard: int) -> int:
        n = min(hi - lo, room[shard])
        if n > 0:
            out.setdefault(arc, []).append((lo, lo + n, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
        return lo + max(n, 0)

    for arc, n in arcs:
        left = give(arc, 0, n, points[arc][1])
        if left < n:
            over.append((arc, left, n))
    for arc, lo, n in over:
        step = arc
        while lo < n:
            step = (step + 1) % len(points)
            lo = give(arc, lo, n, points[step][1])
    return out


def place(sized: DataFrame, shards: int = 24, vnodes: int = 128) -> DataFrame:
    """(doc_id, size, text_crc32) -> the same with (shard, slot). Read twice: give a stored table."""
    spark = sized.sparkSession
    points = ring(shards, vnodes)
    ends = np.array([p for p, _ in points], dtype=np.int64)
    cells = 4 * parallelism(spark)

    @F.pandas_udf("int")
    def arc_of(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for point in it:
            yield pd.Series(np.searchsorted(ends, point.to_numpy()) % len(ends), dtype="int32")

    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    keyed = sized.withColumn("_md5", digest) \
        .withColumn("_point", F.conv(F.substring("_md5", 1, RING_BITS // 4), 16, 10).cast("bigint")) \
        .withColumn("_arc", arc_of("_point")) \
        .withColumn("_cell", F.floor(F.col("_point") * cells / F.lit(1 << RING_BITS)).cast("int"))

    counts = sorted(tuple(r) for r in keyed.groupBy("_arc", "_cell").agg(F.count(F.lit(1)).alias("n")).collect())
    per_arc: dict[int, int] = {}
    for a, _, n in counts:
        per_arc[a] = per_arc.get(a, 0) + n
    runs = allot(sorted(per_arc.items()), points, quotas(sum(per_arc.values()), shards))
    pieces, before, last = [], 0, None
    for a, c, n in counts:
        before = 0 if a != last else before
        last = a
        mine = runs[a]
        for lo, hi, shard, slot in mine[max(0, bisect_left([x[1] for x in mine], before)):]:
            if lo >= before + n:
                break
            x, y = max(lo, before), min(hi, before + n)
            if x < y:
                pieces.append((a, c, x - before, y - before, shard, slot + x - lo))
        before += n
    table = spark.createDataFrame(pieces, "_a int, _c int, _lo bigint, _hi bigint, shard int, _slot bigint")

    w = Window.partitionBy("_arc", "_cell").orderBy("_md5", "doc_id", "size", "text_crc32")
    ranked = keyed.withColumn("_r", F.row_number().over(w) - 1)
    j = ranked.join(F.broadcast(table), (F.col("_arc") == F.col("_a")) & (F.col("_cell") == F.col("_c"))
                    & (F.col("_r") >= F.col("_lo")) & (F.col("_r") < F.col("_hi")))
    return j.select("doc_id", "size", "text_crc32", "shard", (F.col("_slot") + F.col("_r") - F.col("_lo")).alias("slot"))


def measure(docs: DataFrame) -> DataFrame:
    """The light table (doc_id, size, text_crc32); the one pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return take_columns(docs, "doc_id", "text").select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))


def shard_documents(docs: DataFrame, shards: int = 24, vnodes: int = 128) -> DataFrame:
    return place(stage(measure(docs), "bytes"), shards, vnodes)
