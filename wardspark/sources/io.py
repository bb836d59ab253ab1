"""Readers and writers (A1-A3, A5-A10).

* explicit schemas for CSV (no inference), Parquet everywhere else;
* a stage is written once under ``<root>/<name>-<config hash>`` with a ``_SUCCESS``
  marker and re-read when present (skip-if-exists that cannot pick a stale config);
* per-client / per-source outputs are one dataset partitioned by the key and sorted by
  pid inside the files, so "one file per sample" becomes a pushed-down filter on pid.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardspark.operators.codes import parse_whitespace_table
from wardspark.operators.events import union_outer
from wardspark.sources.stage import stage  # noqa: F401  (stage outputs under a manifest)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_split_table(spark: SparkSession, paths: Sequence[str], reader: Callable[[str], DataFrame]) -> DataFrame:
    """One logical table stored as several files with different columns (outer union)."""
    return union_outer([reader(p) for p in paths])


def read_whitespace_table(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Header-less, whitespace-delimited text file with given column names."""
    return parse_whitespace_table(spark.read.text(path), names)


def arrays_to_json(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text export of array columns (JSON, not Python literals)."""
    return df.select(*[F.to_json(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def json_to_arrays(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Parse JSON text columns back with an explicit element type, e.g. {'dx': 'array<int>'}."""
    return df.select(*[F.from_json(F.col(c), cols[c]).alias(c) if c in cols else F.col(c) for c in df.columns])


def to_smallint(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nested int arrays -> SMALLINT (the fixed tensors fit in int16)."""
    out = df
    for c in cols:
        t = dict(df.dtypes)[c]
        target = t.replace("int", "smallint").replace("bigsmallint", "smallint")
        out = out.withColumn(c, F.col(c).cast(target))
    return out


def write_partitioned(df: DataFrame, path: str, key: str, pid: str, mode: str = "overwrite", files: int | None = None,
                      group_bytes: int = 8 << 20) -> None:
    """One dataset partitioned by ``key`` (client or source), laid out for access by pid.

    Rows are dealt over up to ``files`` ranges of (key, pid), so one client's size bounds no task, a file of a client
    holds one range of its pids, and a row group of ``group_bytes`` one part of that range. The groups' statistics, and a
    Bloom filter on pid for texts and hashes whose ranges overlap, let a read of one pid skip all groups but its own.
    """
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.repartitionByRange(n, key, pid).sortWithinPartitions(key, pid).write.mode(mode).partitionBy(key)
       .option(f"parquet.bloom.filter.enabled#{pid}", "true").option("parquet.block.size", str(group_bytes)).parquet(path))


def read_sample(spark: SparkSession, path: str, key: str, value: str, pid: str, pid_value) -> DataFrame:
    """Random access to one sample: partition pruning on ``key``, then row groups by their statistics and
    Bloom filters on pid."""
    return spark.read.parquet(path).where((F.col(key) == value) & (F.col(pid) == pid_value))
