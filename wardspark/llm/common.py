"""Reading, staging and the vectorised word arithmetic the operators share.

The numpy helpers work on one Arrow batch inside a task, in slices of bounded size; Spark
partitions and shuffles everything else.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.sources.stage import session_dir

SLICE_BYTES = 1 << 18          # text bytes that one numpy step looks at
BATCH_BYTES = 8 << 20          # of an Arrow batch, so a task's memory doesn't follow the length of the rows
NULL_ID = (1 << 63) - 1        # a null doc_id sorts after every other


def bound_batches(spark: SparkSession) -> None:
    """Lower Spark's bound on the bytes of an Arrow batch (64 MB unless set) to BATCH_BYTES."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b").rstrip("b") == "67108864":
        spark.conf.set(key, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the session's folder in the shared one and read it back: a lineage cut that survives lost
    executors, and Parquet, so later readers prune columns. ``sources.stage.owned`` clears it."""
    spark = df.sparkSession
    path = f"{session_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def take_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named input columns, so extra columns of any name can't clash."""
    bound_batches(df.sparkSession)
    return df.select(*[F.col(f"`{n}`") for n in names])


# ------------------------------------------------------------------------- word arithmetic
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_FOLD = _BYTE.copy()
_BYTE_FOLD[65:91] = _BYTE[97:123]
_BASE = 0x5851F42D4C957F2D     # odd, so it has an inverse modulo 2^64
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 64)
        have = np.full(size, np.uint64(base), dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * SLICE_BYTES:
            _POW[base] = have
    return have


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of ``values[starts:ends]`` for many ranges, by one prefix sum."""
    n = len(values)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _powers(_BASE, n)[:n], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * _powers(_BASE_INV, n + 1)[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def slices(col: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``max_bytes`` (one row at least):
    first row, end row, their UTF-8 bytes, and each row's offset in them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if len(col) == 0:
        return
    wide = pa.types.is_large_string(col.type)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, side="right")) - 1)
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of bytes other than space, tab, LF, VT, FF, CR: start and end byte of each
    word, and for each row the index of its first word (one more entry at the end)."""
    space = _IS_SPACE[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = space[1:] != space[:-1]
    edge[offs[(offs > 0) & (offs < len(data))]] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    keep = ~space[starts]
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hash of each word (``fold``: A-Z as a-z), in steps of about SLICE_BYTES."""
    table = _BYTE_FOLD if fold else _BYTE
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, side="right")))
        lo = starts[i]
        out[i:j] = range_hash(table[data[lo:ends[j - 1]]], starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words (rows aren't told apart here)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    starts = np.arange(n)
    return range_hash(words, starts, starts + k)


def pack(a: np.ndarray) -> bytes:
    """Byte planes of an integer array: equal high bytes lie together, so the shuffle's
    compression removes them."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unpack(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(b, dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def ids_of(col: pa.Array) -> np.ndarray:
    return pc.fill_null(col, NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
