"""N-gram Jaccard self-join by R-trees over count vectors.

A document is its set of distinct word n-grams (64-bit hashes; A-Z folded). Equal sets are one class,
so any number of copies is one point. Hashing the n-grams into ``GROUPS`` groups and counting gives the
class its point; the overlap of two sets is at most the sum of the coordinate minima, and, over the
points of an R-tree node, at most the sum of minima with the node's upper corner.

One R-tree over everything would have to open nearly all nodes for every query (random texts of like
length have like counts in every group), so the tree has an exact routing level above it: n-grams are
put in one global order, rare ones first, and two sets that reach the threshold share one of the first
n - ceil(t n) + 1 n-grams of each. Classes meet in the cells of those n-grams only (``cells``). In each cell an
R-tree (sorted by size, packed bottom up) is joined with itself: node pairs and then point pairs whose bound is
below the need are skipped; survivors are verified on the full sets, as ``cells`` says.

The order of n-grams only steers the amount of work: it is fitted on a bounded sample of about
``SAMPLE`` documents, whose n-grams found ``FREQUENT`` times or more count as frequent (at most
``MAX_FREQUENT`` of them).

Cases: a null or empty text has no n-gram, size 0 and links with nothing; fewer than n words are one
n-gram; repeated rows are copies; a null doc_id counts after all others; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardspark.llm.cells import class_of, linked, need, shingle_sets
from wardspark.llm.common import mix64, pack, slices, take_columns, unpack

GROUPS = 128                   # at least; larger sets get more, so that a group holds four to eight n-grams
NODE = 16
SAMPLE, FREQUENT, MAX_FREQUENT = 20_000, 3, 500_000


def groups(n: int) -> int:
    """Groups for a set of ``n``: a power of two, so points fold onto those of fewer groups."""
    g = GROUPS
    while g * 8 < n:
        g *= 2
    return g


def point(s: np.ndarray) -> np.ndarray:
    g = groups(len(s))
    return np.bincount((mix64(s) >> np.uint64(32)).astype(np.int64) % g, minlength=g).astype(np.uint16)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _rare_first(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if len(frequent) == 0:
        return s
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    often = frequent[at] == s
    return np.concatenate([s[~often], s[often]])


def tree_join(points: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int):
    """Survivors (i, j, bound) of the join of two point sets, given as row indexes. Both are sorted by
    size and packed into nodes; a node pair is opened only if sizes can fit and the sum of minima of
    one point set with the other node's upper corner reaches the need."""
    left, right = left[np.argsort(sizes[left], kind="stable")], right[np.argsort(sizes[right], kind="stable")]
    corners = [points[right[b:b + NODE]].max(axis=0) for b in range(0, len(right), NODE)]
    found = []
    for k, corner in enumerate(corners):
        r = right[k * NODE:(k + 1) * NODE]
        small, large = int(sizes[r[0]]), int(sizes[r[-1]])
        lo = int(np.searchsorted(sizes[left], -(-percent * small // 100)))
        hi = int(np.searchsorted(sizes[left], large * 100 // percent, side="right"))
        if lo >= hi:
            continue
        q = left[lo:hi]
        q = q[np.minimum(points[q], corner).sum(axis=1) >= need(sizes[q], small, percent)]
        for j in r if len(q) else ():
            bound = np.minimum(points[q], points[j]).sum(axis=1)
            ok = bound >= need(sizes[q], sizes[j], percent)
            if ok.any():
                i = q[ok]
                found.append((i, np.full(len(i), j), bound[ok] / (sizes[i] + sizes[j] - bound[ok])))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found))


def join_by_groups(points: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, lone: bool, percent: int):
    """``tree_join`` of points with different numbers of groups: sets that can link differ at most
    twofold, so each level is joined with itself and with the next, folded onto its groups."""
    level = np.array([len(p) for p in points])
    found = []
    for g in np.unique(level):
        here = np.flatnonzero((level == g) | (level == 2 * g))
        folded = np.zeros((len(points), g), dtype=np.int32)
        for i in here:
            folded[i] = points[i].reshape(-1, g).sum(axis=0)
        left = here if lone else here[side[here] == 0]
        right = here if lone else here[side[here] == 1]
        i, j, bound = tree_join(folded, sizes, left, right, percent)
        mine = (level[i] == g) | (level[j] == g)
        found.append((i[mine], j[mine], bound[mine]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _sample_grams(k: int):
    def run(batches):
        for batch in batches:
            sets = [s for _, _, data, offs in slices(batch.column(0)) for s in shingle_sets(data, offs, k)]
            g, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], ["gram", "n"])
    return run


def frequent_grams(d: DataFrame, k: int) -> np.ndarray:
    share = min(1.0, SAMPLE / max(1, d.count()))
    picked = d.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("gram")), F.lit(1 << 20)) < int(share * (1 << 20)))
    n = picked.select("text").mapInArrow(_sample_grams(k), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    top = n.orderBy(F.desc("n"), "gram").limit(MAX_FREQUENT).select("gram").toPandas()["gram"].to_numpy(dtype=np.int64)
    return np.sort(top.view(np.uint64))


def _describe(percent: int, frequent):
    """In a task: sets -> (point, n-grams of the routing level)."""
    def start():
        often = frequent.value
        return lambda sets: [(pack(point(s)), _rare_first(s, often)[:prefix_length(len(s), percent)]) for s in sets]
    return start


def _survivors(marks, sizes, side, lone, percent):
    return join_by_groups([unpack(m, np.uint16) for m in marks], sizes, side, lone, percent)


def link_documents(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """-> (doc_id, n_shingles, component_id, class): documents whose n-gram sets have a Jaccard
    similarity of ``percent`` or more are linked; the component is its smallest doc_id."""
    return _linked(docs, k, percent).drop("comp")


def _linked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """link_documents with ``comp``, the smallest class of the component."""
    often = docs.sparkSession.sparkContext.broadcast(frequent_grams(take_columns(docs, "doc_id", "text"), k))
    return linked(docs, k, percent, _describe(percent, often), _survivors, "ngram")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of linked ones: that of the smallest id (null ids last), of its rows that of the smallest
    class, and of its copies under that id one. Rows without a word stay, equal ones once. All columns stay as they were."""
    rows = _linked(docs, k, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class")).alias("_r")
    kept = rows.where("n_shingles > 0").groupBy("comp").agg(first).select(F.col("_r.doc_id").alias("_k"), F.col("_r.class").alias("_c"))
    kept = kept.union(rows.where("n_shingles = 0").select("doc_id", F.lit(0).cast("bigint")).distinct())
    # the class of a row tells it from others under its id; where an id has one class, its text isn't read
    ids = rows.groupBy(F.col("doc_id").alias("_i")).agg((F.min("class") != F.max("class")).alias("_many"))
    kept = kept.join(ids, F.col("_k").eqNullSafe(F.col("_i"))).select("_k", "_c", "_many")
    plain = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("`doc_id`").alias("_id"), F.xxhash64(F.col("`text`")).alias("_t"), F.xxhash64(*plain).alias("_o"))
    met = packed.join(kept, F.col("_id").eqNullSafe(F.col("_k")))
    met = met.withColumn("_own", class_of(k)(F.when(F.col("_many"), F.col("_doc.text")))).where("not _many or _own = _c")
    w = Window.partitionBy("_k", "_c", F.when(F.col("_c") == 0, F.col("_t")).otherwise(0)).orderBy("_o")
    return met.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("_doc.*")
