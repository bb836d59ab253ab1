"""Linking of word-shingle sets that meet in cells, without a list of the pairs of a cell.

Equal sets are one class, so any number of copies is one member. A joining operator describes each class by a
``mark``, from which it tells the pairs that may reach the threshold, and by keys; two sets that reach the threshold
must (surely, or but for a stated probability) share a key. The classes of a key, by size, are cut where the next is too
large to reach the threshold with the one before; runs of two or more are cells, named by their members, so cells
with the same members are one.

Round one takes a spanning forest of each cell's surviving pairs, strongest first, verifies them on the full
sets and joins what links. Round two takes, from the cells that still hold several components, the members that have a
surviving pair across components, brings their sets into the cell and compares them there, each pair whose ends
are still apart; what it sends are links that join components, fewer than the members. So every surviving pair is linked,
refuted, or inside one component, and no round sends all pairs of a group. Cells of more than ``CELL`` members
or ``CELL_GRAMS`` shingles are joined in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.llm.common import mix64, pack, parallelism, range_hash, slices, stage, take_columns, unpack, word_hashes, word_spans
from wardspark.llm.components import components

CELL, CELL_GRAMS = 2048, 4 << 20
BLOCKS_PER_PARTITION = 4
CLASS, ENTRIES = 0, 1


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's runs of ``k`` words (fewer words: of all of them)."""
    starts, ends, first = word_spans(data, offs)
    words = word_hashes(data, starts, ends, fold=True)
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    h = range_hash(words, at, at + np.repeat(np.minimum(n, k), count))
    cut = np.cumsum(count)
    return [np.unique(x) for x in np.split(h, cut[:-1])]


def class_key(s: np.ndarray) -> int:
    """One 64-bit key of a set, from two independent sums over its members and its size."""
    if len(s) == 0:
        return 0
    a, b = (np.array([mix64(x).sum(dtype=np.uint64)]) for x in (s, s ^ np.uint64(0xA0761D6478BD642F)))
    return int(mix64(a ^ (b * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(s)))).view(np.int64)[0])


def class_of(k: int):
    """Arrow function: the class key of each text."""
    @F.arrow_udf("bigint")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([class_key(x) for _, _, data, offs in slices(col) for x in shingle_sets(data, offs, k)], pa.int64())
    return run


# ------------------------------------------------------------------------------- cells
ROUTE = [("e_key", np.uint64), ("e_class", np.int64), ("e_n", np.uint32)]
ROUTED = "kind int, block int, doc_id bigint, hash bigint, class bigint, n int, mark binary, e_key binary, e_class binary, e_n binary"
MET = "kind int, doc_id bigint, hash bigint, class bigint, n int, mark binary, cell bigint, members int, weight bigint"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _route(k: int, blocks: int, describe: Callable):
    """(doc_id, hash, text) -> a row for each document with its class and, once a batch, the class's mark;
    and the keys of the batch's classes, dealt to blocks."""
    def run(batches):
        tell = describe()
        for batch in batches:
            classes, sizes, marks, keys, owners, counts, seen = [], [], [], [], [], [], set()
            for _, _, data, offs in slices(batch.column(2)):
                fresh = []
                for s in shingle_sets(data, offs, k):
                    key = class_key(s)
                    if len(s) and key not in seen:
                        seen.add(key)
                        fresh.append((len(classes), key, s))
                    classes.append(key)
                    sizes.append(len(s))
                    marks.append(None)
                for (at, key, s), (mark, found) in zip(fresh, tell([s for _, _, s in fresh])):
                    marks[at] = mark
                    keys.append(found)
                    owners.append(np.full(len(found), key, dtype=np.int64))
                    counts.append(np.full(len(found), len(s), dtype=np.uint32))
            n = len(classes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, CLASS, np.int32)), pa.array(np.arange(n, dtype=np.int32) % blocks), batch.column(0), batch.column(1), pa.array(classes, pa.int64()),
                 pa.array(sizes, pa.int32()), pa.array(marks, pa.binary()), *[pa.nulls(n, pa.binary())] * 3], _names(ROUTED))
            if not keys:
                continue
            key, owner, size = np.concatenate(keys), np.concatenate(owners), np.concatenate(counts)
            block = (key % np.uint64(blocks)).astype(np.int32)
            by = np.argsort(block, kind="stable")
            key, owner, size, block = key[by], owner[by], size[by], block[by]
            cuts = np.flatnonzero(np.diff(block, prepend=-1, append=blocks + 1))
            rows = [(block[a], pack(key[a:b]), pack(owner[a:b]), pack(size[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
            m = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, ENTRIES, np.int32)), pa.array([r[0] for r in rows], pa.int32()), *[pa.nulls(m, pa.int64())] * 3, pa.nulls(m, pa.int32()),
                 pa.nulls(m, pa.binary()), *[pa.array([r[c] for r in rows], pa.binary()) for c in (1, 2, 3)]], _names(ROUTED))
    return run


def _meet(percent: int):
    """Blocks of keys: document rows pass, keys become cells with the number of their members and shingles."""
    def run(batches):
        held = []
        for batch in batches:
            kind = batch.column(0).to_numpy()
            rows = batch.filter(pa.array(kind == CLASS))
            if rows.num_rows:
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays([rows.column(0), *[rows.column(c) for c in range(2, 7)], pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], _names(MET))
            mine = batch.filter(pa.array(kind == ENTRIES))
            for i in range(mine.num_rows):
                held.append([unpack(mine.column(c + 7)[i].as_buffer(), t) for c, (_, t) in enumerate(ROUTE)])
        if held:
            yield from _cells(*(np.concatenate(c) for c in zip(*held)), percent)
    return run


def _cells(key: np.ndarray, owner: np.ndarray, size: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((owner, size, key))
    key, owner, size = key[order], owner[order], size[order].astype(np.int64)
    keep = np.ones(len(key), dtype=bool)
    keep[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner, size = key[keep], owner[keep], size[keep]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (100 * size[:-1] < percent * size[1:])
    lead = np.flatnonzero(new)
    count = np.diff(np.append(lead, len(key)))
    many = np.repeat(count > 1, count)
    owner, size, count = owner[many], size[many], count[count > 1]
    if not len(owner):
        return
    lead = np.cumsum(count) - count
    mixed = mix64(owner.view(np.uint64))
    name = mix64(np.add.reduceat(mixed, lead) ^ mix64(np.bitwise_xor.reduceat(mix64(mixed + np.uint64(1)), lead) + count.astype(np.uint64)))
    _, one = np.unique(name, return_index=True)
    pick = np.zeros(len(count), dtype=bool)
    pick[one] = True
    rows = np.repeat(pick, count)
    cols = [np.repeat(name.view(np.int64), count)[rows], np.repeat(count, count)[rows].astype(np.int32), np.repeat(np.add.reduceat(size, lead), count)[rows]]
    owner = owner[rows]
    for i in range(0, len(owner), 1 << 16):
        o = owner[i:i + (1 << 16)]
        n = len(o)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, ENTRIES, np.int32)), *[pa.nulls(n, pa.int64())] * 2, pa.array(o), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                                          *[pa.array(c[i:i + (1 << 16)]) for c in cols]], _names(MET))


# ------------------------------------------------------------------------ block pairs
def need(n, m, percent: int):
    """Smallest overlap at which 100 overlap >= percent union."""
    return -(-percent * (n + m) // (100 + percent))


def spanning_forest(i, j, strength, label) -> np.ndarray:
    """Indexes of the pairs of a maximum spanning forest over the labels."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    keep = []
    for e in np.argsort(-strength, kind="stable"):
        a, b = root(label[i[e]]), root(label[j[e]])
        if a != b:
            up[a] = b
            keep.append(e)
    return np.array(keep, dtype=np.int64)


def _pairs_of(batches) -> Iterator[tuple[tuple, list]]:
    """Rows sorted by (cell, x, y) -> each block pair with its rows."""
    now, rows = None, []
    for batch in batches:
        for cell, x, y, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (cell, x, y) != now and rows:
                yield now, rows
                rows = []
            now = cell, x, y
            rows.append(row)
    if rows:
        yield now, rows


def _gathered(found: Iterator[tuple], names: list[str], size: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for cols in found:
        held.append(cols)
        n += len(cols[0])
        if n >= size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)


def _survivors(rows, survivors: Callable, percent: int):
    side, cls, comp, size, marks = zip(*rows)
    side, cls, comp, size = np.array(side), np.array(cls), np.array(comp), np.array(size, dtype=np.int64)
    lone = not side.any()
    i, j, strength = survivors(list(marks), size, side, lone, percent)
    apart = comp[i] != comp[j] if not lone else (comp[i] != comp[j]) & (i < j)
    return side, cls, comp, i[apart], j[apart], strength[apart]


def _forests(survivors: Callable, percent: int):
    """Block pairs -> the pairs of a spanning forest of their survivors."""
    def found(batches):
        for _, rows in _pairs_of(batches):
            _, cls, comp, i, j, strength = _survivors(rows, survivors, percent)
            e = spanning_forest(i, j, strength, comp)
            yield np.minimum(cls[i[e]], cls[j[e]]), np.maximum(cls[i[e]], cls[j[e]])
    return lambda batches: _gathered(found(batches), ["a", "b"])


OPEN = "cell bigint, x int, y int, side int, class bigint, comp bigint"


def _open(survivors: Callable, percent: int):
    """Block pairs -> their members with a surviving pair across components."""
    def found(batches):
        for (cell, x, y), rows in _pairs_of(batches):
            side, cls, comp, i, j, _ = _survivors(rows, survivors, percent)
            m = np.union1d(i, j)
            yield np.full(len(m), cell, np.int64), np.full(len(m), x, np.int32), np.full(len(m), y, np.int32), side[m].astype(np.int32), cls[m], comp[m]
    return lambda batches: _gathered(found(batches), _names(OPEN))


def join_sets(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of members that reach the threshold and join components, after which every pair across
    components has been refuted. Sets are compared with all others at once, by marks over their members."""
    size = np.array([len(s) for s in sets])
    label = np.unique(label, return_inverse=True)[1]
    lone = not side.any()
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(size) - size
    mine, at, out = np.zeros(len(names), dtype=bool), np.arange(len(sets)), []
    for i in range(len(sets)) if lone else np.flatnonzero(side == 0):
        other = (label != label[i]) & (at > i if lone else side == 1) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
        j = np.flatnonzero(other)
        if not len(j):
            continue
        own = ids[start[i]:start[i] + size[i]]
        mine[own] = True
        if 8 * size[j].sum() > len(ids):
            same = np.add.reduceat(mine[ids], start, dtype=np.int64)[j]
        else:
            same = np.array([np.count_nonzero(mine[ids[start[x]:start[x] + size[x]]]) for x in j])
        mine[own] = False
        for x in j[100 * same >= percent * (size[i] + size[j] - same)]:
            if label[x] != label[i]:
                label[label == label[x]] = label[i]
                out.append((i, x))
    return out


def _compare(percent: int):
    """Block pairs with sets -> links that join components."""
    def found(batches):
        for _, rows in _pairs_of(batches):
            side, cls, comp, sets = zip(*rows)
            cls = np.array(cls)
            pairs = join_sets([unpack(s, np.uint64) for s in sets], np.array(comp), np.array(side), percent)
            i, j = (np.array([p[c] for p in pairs], dtype=np.int64) for c in (0, 1))
            yield np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])
    return lambda batches: _gathered(found(batches), ["a", "b"])


def _paired(rows: DataFrame) -> DataFrame:
    keys = ["cell", "x", "y"]
    return rows.repartition(parallelism(rows.sparkSession), *keys).sortWithinPartitions(*keys, "class")


def _dealt(cells: DataFrame) -> DataFrame:
    """Members of cells, dealt to the pairs of their cell's blocks."""
    blocks = F.greatest(F.ceil(F.col("members") / CELL), F.ceil(F.col("weight") / CELL_GRAMS)).cast("int")
    mine = F.pmod(F.xxhash64("class"), blocks).cast("int")
    lower = F.transform(F.sequence(F.lit(0), mine), lambda x: F.struct(x.alias("x"), mine.alias("y"), F.when(x == mine, 0).otherwise(1).alias("side")))
    upper = F.when(mine + 1 < blocks, F.transform(F.sequence(mine + 1, blocks - 1), lambda y: F.struct(mine.alias("x"), y.alias("y"), F.lit(0).alias("side"))))
    pairs = F.concat(lower, F.coalesce(upper, F.array().cast("array<struct<x:int,y:int,side:int>>")))
    dealt = cells.withColumn("_p", F.explode(pairs)).select("cell", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"), F.col("_p.side").alias("side"), "class", "comp", "n", "mark")
    return _paired(dealt)


# ------------------------------------------------------------------------------ linking
def _sets(k: int):
    """The set of each wanted class, from a text of it; once a task."""
    def run(batches):
        sent = set()
        for batch in batches:
            wanted, at, keep, packed = batch.column(0).to_pylist(), 0, [], []
            for _, _, data, offs in slices(batch.column(1)):
                for s in shingle_sets(data, offs, k):
                    key = class_key(s)
                    if key == wanted[at] and key not in sent:
                        sent.add(key)
                        keep.append(key)
                        packed.append(pack(s))
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(packed, pa.binary())], ["class", "grams"])
    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = unpack(x.as_buffer(), np.uint64), unpack(y.as_buffer(), np.uint64)
                same = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * same >= percent * (len(a) + len(b) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("class").alias("a"), F.col("grams").alias("ga"))
    b = sets.select(F.col("class").alias("b"), F.col("grams").alias("gb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ga", "gb").mapInArrow(_verify(percent), "a bigint, b bigint")


def linked(docs: DataFrame, k: int, percent: int, describe: Callable, survivors: Callable, name: str) -> DataFrame:
    """-> (doc_id, n_shingles, component_id, class, comp): ``comp`` is the smallest class of the component and
    ``component_id`` its smallest doc_id (null where no member has one).

    ``describe()`` gives, in a task, the function from sets to (mark, keys); ``survivors(marks, sizes, side, lone,
    percent)`` gives the pairs (i, j, strength) that may reach the threshold, of one block or across two.
    """
    n = parallelism(docs.sparkSession)
    d = take_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    routed = d.mapInArrow(_route(k, n * BLOCKS_PER_PARTITION, describe), ROUTED)
    met = stage(routed.repartition(n, "block").mapInArrow(_meet(percent), MET), f"{name}-met")

    rows = met.where(F.col("kind") == CLASS).select("doc_id", "hash", "class", "n", "mark")
    first_id = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash"))
    classes = rows.where("n > 0").groupBy("class").agg(first_id.alias("rep"), F.max("n").alias("n"), F.max("mark").alias("mark"))
    members = met.where(F.col("kind") == ENTRIES).select("cell", "class", "members", "weight").distinct()
    points = stage(classes.join(members.select("class").distinct(), "class"), f"{name}-points")
    cells = stage(members.join(points.select("class", "n", "mark"), "class"), f"{name}-cells")

    first = _dealt(cells.withColumn("comp", F.col("class"))).mapInArrow(_forests(survivors, percent), "a bigint, b bigint").distinct()
    first = stage(first, f"{name}-pairs")
    # a forest touches every class that has a survivor, so round two needs no other sets
    paired = first.select(F.col("a").alias("class")).union(first.select("b")).distinct()
    wanted = points.join(paired, "class").select("class", F.col("rep.doc_id").alias("_id"), F.col("rep.hash").alias("_hash"))
    texts = d.join(wanted, d["doc_id"].eqNullSafe(wanted["_id"]) & (d["hash"] == wanted["_hash"])).select("class", "text")
    sets = stage(texts.mapInArrow(_sets(k), "class bigint, grams binary"), f"{name}-sets")
    links = stage(verify(first, sets, percent), f"{name}-links")
    labels = components(links).withColumnRenamed("node", "class")

    later = cells.join(labels, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    several = later.groupBy("cell").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo != _hi").select("cell")
    still = _dealt(later.join(several, "cell", "left_semi")).mapInArrow(_open(survivors, percent), OPEN)
    still = stage(still, f"{name}-open")
    with_sets = still.join(sets, "class").select("cell", "x", "y", "side", "class", "comp", "grams")
    more = _paired(with_sets).mapInArrow(_compare(percent), "a bigint, b bigint").distinct()
    labels = components(links.union(stage(more, f"{name}-links"))).select(F.col("node").alias("class"), "comp")

    own = F.coalesce("comp", "class").alias("comp")
    per_comp = classes.select("class", "rep").join(labels, "class", "left").groupBy(own).agg(F.min("rep.doc_id").alias("component_id"))
    out = rows.where("n > 0").join(labels, "class", "left").select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "class", own).join(per_comp, "comp")
    empty = rows.where("n = 0").select("doc_id", F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id"), *[F.lit(0).cast("bigint").alias(c) for c in ("class", "comp")])
    return out.select("doc_id", "n_shingles", "component_id", "class", "comp").unionByName(empty)


def oracle(k: int, percent: int, more: str = "") -> str:
    """DuckDB twin: shared shingles of all documents, links, and what they reach."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= {percent} * (x.n + y.n - same)),
r AS (SELECT DISTINCT a AS doc_id, a AS reach FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id{more}
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""
