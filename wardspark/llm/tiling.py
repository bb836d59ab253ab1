"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, A-Z folded. A document meets a benchmark item where they share a
seed of ``SEED`` consecutive words. For such a pair all matches of at least ``min_match`` words are found
by Karp-Rabin fingerprints of word runs, and the longest match whose words are still free on both sides
is marked as a tile, again and again, so moved passages are covered as well as copied ones. A document
is contaminated by an item if tiles cover at least ``coverage`` of the item's words; items of fewer than
``min_match`` words must be matched whole.

The benchmark is the query set: it is read in blocks of at most ``BLOCK_BYTES`` of text, and every
document is tiled against every block inside its task, so nothing is shuffled.

Cases: null and empty documents match nothing; null and empty items are skipped; an item without an id is
reported without one; repeated items are
reported each, repeated documents each; an empty benchmark leaves all documents; ties between matches go
to the earliest place in the item, then in the document; extra columns pass through.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.llm.common import range_hash, slices, take_columns, word_hashes, word_spans

SEED = 4
BLOCK_BYTES = 16 << 20
PAIRS_HELD = 1 << 20           # equal runs of an item and a document listed at once

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[i for i in range(128) if not chr(i).isalnum()]] = 0x20
_PLAIN[65:91] += 32


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    plain = _PLAIN[data]
    starts, ends, first = word_spans(plain, offs)
    return word_hashes(plain, starts, ends), first


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin fingerprints of all runs of ``k`` words."""
    at = np.arange(max(len(words) - k + 1, 0))
    return range_hash(words, at, at + k)


def diagonals(item: np.ndarray, doc: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches (length, place in item, place in document) that can't be extended, of ``m`` words or more. Runs
    grow along the diagonals, one word of the item after the other, so no list of all pairs of equal runs is held."""
    out, run = [], np.zeros(len(doc) + 1, dtype=np.int64)  # run[j + 1]: words matched that end at item[i], doc[j]
    for i, w in enumerate(item):
        grown = np.zeros_like(run)
        same = np.flatnonzero(doc == w)
        grown[same + 1] = run[same] + 1
        ends = np.append(grown[1:], 0) != run + 1
        j = np.flatnonzero(ends & (run >= m))
        out.append((run[j], i - run[j], j - run[j]))
        run = grown
    j = np.flatnonzero(run >= m)
    out.append((run[j], len(item) - run[j], j - run[j]))
    return tuple(np.concatenate(c) for c in zip(*out))


def matches(item: np.ndarray, doc: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``diagonals``, by Karp-Rabin fingerprints where few runs are equal."""
    a, b = runs(item, m), runs(doc, m)
    order = np.argsort(a, kind="stable")
    lo, hi = np.searchsorted(a[order], b), np.searchsorted(a[order], b, side="right")
    if (hi - lo).sum() > PAIRS_HELD:
        return diagonals(item, doc, m)
    t = np.repeat(np.arange(len(b)), hi - lo)
    at = np.arange(len(t)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    p = order[at]
    by = np.lexsort((p, t - p))
    p, t = p[by], t[by]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[1:] != p[:-1] + 1) | (t[1:] != t[:-1] + 1)
    lead = np.flatnonzero(new)
    return np.diff(np.append(lead, len(p))) + m - 1, p[lead], t[lead]


def tile(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in document, words), longest first."""
    m = min(min_match, len(item))
    if m == 0 or len(doc) < m:
        return []
    heap = [(-n, i, j) for n, i, j in zip(*(c.tolist() for c in matches(item, doc, m)))]
    heapq.heapify(heap)
    free_item, free_doc, out = np.ones(len(item), dtype=bool), np.ones(len(doc), dtype=bool), []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = free_item[i:i + n] & free_doc[j:j + n]
        if free.all():
            free_item[i:i + n] = free_doc[j:j + n] = False
            out.append((i, j, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if y - x >= m:
                heapq.heappush(heap, (x - y, i + x, j + x))
    return out


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, one block at a time on the driver."""
    b = take_columns(benchmark, "item_id", "text").where(F.length("text") > 0)
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for k in range(n):
        yield sorted(((r[0], r[1]) for r in b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def prepare(items: list[tuple[int, str]]):
    """Item words, and the sorted seeds with the items of each."""
    words, seeds, owners = [], [], []
    for i, (_, text) in enumerate(items):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        w, _ = tokens(raw, np.array([0, len(raw)]))
        words.append(w)
        s = np.unique(runs(w, min(SEED, len(w)))) if len(w) else np.zeros(0, np.uint64)
        seeds.append(s)
        owners.append(np.full(len(s), i))
    seed, owner = np.concatenate(seeds), np.concatenate(owners)
    order = np.argsort(seed, kind="stable")
    return [i for i, _ in items], words, seed[order], owner[order]


def _tile_rows(col: pa.Array, block, coverage: float, min_match: int):
    """(row, item, tiles, covered words) of contaminated rows."""
    _, words, seed, owner = block
    short = sorted({len(w) for w in words if 0 < len(w) < SEED})
    for lo, hi, data, offs in slices(col):
        doc, first = tokens(data, offs)
        met: dict[int, set[int]] = {}
        for k in [SEED, *short]:
            r = runs(doc, k)
            a, b = np.searchsorted(seed, r), np.searchsorted(seed, r, side="right")
            for at in np.flatnonzero(b > a).tolist():
                row = int(np.searchsorted(first, at, side="right")) - 1
                if at + k <= first[row + 1]:
                    met.setdefault(row, set()).update(owner[a[at]:b[at]].tolist())
        for row in sorted(met):
            mine = doc[first[row]:first[row + 1]]
            for i in sorted(met[row]):
                if len(words[i]) * coverage > np.isin(words[i], mine).sum():
                    continue
                found = tile(words[i], mine, min_match)
                covered = sum(n for _, _, n in found)
                if covered >= coverage * len(words[i]):
                    yield lo + row, i, found, covered


PAIRS = "doc_id bigint, item_id bigint, covered int, n_tokens int, coverage double, tiles array<struct<item_start:int,doc_start:int,n:int>>"


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.6, min_match: int = 4) -> DataFrame:
    """One row for each document and item that contaminates it, with the tiles as evidence."""
    spark = docs.sparkSession
    d = take_columns(docs, "doc_id", "text")
    out = spark.createDataFrame([], PAIRS)
    for items in blocks(benchmark):
        sent = spark.sparkContext.broadcast(prepare(items))

        def run(batches, sent=sent):
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = []
                for row, i, found, covered in _tile_rows(batch.column(1), sent.value, coverage, min_match):
                    n = len(sent.value[1][i])
                    rows.append((ids[row], sent.value[0][i], covered, n, covered / n, [{"item_start": a, "doc_start": b, "n": c} for a, b, c in found]))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.struct([(c, pa.int32()) for c in ("item_start", "doc_start", "n")]))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "item_id", "covered", "n_tokens", "coverage", "tiles"])

        out = out.unionByName(d.mapInArrow(run, PAIRS))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.6, min_match: int = 4) -> DataFrame:
    """The documents that no item contaminates, all columns as they were."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    for items in blocks(benchmark):
        packed = packed.where(~_dirty(docs, prepare(items), coverage, min_match, F.col("_doc").getField("text")))
    return packed.select("_doc.*")


def _dirty(docs: DataFrame, block, coverage: float, min_match: int, text: Column) -> Column:
    sent = docs.sparkSession.sparkContext.broadcast(block)

    @F.arrow_udf("boolean")
    def dirty(col: pa.Array) -> pa.Array:
        hit = np.zeros(len(col), dtype=bool)
        for row, *_ in _tile_rows(col, sent.value, coverage, min_match):
            hit[row] = True
        return pa.array(hit)

    return dirty(text)
