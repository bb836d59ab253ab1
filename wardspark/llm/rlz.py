"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks.

Every document is at once text to parse and reference for the documents after it. The reference
index is dealt into blocks by seed hash, so each block indexes a share of the seeds of all documents
and each document is looked up in every block that any of its seeds belongs to.

1. Seeds. In every window of ``window`` words one run of ``seed`` words is the window's seed (the one
   of smallest hash, the leftmost of equals), so equal windows have equal seeds at equal places.
   Consecutive windows with the same seed form a piece: about 14 windows of text in one entry.
2. Blocks. Within a block, equal pieces (same seed, same words, same place of the seed) are one
   reference; every later copy of a piece is a factor piece. Inside one Arrow batch copies are
   settled before the shuffle, so a text that fills a third of the table sends one entry a batch.
3. Factor boundaries. A seed whose pieces differ is where a copied passage begins or ends. The
   earliest piece of each kind there is opened into its windows, and these are compared one by one.
4. Parse. A document's factors are read off greedily, left to right: the longest run of windows that
   follow one reference. Words covered by a window that starts earlier elsewhere are removed.

Results are exact for windows of ``window`` words (64-bit hashes of words and windows).

Cases: a null text has no words; texts shorter than a window keep all words; a null doc_id sorts
after all others; rows with equal doc_id and text get equal results, and neither counts as earlier
than the other; rows with equal doc_id and different texts are told apart by a checksum of the
text; a doc_id of 2^63-1 is taken for null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.llm.common import ids_of, pack, parallelism, range_hash, shingles, slices, stage, take_columns, unpack, word_hashes, word_spans

BLOCKS_PER_PARTITION = 4

# Columns of an index entry in a blob, in order, with their types.
ENTRY = [("e_seed", np.uint64), ("e_piece", np.uint64), ("e_doc", np.int64), ("e_tag", np.uint32), ("e_start", np.int32), ("e_n", np.int32)]
BLOB = "kind int, block int, doc_id bigint, tag bigint, start int, n int, ref_doc bigint, ref_start int, n_words bigint, sha string, " + ", ".join(f"{c} binary" for c, _ in ENTRY)
FLAG = "kind int, doc_id bigint, tag bigint, start int, n int, ref_doc bigint, ref_start int, n_words bigint, sha string"
FACTOR, BOUNDARY, DOCUMENT, ENTRIES = 0, 1, 2, 3


def pieces(words: np.ndarray, first: np.ndarray, window: int, seed: int):
    """Pieces of all rows: index of the row, first window, number of windows, seed hash, piece hash."""
    span = window - seed + 1
    n = np.diff(first)
    windows = np.maximum(n - window + 1, 0)
    row = np.repeat(np.arange(len(n)), windows)
    if len(row) == 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    start = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + first[:-1][row]
    g = shingles(words, seed)
    low = np.empty(len(start), dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, span)
    for i in range(0, len(start), 1 << 16):
        at = start[i:i + (1 << 16)]
        # starts of one slice lie in one range of the view, so no gather of whole windows is needed
        low[i:i + len(at)] = view[at[0]:at[-1] + 1].argmin(axis=1)[at - at[0]]
    at = start + low
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    lead = np.flatnonzero(new)
    count = np.diff(np.append(lead, len(at)))
    s = start[lead]
    body = range_hash(words, s, s + count + window - 1)
    piece = body ^ ((at[lead] - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return row[lead], s, count, g[at[lead]], piece


def _later(seed, piece, doc, start):
    """Order of entries by (seed, piece, doc, start); for each entry in that order the place of the
    first of its equals, and whether it comes later than that one."""
    order = np.lexsort((start, doc, piece, seed))
    k, p, d, s = seed[order], piece[order], doc[order], start[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    return order, new, head, (d != d[head]) | (s != s[head])


def _batch(kind: int, schema_blob: bool, rows: int, /, **cols) -> pa.RecordBatch:
    types = [("kind", pa.int32())] + ([("block", pa.int32())] if schema_blob else []) + [
        ("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("ref_doc", pa.int64()),
        ("ref_start", pa.int32()), ("n_words", pa.int64()), ("sha", pa.string())] + ([(c, pa.binary()) for c, _ in ENTRY] if schema_blob else [])
    cols["kind"] = np.full(rows, kind, dtype=np.int32)
    return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(rows, t) for c, t in types], [c for c, _ in types])


def _sha(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    buf = data.tobytes()
    return hashlib.sha256(b" ".join([buf[a:b] for a, b in zip(starts.tolist(), ends.tolist())])).hexdigest()


def _index(window: int, seed: int, blocks: int):
    def run(batches):
        for batch in batches:
            ids, tags = ids_of(batch.column(0)), batch.column(1).to_numpy()
            parts: list = []
            for lo, hi, data, offs in slices(batch.column(2)):
                starts, ends, first = word_spans(data, offs)
                words = word_hashes(data, starts, ends)
                row, s, n, key, piece = pieces(words, first, window, seed)
                parts.append((key, piece, ids[lo:hi][row], tags[lo:hi][row].astype(np.uint32), (s - first[row]).astype(np.int32), n.astype(np.int32)))
                shas = []
                for i in range(hi - lo):
                    a, b = first[i], first[i + 1]
                    shas.append(_sha(data[offs[i]:offs[i + 1]], starts[a:b] - offs[i], ends[a:b] - offs[i]))
                yield _batch(DOCUMENT, True, hi - lo, block=np.arange(lo, hi, dtype=np.int32) % blocks, doc_id=ids[lo:hi], tag=tags[lo:hi], n_words=np.diff(first), sha=shas)
            if not parts:
                continue
            key, piece, doc, tag, start, n = (np.concatenate(c) for c in zip(*parts))
            order, new, head, late = _later(key, piece, doc, start)
            yield from _factors(order, head, late, doc, tag, start, n, True, blocks)
            # an entry that equals the batch's first one in id and place is a repeated row: it is kept too
            kept = order[~late]
            block = (key[kept] % np.uint64(blocks)).astype(np.int32)
            by = np.argsort(block, kind="stable")
            kept, block = kept[by], block[by]
            cuts = np.flatnonzero(np.diff(block, prepend=-1, append=blocks + 1))
            rows = {c: [] for c, _ in ENTRY}
            for a, b in zip(cuts[:-1], cuts[1:]):
                at = np.sort(kept[a:b])
                for (c, _), values in zip(ENTRY, (key, piece, doc, tag, start, n)):
                    rows[c].append(pack(values[at]))
            if len(kept):
                yield _batch(ENTRIES, True, len(cuts) - 1, block=block[cuts[:-1]], **rows)
    return run


def _factors(order, head, late, doc, tag, start, n, blob: bool, blocks: int = 1):
    """Settled pieces; they need no block any more and are dealt evenly."""
    at, ref = order[late], order[head[late]]
    for i in range(0, len(at), 1 << 16):
        a, r = at[i:i + (1 << 16)], ref[i:i + (1 << 16)]
        more = {"block": np.arange(len(a), dtype=np.int32) % blocks} if blob else {}
        yield _batch(FACTOR, blob, len(a), doc_id=doc[a], tag=tag[a].astype(np.int64), start=start[a], n=n[a], ref_doc=doc[r], ref_start=start[r], **more)


def _lookup(batches):
    """One partition of blocks: passes on what is settled, then settles its entries."""
    names = [x.split()[0] for x in FLAG.split(", ")]
    held: list = []
    for batch in batches:
        kind = batch.column(0).to_numpy()
        settled = batch.filter(pa.array(kind != ENTRIES)).select(names)
        if settled.num_rows:
            yield settled
        mine = batch.filter(pa.array(kind == ENTRIES))
        for i in range(mine.num_rows):
            held.append([unpack(mine.column(c)[i].as_buffer(), t) for c, t in ENTRY])
    if not held:
        return
    key, piece, doc, tag, start, n = (np.concatenate(c) for c in zip(*held))
    held.clear()
    order, new, head, late = _later(key, piece, doc, start)
    yield from _factors(order, head, late, doc, tag, start, n, False)
    # seeds with pieces of several kinds: the first piece of each kind is opened later
    k = key[order]
    first = np.flatnonzero(~late)
    lead = np.flatnonzero(new)
    kinds = np.diff(np.append(np.flatnonzero(np.diff(k[lead], prepend=~k[lead[:1]])), len(lead)))
    several = np.repeat(kinds > 1, kinds)
    mixed = np.zeros(len(order), dtype=bool)
    mixed[lead] = several
    open_ = order[first[mixed[head[first]]]]
    for i in range(0, len(open_), 1 << 16):
        a = open_[i:i + (1 << 16)]
        yield _batch(BOUNDARY, False, len(a), doc_id=doc[a], tag=tag[a].astype(np.int64), start=start[a], n=n[a])


def _windows(window: int):
    """Rows (doc_id, tag, text, flags) -> the windows of their boundary pieces."""
    def run(batches):
        for batch in batches:
            ids, tags, flags = ids_of(batch.column(0)), batch.column(1).to_numpy(), batch.column(3)
            lengths = pc.list_value_length(flags).to_numpy(zero_copy_only=False).astype(np.int64)
            ends_at = np.cumsum(lengths)
            flat = flags.flatten()
            kind, fs, fn = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for lo, hi, data, offs in slices(batch.column(2)):
                starts, ends, first = word_spans(data, offs)
                words = word_hashes(data, starts, ends)
                a, b = ends_at[lo] - lengths[lo], ends_at[hi - 1]
                row = np.repeat(np.arange(hi - lo), lengths[lo:hi])
                pick = kind[a:b] == BOUNDARY
                row, s, n = row[pick], fs[a:b][pick].astype(np.int64), fn[a:b][pick].astype(np.int64)
                row = np.repeat(row, n)
                at = np.repeat(s, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                h = range_hash(words, first[row] + at, first[row] + at + window)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[lo:hi][row]), pa.array(tags[lo:hi][row]), pa.array(at.astype(np.int32))],
                                                 ["h", "doc_id", "tag", "start"])
    return run


def parse(start, n, ref_doc, ref_start, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (first word, words, reference document, its first word) from matched runs of
    windows. Runs that continue the same reference are one factor; a factor ends where the next
    window follows another reference, and the next begins behind it."""
    out, i, done = [], 0, 0
    runs = sorted(zip(start, n, ref_doc, ref_start))
    while i < len(runs):
        s, k, d, r = runs[i]
        end = s + k
        while i + 1 < len(runs) and runs[i + 1][0] == end and runs[i + 1][2] == d and runs[i + 1][3] - r == end - s:
            i += 1
            end += runs[i][1]
        last = end + window - 1
        at = max(s, done)
        if last > at:
            out.append((int(at), int(last - at), int(d), int(r + at - s)))
            done = last
        i += 1
    return out


def _remove(window: int):
    """Rows (doc_id, tag, text, flags, windows) -> result rows with the factors."""
    def run(batches):
        for batch in batches:
            docs, flags, wins = batch.column(0), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            n_words, n_removed, shas, factors = [], [], [], []
            for lo, hi, data, offs in slices(batch.column(2)):
                starts, ends, first = word_spans(data, offs)
                for i in range(lo, hi):
                    a, b = first[i - lo], first[i - lo + 1]
                    runs = [(f["start"], f["n"], f["ref_doc"], f["ref_start"]) for f in flags[i] if f["kind"] == FACTOR]
                    runs += [(w["start"], 1, w["ref_doc"], w["ref_start"]) for w in wins[i] or []]
                    edge = np.zeros(b - a + 1, dtype=np.int64)
                    if runs:
                        s, n, d, r = (np.array(c, dtype=np.int64) for c in zip(*runs))
                        np.add.at(edge, s, 1)
                        np.add.at(edge, s + n + window - 1, -1)
                        factors.append([{"start": x, "n": k, "ref_doc": y, "ref_start": z} for x, k, y, z in parse(s, n, d, r, window)])
                    else:
                        factors.append([])
                    keep = np.cumsum(edge)[:-1] == 0
                    n_words.append(int(b - a))
                    n_removed.append(int((~keep).sum()))
                    shas.append(_sha(data, starts[a:b][keep], ends[a:b][keep]))
            yield pa.RecordBatch.from_arrays([docs, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string()),
                                              pa.array(factors, pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64()), ("ref_doc", pa.int64()), ("ref_start", pa.int64())])))],
                                             ["doc_id", "n_words", "n_removed", "kept_sha256", "factors"])
    return run


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, factors array<struct<start:bigint,n:bigint,ref_doc:bigint,ref_start:bigint>>"


def dedup_substrings(docs: DataFrame, window: int = 20, seed: int = 8) -> DataFrame:
    """-> (doc_id, n_words, n_removed, kept_sha256, factors), one row per document."""
    spark = docs.sparkSession
    n = parallelism(spark)
    d = take_columns(docs, "doc_id", "text").withColumn("tag", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    entries = d.select("doc_id", "tag", "text").mapInArrow(_index(window, seed, n * BLOCKS_PER_PARTITION), BLOB)
    flags = stage(entries.repartition(n, "block").mapInArrow(_lookup, FLAG), "rlz-flags")

    hit = flags.where(F.col("kind") <= BOUNDARY).groupBy("doc_id", "tag").agg(
        F.collect_set(F.struct("kind", "start", "n", "ref_doc", "ref_start")).alias("flags"))  # repeated rows flag the same
    keyed = d.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "tag", "text")
    found = stage(keyed.join(hit, ["doc_id", "tag"]).select("doc_id", "tag", "text", "flags"), "rlz-found")

    wins = stage(found.mapInArrow(_windows(window), "h bigint, doc_id bigint, tag bigint, start int").distinct(), "rlz-windows")
    first = stage(wins.groupBy("h").agg(F.min(F.struct("doc_id", "start")).alias("ref"), F.count(F.lit(1)).alias("c"))
                  .where("c > 1").select("h", F.col("ref.doc_id").alias("ref_doc"), F.col("ref.start").alias("ref_start")), "rlz-first")
    late = wins.join(first, "h").where((F.col("doc_id") != F.col("ref_doc")) | (F.col("start") != F.col("ref_start")))
    late = late.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "ref_doc", "ref_start")).alias("late"))
    cut = found.join(late, ["doc_id", "tag"], "left").select("doc_id", "tag", "text", "flags", "late").mapInArrow(_remove(window), RESULT)

    whole = flags.where(F.col("kind") == DOCUMENT).select("doc_id", "tag", "n_words", "sha")
    rest = whole.join(hit.select("doc_id", "tag"), ["doc_id", "tag"], "left_anti").select(
        "doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("sha").alias("kept_sha256"),
        F.array().cast("array<struct<start:bigint,n:bigint,ref_doc:bigint,ref_start:bigint>>").alias("factors"))
    return cut.unionByName(rest).withColumn("doc_id", F.when(F.col("doc_id") != (1 << 63) - 1, F.col("doc_id")))
