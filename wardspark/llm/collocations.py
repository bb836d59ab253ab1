"""Mining of phrase collocations by Misra-Gries summaries, with exact counts in a second pass.

Texts of a language are packed into chunks: the lower-cased words as a dictionary and one code a word,
with marks where a piece (a run without separators) begins. A chunk counts its phrases of up to ``LONGEST``
words exactly, by ranks of codes.

First pass: phrases are dealt by hash over partitions; a chunk sends each partition the 32-bit fingerprints
and counts of its phrases. A partition merges them into one Misra-Gries summary whose capacity exceeds the
partition's mass divided by the threshold, so that what the summary takes from any count stays below
the threshold and every phrase that reaches it survives; equal fingerprints only let more survive. Second
pass: the partition goes over what it got again and sums the survivors' counts, and answers each chunk with one bit a
phrase; the chunk sends the words and exact counts of the phrases so marked to their partitions, which sum them by
the phrase itself, and the threshold is applied to these sums. No table of phrases is broadcast or held whole, and a
common phrase is one entry a chunk.

Scores, cuts and the phrases inside longer ones are joins of the exact counts; the first phrases of a language
are found by a ranked limit that prunes before it shuffles.

Cases: a null or empty text has no words; a null language is ``und`` (with rows that say so); repeated rows
count each time; a text of any length is cut into segments that look ahead into the next, so no phrase is lost;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspark.llm.common import mix64, pack, parallelism, slices, stage, take_columns, unpack, word_hashes

LONGEST = 4                    # words of a phrase
CHUNK_BYTES = 3 << 20          # text of a chunk
SEGMENT = 1 << 18              # words of a segment of one text
PART_MASS = 8 << 20            # phrases counted in one hash partition, about
HEAD, AHEAD = 1, 2             # flags of a word: begins a piece; only looked at from the words before

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 2


# ------------------------------------------------------------------------------- chunks
def piece_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word of the rows, and whether a piece begins there."""
    kind = _KIND[data]
    word = kind == 0
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = word[1:] != word[:-1]
    edge[offs[(offs > 0) & (offs < len(data))]] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = word[starts] if len(data) else np.zeros(0, dtype=bool)
    starts, ends = starts[keep], ends[keep]
    broken = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(kind == 2, out=broken[1:])
    piece, row = broken[starts], np.searchsorted(offs, starts, side="right")
    head = np.ones(len(starts), dtype=bool)
    head[1:] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
    return starts, ends, head


def segments(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of words of the rows: bytes, starts, ends, flags; a run's last words look ahead into the next run."""
    data = _LOWER[data]
    starts, ends, head = piece_words(data, offs)
    for a in range(0, len(starts), SEGMENT):
        b = min(a + SEGMENT, len(starts))
        c = min(b + LONGEST - 1, len(starts))
        flags = head[a:c] * np.uint8(HEAD)
        flags[0] |= HEAD
        flags[b - a:] |= AHEAD
        lo = starts[a]
        yield data[lo:ends[c - 1]], starts[a:c] - lo, ends[a:c] - lo, flags


def _chunk(segs) -> tuple[int, bytes, bytes]:
    """Words counted, the distinct words joined by line ends, and the packed codes and flags."""
    base = np.cumsum([0] + [len(s[0]) for s in segs])
    data = np.concatenate([s[0] for s in segs])
    starts, ends = (np.concatenate([s[k] + b for s, b in zip(segs, base)]) for k in (1, 2))
    flags = np.concatenate([s[3] for s in segs])
    _, one, codes = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    raw = data.tobytes()
    words = b"\n".join(raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist()))
    packed = pa.compress(pack((codes.astype(np.uint32) << 2) | flags), codec="zstd", asbytes=True)
    return int((flags & AHEAD == 0).sum()), words, len(codes).to_bytes(8, "little") + packed


CHUNKS = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.binary()), ("codes", pa.binary())])


def _chunks(batches):
    """(lang, text) -> chunks. Languages fill up beside each other, together at most four chunks."""
    held, size, made = {}, {}, TaskContext.get().partitionId() << 32

    def flush(lang):
        nonlocal made
        n, words, codes = _chunk(held.pop(lang))
        size.pop(lang)
        made += 1
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((made, lang, n, words, codes), CHUNKS.types)], schema=CHUNKS)

    for batch in batches:
        langs = batch.column(0)
        for lang in pc.unique(langs).to_pylist():
            mine = batch.filter(pc.equal(langs, lang))
            for _, _, data, offs in slices(mine.column(1)):
                for seg in segments(data, offs):
                    held.setdefault(lang, []).append(seg)
                    size[lang] = size.get(lang, 0) + len(seg[0])
                    if size[lang] >= CHUNK_BYTES:
                        yield flush(lang)
            while sum(size.values()) > 4 * CHUNK_BYTES:
                yield flush(max(size, key=size.get))
    for lang in list(held):
        yield flush(lang)


def chunks(docs: DataFrame) -> DataFrame:
    d = take_columns(docs, "lang", "text").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where("text is not null")
    return d.mapInArrow(_chunks, "chunk bigint, lang string, n bigint, words binary, codes binary")


# ------------------------------------------------------------------- phrases of one chunk
def sorted_places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys (0 or more) in order, and the place of each; equal keys by place. Key and place are sorted as one
    number where 63 bits hold both."""
    bits = len(key).bit_length()
    if len(key) and int(key.max()).bit_length() + bits <= 63:
        both = np.sort((key << bits) | np.arange(len(key)))
        return both >> bits, both & ((1 << bits) - 1)
    order = np.argsort(key, kind="stable")
    return key[order], order


def ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank of each key among the distinct ones; a place and the count of each of these."""
    ordered, place = sorted_places(key)
    new = np.append(True, ordered[1:] != ordered[:-1])
    lead = np.flatnonzero(new)
    rank = np.empty(len(key), dtype=np.int64)
    rank[place] = np.cumsum(new) - 1
    return rank, place[lead], np.diff(np.append(lead, len(key)))


class Phrases:
    """The distinct phrases of a chunk: first word (``at``), length (``k``), count, and their places in the
    hash partitions (``part``, ``mark``), in the order of (part, mark)."""

    def __init__(self, lang: str, words: bytes, codes: bytes, parts: int):
        size = 4 * int.from_bytes(codes[:8], "little")
        v = unpack(pa.decompress(codes[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint32)
        self.codes, flags = (v >> 2).astype(np.int64), v & 3
        self.words = pa.array(words.split(b"\n"), pa.binary()).cast(pa.string())
        text = np.frombuffer(words, dtype=np.uint8)
        ends = np.append(np.flatnonzero(text == 10), len(text))
        own = word_hashes(text, np.append(0, ends[:-1] + 1), ends)
        piece = np.cumsum(flags & HEAD)
        seed = np.uint64(int.from_bytes(lang.encode(), "little") % ((1 << 61) - 1) + 1)
        # starts of this length, and the rank of the phrase that begins at each
        start = np.flatnonzero(flags & AHEAD == 0)
        rank, at, k, count, names = self.codes[start], [], [], [], []
        for length in range(1, LONGEST + 1):
            if length > 1:  # the rank of the shorter phrase and the last word's code give that of this one
                inside = start + length - 1 < len(piece)
                inside[inside] = piece[start[inside] + length - 1] == piece[start[inside]]
                start = start[inside]
                rank = rank[inside] * len(self.words) + self.codes[start + length - 1]
            if not len(start):
                break
            rank, one, n = ranks(rank)
            first = start[one]
            h = np.full(len(first), mix64(np.array([seed]))[0])
            for j in range(length):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + own[self.codes[first + j]])
            at.append(first)
            k.append(np.full(len(first), length, dtype=np.int8))
            count.append(n)
            names.append(h)
        h = np.concatenate(names)
        part, mark = ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
        order = sorted_places((part << 32) | mark)[1]
        self.part, self.mark = part[order].astype(np.int32), mark[order].astype(np.uint32)
        self.at, self.k, self.count = (np.concatenate(x)[order] for x in (at, k, count))
        self.cuts = np.flatnonzero(np.diff(self.part, prepend=-1, append=parts))

    def texts(self, pick: np.ndarray) -> pa.Array:
        """The picked phrases, in their order."""
        out, order = [], []
        for length in range(1, LONGEST + 1):
            mine = np.flatnonzero(self.k[pick] == length)
            cols = [self.words.take(pa.array(self.codes[self.at[pick[mine]] + j])) for j in range(length)]
            out.append(pc.binary_join_element_wise(*cols, " ") if length > 1 else cols[0])
            order.append(mine)
        return pa.concat_arrays(out).take(pa.array(np.argsort(np.concatenate(order))))


# ------------------------------------------------------------------------ Misra-Gries
class Summary:
    """Mergeable Misra-Gries summary of at most ``capacity`` counters.

    Merging adds counters and, where there are too many, takes the first one too small to stay from each.
    That takes as much from ``capacity`` others each time, so ``taken`` is at most mass / (capacity + 1).
    """

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        k, c = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        if not len(k):
            return
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        lead = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        k, c = k[lead], np.add.reduceat(c, lead)
        if len(k) > self.capacity:
            cut = np.partition(c, len(c) - self.capacity - 1)[len(c) - self.capacity - 1]
            self.taken += int(cut)
            k, c = k[c > cut], c[c > cut] - cut
        self.keys, self.counts = k, c

    def reaching(self, threshold: int) -> np.ndarray:
        """Keys that may have reached ``threshold``; all that did are among them."""
        return self.keys[self.counts + self.taken >= threshold]


def capacity(mass: int, threshold: int) -> int:
    return mass // threshold + 1


def _by_part(least: int):
    """Rows (part, chunk, marks, counts) sorted by part -> a bit for each phrase of each chunk."""
    def answers(rows):
        held = [(chunk, unpack(m, np.uint32), unpack(c, np.uint32).astype(np.int64)) for chunk, m, c in rows]
        summary = Summary(capacity(sum(int(c.sum()) for _, _, c in held), least))
        keys, counts, size = [], [], 0
        for _, m, c in held:
            keys.append(m)
            counts.append(c)
            size += len(m)
            if size >= max(summary.capacity, 1 << 20):
                summary.merge(np.concatenate(keys), np.concatenate(counts))
                keys, counts, size = [], [], 0
        if keys:
            summary.merge(np.concatenate(keys), np.concatenate(counts))
        found = summary.reaching(least)
        exact = np.zeros(len(found), dtype=np.int64)
        if len(found):  # what chunks sent is exact: of the survivors, only those go on that reach the threshold in sum
            for _, m, c in held:
                at = np.minimum(np.searchsorted(found, m), len(found) - 1)
                hit = found[at] == m
                exact += np.bincount(at[hit], weights=c[hit], minlength=len(found)).astype(np.int64)
        found = found[exact >= least]
        for chunk, m, _ in held:
            at = np.minimum(np.searchsorted(found, m), max(0, len(found) - 1))
            yield chunk, np.packbits(found[at] == m).tobytes() if len(found) else bytes(-(-len(m) // 8))

    def send(part, rows):
        chunk, bits = zip(*answers(rows))
        return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array([part] * len(chunk), pa.int32()), pa.array(bits, pa.binary())], ["chunk", "part", "bits"])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now and rows:
                    yield send(now, rows)
                    rows = []
                now = part
                rows.append(row)
        if rows:
            yield send(now, rows)
    return run


def _sketch(parts: int):
    """Chunks -> rows (part, chunk, marks, counts)."""
    def run(batches):
        for batch in batches:
            for chunk, lang, words, codes in zip(*(c.to_pylist() for c in batch.columns)):
                p = Phrases(lang, words, codes, parts)
                rows = [(p.part[a], chunk, pack(p.mark[a:b]), pack(p.count[a:b].astype(np.uint32))) for a, b in zip(p.cuts[:-1], p.cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["part", "chunk", "marks", "counts"])
    return run


def _count(parts: int):
    """Chunks, each followed by its bits in the order of parts -> for each part, surviving phrases and exact counts."""
    def counted(lang, words, codes, bits):
        p = Phrases(lang, words, codes, parts)
        keep = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(bits, np.diff(p.cuts))])
        pick = np.flatnonzero(keep)
        at = np.searchsorted(pick, p.cuts)
        some = np.flatnonzero(np.diff(at))
        offsets = pa.array(np.append(at[some], len(pick)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(p.part[p.cuts[some]]), pa.array([lang] * len(some), pa.string()), pa.ListArray.from_arrays(offsets, p.texts(pick)),
                                           pa.ListArray.from_arrays(offsets, pa.array(p.count[pick]))], ["part", "lang", "phrases", "counts"])

    def run(batches):
        now, bits = None, []
        for batch in batches:
            for part, b, *body in zip(*(batch.column(c).to_pylist() for c in ("part", "bits", "lang", "words", "codes"))):
                if part >= 0:
                    bits.append(b)
                    continue
                if now:
                    yield counted(*now, bits)
                now, bits = body, []
        if now:
            yield counted(*now, bits)
    return run


def _total(least: int):
    """Rows (part, lang, phrases, counts) sorted by part and language -> sums that reach ``least``."""
    def summed(lang, held):
        t = pa.table({"phrase": pa.concat_arrays([p for p, _ in held]), "f": pa.concat_arrays([c for _, c in held])})
        t = t.group_by("phrase").aggregate([("f", "sum")]).rename_columns(["phrase", "f"])
        t = t.filter(pc.greater_equal(t["f"], least)).combine_chunks()
        k = pc.add(pc.count_substring(t["phrase"], " "), 1)
        return pa.table({"lang": pa.array([lang] * len(t), pa.string()), "k": k.cast(pa.int32()), "phrase": t["phrase"], "f": t["f"]}).to_batches()

    def run(batches):
        now, held = None, []
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for i, key in enumerate(keys):
                if key != now and held:
                    yield from summed(now[1], held)
                    held = []
                now = key
                held.append((batch.column(2)[i].values, batch.column(3)[i].values))
        if held:
            yield from summed(now[1], held)
    return run


def phrase_counts(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f), all phrases of up to LONGEST words with f >= ``least``, and (lang, n)."""
    spark = docs.sparkSession
    packed = stage(chunks(docs), "phrase-chunks")
    total = packed.groupBy("lang").agg(F.sum("n").alias("n"))
    mass = LONGEST * (packed.agg(F.sum("n")).first()[0] or 0)
    n = parallelism(spark)
    parts = max(n, -(-mass // PART_MASS))
    marks = packed.select("chunk", "lang", "words", "codes").mapInArrow(_sketch(parts), "part int, chunk bigint, marks binary, counts binary")
    bits = marks.repartition(n, "part").sortWithinPartitions("part", "chunk").mapInArrow(_by_part(least), "chunk bigint, part int, bits binary")
    bits = stage(bits, "phrase-bits")
    both = packed.select("chunk", F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("bits"), "lang", "words", "codes") \
        .unionByName(bits.select("chunk", "part", "bits"), allowMissingColumns=True)
    found = both.repartition(n, "chunk").sortWithinPartitions("chunk", "part").mapInArrow(_count(parts), "part int, lang string, phrases array<string>, counts array<bigint>")
    exact = found.repartition(n, "part").sortWithinPartitions("part", "lang").mapInArrow(_total(least), "lang string, k int, phrase string, f bigint")
    return stage(exact, "phrase-counts"), total


# ------------------------------------------------------------------------------ scores
def _wide(c) -> Column:
    return F.col(c).cast("decimal(20,0)") if isinstance(c, str) else c.cast("decimal(20,0)")


def scored(counts: DataFrame) -> DataFrame:
    """Candidates (lang, k, phrase, a, l, r, score), by their lowest-scoring cut."""
    c = counts.where("k > 1").withColumnRenamed("f", "a").withColumn("j", F.explode(F.expr("sequence(1, k - 1)")))
    c = c.withColumns({"_first": F.expr("substring_index(phrase, ' ', j)"), "_rest": F.expr("substring_index(phrase, ' ', j - k)")})
    for side, out in (("_first", "l"), ("_rest", "r")):
        c = c.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(out)), ["lang", side])
    c = c.withColumns({"_up": _wide("a") * F.lit(2_000_000).cast("decimal(7,0)"), "_down": (_wide("l") + _wide("r")).cast("decimal(21,0)")})
    best = F.min(F.struct(F.expr("_up div _down").alias("score"), "j", "l", "r")).alias("_c")
    return c.groupBy("lang", "k", "phrase", "a").agg(best).select("lang", "k", "phrase", "a", "_c.l", "_c.r", "_c.score")


def inside_longer(counts: DataFrame) -> DataFrame:
    """(lang, phrase, most): for phrases of two words or more inside longer ones, the largest count of these."""
    w = F.split("phrase", " ")
    inner = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(_w, i, m), ' '))))")
    longer = counts.where("k > 2").withColumn("_w", w).select("lang", F.explode(inner).alias("phrase"), "f")
    return longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, top: int = 2000) -> DataFrame:
    """-> (lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of two words or more of each
    language whose count reaches ``least``, but for those that a longer phrase with ``percent`` of their count
    holds, by score, count and phrase."""
    counts, total = phrase_counts(docs, least)
    c = scored(counts).join(inside_longer(counts), ["lang", "phrase"], "left")
    c = c.where(F.col("most").isNull() | (_wide("most") * 100 < _wide("a") * percent))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    c = c.select("lang", "phrase", "a", "l", "r", "score").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return c.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))


ORACLE = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) AS ks(k)),
c AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
b AS (SELECT c.lang, c.phrase, c.k, c.f, j, string_split(c.phrase, ' ') AS s FROM c, range(1, 4) AS js(j) WHERE j < c.k),
s AS (SELECT b.lang, b.phrase, b.k, b.f AS a, x.f AS l, y.f AS r, (2000000::HUGEINT * b.f) // (x.f::HUGEINT + y.f) AS score, j
  FROM b JOIN c x ON x.lang = b.lang AND x.phrase = array_to_string(s[:j], ' ') JOIN c y ON y.lang = b.lang AND y.phrase = array_to_string(s[j + 1:], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.lang = best.lang AND d.k > best.k
  AND contains(' ' || d.phrase || ' ', ' ' || best.phrase || ' ') AND 100 * d.f::HUGEINT >= 80 * best.a::HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE C) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""
