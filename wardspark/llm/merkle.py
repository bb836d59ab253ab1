"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

A paragraph is a line; a section is a run of paragraphs that ends at a blank line or where a
paragraph's own hash says so (one in eight), so an edit leaves the sections around it as they were.
Leaves are the sentences of a paragraph (pieces of at most 240 code points without an end sign).
Each inner node hashes its children; the root is a SHA-256, so equal roots mean equal texts.

The fingerprint writes the tree out, root first: ``root:tree`` with sections split by ``/``,
paragraphs by ``;``, sentences by ``,``; a node is its length and hash, e.g. ``57x1f0c22ab``.
``likeness`` walks two fingerprints from the root: equal nodes count with their length, only
differing branches are opened; it is twice the matched length over both lengths. ``edits`` gives
the code point ranges of the leaves that found no partner.

Cases: a null text is empty; two empty texts are equal (1), one empty text shares nothing (0);
repeated rows and equal ids are ordered by text; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.llm.common import NULL_ID, parallelism, take_columns

LEAF = re.compile(r"[^.!?]{1,240}[.!?]*\s?|[.!?]+\s?")
SECTION_MASK = 7
OUT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")

#: A node: (length, hash, children).
_hash = xxhash.xxh64_intdigest


def tree(text: str) -> list[tuple[int, str, list]]:
    sections, paras = [], []
    for line in text.split("\n"):
        leaves = [(len(s), f"{_hash(s) & 0xFFFFFFFFFFFF:x}") for s in LEAF.findall(line)]
        h = _hash(line)
        if leaves:
            paras.append((len(line), f"{h:x}", leaves))
        if paras and (not leaves or h & SECTION_MASK == 0):
            sections.append(paras)
            paras = []
    if paras:
        sections.append(paras)
    return [(sum(p[0] for p in s), f"{_hash(';'.join(p[1] for p in s)):x}", s) for s in sections]


def write(text: str, sections: list) -> str:
    body = "/".join(f"{n}x{h}=" + ";".join(f"{m}x{g}=" + ",".join(f"{k}x{f}" for k, f in leaves) for m, g, leaves in paras) for n, h, paras in sections)
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:32] + ":" + body


def parse(fingerprint: str) -> list:
    def node(s: str, rest):
        head, _, body = s.partition("=")
        n, h = head.split("x")
        return (int(n), h, rest(body))

    def leaf(s: str):
        n, h = s.split("x")
        return (int(n), h)

    body = fingerprint.partition(":")[2]
    return [node(s, lambda b: [node(p, lambda c: [leaf(x) for x in c.split(",")]) for p in b.split(";")]) for s in body.split("/")] if body else []


def fingerprint(text: str) -> str:
    return write(text, tree(text))


def _unmatched(a: list, b: list) -> tuple[int, list, list]:
    """Length matched between two lists of nodes, and the children of those without a partner."""
    have = Counter(x[1] for x in b)
    same, rest = 0, []
    for x in a:
        if have.get(x[1], 0):
            have[x[1]] -= 1
            same += x[0]
        else:
            rest.append(x)
    other = []
    for x in reversed(b):
        if have.get(x[1], 0):
            have[x[1]] -= 1
            other.append(x)
    return same, rest, other[::-1]


def _likeness(a: list, b: list) -> float:
    total = sum(x[0] for x in a) + sum(x[0] for x in b)
    if not total:
        return 1.0
    same, a, b = _unmatched(a, b)
    more, a, b = _unmatched([p for s in a for p in s[2]], [p for s in b for p in s[2]])
    last, _, _ = _unmatched([x for p in a for x in p[2]], [x for p in b for x in p[2]])
    return min(1.0, 2.0 * (same + more + last) / total)


def likeness(one: str, other: str) -> float:
    """0 to 1 from two fingerprints alone."""
    if one.partition(":")[0] == other.partition(":")[0]:
        return 1.0
    a, b = parse(one), parse(other)
    return _below_one(_likeness(a, b)) if a or b else 0.0


def _below_one(x: float) -> float:
    """Different roots are different texts, also where only white space differs."""
    return min(x, 1.0 - 1e-9)


def edits(one: str, other: str) -> list[tuple[int, int]]:
    """Ranges of leaf text in ``one`` (offsets over its leaves, line ends not counted) that
    ``other`` doesn't have, found by opening only branches that differ."""
    if one.partition(":")[0] == other.partition(":")[0]:
        return []
    a, b = parse(one), parse(other)
    have = [Counter(s[1] for s in b), Counter(p[1] for s in b for p in s[2]), Counter(x[1] for s in b for p in s[2] for x in p[2])]
    out, at = [], 0
    for s in a:
        if have[0][s[1]]:
            at += sum(x[0] for p in s[2] for x in p[2])
            continue
        for p in s[2]:
            if have[1][p[1]]:
                at += sum(x[0] for x in p[2])
                continue
            for n, h in p[2]:
                if not have[2][h]:
                    if out and out[-1][1] == at:
                        out[-1] = (out[-1][0], at + n)
                    else:
                        out.append((at, at + n))
                at += n
    return out


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by the first code points of the following document."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _row(doc_id, text: str, following: str):
    mine, new = tree(text), edited(text, following)
    changed, after = tree(new), tree(following)
    near_edited = 1.0 if new == text else _below_one(_likeness(mine, changed)) if mine or changed else 0.0
    near_next = 1.0 if following == text else _below_one(_likeness(mine, after)) if mine or after else 0.0
    return (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
            write(text, mine), write(new, changed), near_edited, near_next)


_NAMES = [c.split()[0] for c in OUT.split(", ")]


def _table(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _NAMES)


def _walk(batches):
    """Rows sorted by (bucket, borrowed, place): each document with the one after it; the first
    document of the next bucket is borrowed at the end. One document is held back at a time."""
    def stream():
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(4)))

    done: list = []
    size = 0
    for _, rows in groupby(stream(), key=itemgetter(0)):
        held = None
        for _, borrowed, doc_id, text in rows:
            text = text or ""
            if held is not None:
                done.append(_row(*held, text))
                size += len(text)
            held = None if borrowed else (doc_id, text)
            if borrowed:
                break
            if size > 1 << 20:
                yield _table(done)
                done, size = [], 0
        for _ in rows:
            pass
    if done:
        yield _table(done)


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Every document with the fingerprint of its text and of its edited text (see ``edited``); the
    following document is the next by descending doc_id (null ids last), after the last the first.

    Ids are cut into buckets at quantiles that are computed once, so a row's bucket is an
    expression of the row; the texts are shuffled once, and each bucket also gets the first row
    of the next one.
    """
    spark = docs.sparkSession
    # the double only chooses a bucket; order inside one, and what it lends, are by the id itself
    d = take_columns(docs, "doc_id", "text").withColumn("_k", F.coalesce(-F.col("doc_id").cast("double"), F.lit(float(NULL_ID))))
    n = max(2, 2 * parallelism(spark))
    cuts = sorted(set(d.approxQuantile("_k", [i / n for i in range(1, n)], 0.25 / n)))
    cuts = [c for c in cuts if abs(c) < NULL_ID] or [0.0]
    d = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_k", outputCol="_b").setHandleInvalid("error").transform(d) \
        .withColumn("_b", F.col("_b").cast("int"))
    first = sorted(((r[0], r[1]) for r in d.groupBy("_b").agg(F.max("doc_id")).collect()), key=lambda r: r[0])
    before = {b: first[i - 1][0] for i, (b, _) in enumerate(first)}
    edge = spark.createDataFrame([(b, k, before[b]) for b, k in first], "_fb int, _fid bigint, _prev int")
    d = d.join(F.broadcast(edge), F.col("_b") == F.col("_fb"))
    own = F.struct(F.col("_b").alias("b"), F.lit(0).alias("borrowed"))
    lent = F.struct(F.col("_prev").alias("b"), F.lit(1).alias("borrowed"))
    d = d.select("doc_id", "text", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("_fid")), F.array(own, lent)).otherwise(F.array(own))).alias("_to")) \
        .select(F.col("_to.b").alias("b"), F.col("_to.borrowed").alias("borrowed"), "doc_id", "text")
    placed = d.repartition(parallelism(spark), "b").sortWithinPartitions("b", "borrowed", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    return placed.mapInArrow(_walk, OUT)
