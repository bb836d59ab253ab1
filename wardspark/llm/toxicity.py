"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Features are words (runs of letters and digits, A-Z folded) and their first four and five bytes. The
vectoriser keeps the features that are over-represented in the toxic examples (``min_z`` standard
deviations above the base rate, in ``min_df`` examples or more, ``min_share`` of them toxic), at most ``max_features`` of them, and
weighs them by (1 + log tf) x idf, length 1. Examples with the same vector are one entry of the index
with its number of examples and of toxic ones. Postings lie in blocks of ``BLOCK`` entries with the
largest weight of each feature per block; a query takes blocks by descending upper bound until no bound
reaches its k-th best cosine, so the k nearest entries are exact.

The score is the share of toxic among the nearest examples, weighted by 1 / (distance + ``SOFT``) and drawn
to the base rate by one example's worth; a text without any feature gets the toxic rate of the examples
without one. Evidence are the ids of the nearest entries.

The classifier is fitted on a bounded sample of the labelled rows, about ``max_examples`` by a hash of the
id, equal texts once; scoring reads whole texts.

Cases: null and empty texts have no feature; rows without a toxic label aren't learned from; without
examples every score is 0; equal cosines go to the smaller example id; repeated rows get equal results;
extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.llm.common import mix64, range_hash, slices, stage, take_columns, word_spans, _BYTE, SLICE_BYTES
from wardspark.llm.lang_id import fold
from wardspark.llm.tiling import _PLAIN

PREFIXES = (4, 5)
BLOCK = 64
SOFT = 0.05
SCORED = "score double, evidence array<bigint>"


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) of every occurrence."""
    plain = _PLAIN[data]
    starts, ends, first = word_spans(plain, offs)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    rows, found = [], []
    for size in (0, *PREFIXES):
        pick = slice(None) if not size else np.flatnonzero(ends - starts > size)
        s, e, r = starts[pick], ends[pick], row[pick]
        e = e if not size else s + size
        i = 0
        while i < len(s):
            j = max(i + 1, int(np.searchsorted(e, s[i] + SLICE_BYTES, side="right")))
            h = range_hash(_BYTE[plain[s[i]:e[j - 1]]], s[i:j] - s[i], e[i:j] - s[i])
            found.append(mix64(h + np.uint64(size)))
            rows.append(r[i:j])
            i = j
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(found)


def _counts(batches):
    for batch in batches:
        toxic = batch.column(1).to_numpy().astype(bool)
        seen, marks = [], []
        for lo, _, data, offs in slices(batch.column(0)):
            row, h = features(data, offs)
            _, one = np.unique(mix64(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
            seen.append(h[one])
            marks.append(toxic[lo + row[one]])
        if seen:
            h, at = np.unique(np.concatenate(seen), return_inverse=True)
            n = np.bincount(at, minlength=len(h))
            pos = np.bincount(at, weights=np.concatenate(marks), minlength=len(h)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(pos)], ["f", "n", "pos"])


def vectors(data: np.ndarray, offs: np.ndarray, vocab: np.ndarray, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit TF-IDF vector of each row: feature numbers and weights."""
    n = len(offs) - 1
    none = (np.zeros(0, np.int64), np.zeros(0))
    if not len(vocab):
        return [none] * n
    row, h = features(data, offs)
    at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    hit = vocab[at] == h
    key, tf = np.unique(row[hit] * len(vocab) + at[hit], return_counts=True)
    r, f = key // len(vocab), key % len(vocab)
    w = (1 + np.log(tf)) * idf[f]
    first = np.searchsorted(r, np.arange(n + 1))
    return [(f[a:b], w[a:b] / math.sqrt((w[a:b] ** 2).sum())) if b > a else none for a, b in zip(first[:-1], first[1:])]


class Index:
    """Block-max inverted index over distinct example vectors (in order of their smallest id)."""

    def __init__(self, ids, vecs, n, pos, width: int):
        self.ids, self.n, self.pos = np.array(ids, dtype=np.int64), np.array(n, dtype=float), np.array(pos, dtype=float)
        m = len(ids)
        f = np.concatenate([v[0] for v in vecs]) if m else np.zeros(0, np.int64)
        w = np.concatenate([v[1] for v in vecs]) if m else np.zeros(0)
        e = np.repeat(np.arange(m), [len(v[0]) for v in vecs]) if m else np.zeros(0, np.int64)
        order = np.lexsort((e, f))
        self.entry, self.weight = e[order], w[order]
        self.blocks = -(-m // BLOCK)
        # postings of feature x in block b: entry[cut[x * blocks + b]:cut[x * blocks + b + 1]]
        self.cut = np.searchsorted(f[order] * max(self.blocks, 1) + self.entry // BLOCK, np.arange(width * max(self.blocks, 1) + 1))
        self.most = np.zeros((width, max(self.blocks, 1)), dtype=np.float32)
        np.maximum.at(self.most, (f[order], self.entry // BLOCK), np.nextafter(self.weight.astype(np.float32), np.float32(2)))

    def nearest(self, f: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k entries of highest cosine, above 0, and their cosines."""
        bound = (w[:, None] * self.most[f]).sum(axis=0) + 1e-6
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 2e-6]
        best, score, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        at, step = 0, 4
        while at < len(order) and not (len(best) >= k and bound[order[at]] < least):
            blocks = order[at:at + step]
            if len(best) >= k:
                blocks = blocks[bound[blocks] >= least]
            at, step = at + step, step * 2
            cell = (f[:, None] * self.blocks + blocks).ravel()
            lo, n = self.cut[cell], self.cut[cell + 1] - self.cut[cell]
            where = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            got = np.bincount(self.entry[where], weights=np.repeat(np.repeat(w, len(blocks)), n) * self.weight[where], minlength=len(self.ids))
            new = np.flatnonzero(got > 0)
            best, score = np.append(best, new), np.append(score, np.round(got[new], 9))
            top = np.lexsort((self.ids[best], -score))[:k]
            best, score = best[top], score[top]
            least = score[-1] if len(score) else 0.0
        return best, score


class Model:
    """What ``fit`` gives, with its index."""

    def __init__(self, vocab, idf, examples, base: float, blank: float, k: int):
        self.vocab, self.idf, self.base, self.blank, self.k = vocab, idf, base, blank, k
        self.index = Index(*examples, len(vocab))

    def score(self, f, w) -> tuple[float, list[int]]:
        if not len(f) or not len(self.index.ids):
            return self.blank, []
        best, cosine = self.index.nearest(f, w, self.k)
        if not len(best):
            return self.blank, []
        vote = 1 / (1 - np.minimum(cosine, 1) + SOFT)
        n, pos = (vote * self.index.n[best]).sum(), (vote * self.index.pos[best]).sum()
        one = 1 / (1 + SOFT)
        return float((pos + one * self.base) / (n + one)), self.index.ids[best[:3]].tolist()


def examples(docs: DataFrame, labels: DataFrame, max_examples: int = 40_000) -> DataFrame:
    """(doc_id, text, toxic) of a bounded sample of the labelled rows outside the held-out fold."""
    lab = take_columns(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    share = int(min(1.0, max_examples / max(1, lab.count())) * (1 << 20))
    pick = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxic")), F.lit(1 << 20)) < share
    lab = lab.where(pick).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = take_columns(docs, "doc_id", "text").withColumn("_t", F.xxhash64("text"))
    # the picked labels are bounded by max_examples, so both joins run where the texts lie; one text an id, one
    # id a text, and only the texts that were chosen are shuffled, once
    light = d.select("doc_id", "_t").join(F.broadcast(lab), "doc_id").groupBy("doc_id").agg(F.min("_t").alias("_t"), F.max("toxic").alias("toxic"))
    chosen = light.groupBy("_t").agg(F.min(F.struct("doc_id", "toxic")).alias("_r")).select("_t", "_r.doc_id", "_r.toxic")
    return d.join(F.broadcast(chosen), ["doc_id", "_t"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = 40_000, max_features: int = 4096, min_df: int = 5, min_z: float = 6.0, min_share: float = 0.5, k: int = 10):
    """The model as plain arrays; what reaches the driver is bounded by ``max_examples`` and ``max_features``."""
    ex = stage(examples(docs, labels, max_examples), "toxic-examples")
    total, toxic = ex.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("toxic").cast("double")), F.lit(0.0))).first()
    base = toxic / total if total else 0.0
    if not 0 < base < 1:
        return np.zeros(0, np.uint64), np.zeros(0), ([], [], [], []), base, base, k
    z = (F.col("pos") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    counts = ex.where(F.col("text").isNotNull()).select("text", "toxic").mapInArrow(_counts, "f bigint, n bigint, pos bigint") \
        .groupBy("f").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).where((F.col("n") >= min_df) & (z >= min_z) & (F.col("pos") >= min_share * F.col("n")))
    kept = counts.orderBy(F.desc(z), "f").limit(max_features).toPandas()
    vocab = kept["f"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(vocab)
    vocab, idf = vocab[order], (np.log((total + 1) / (kept["n"].to_numpy() + 1)) + 1)[order]

    def project(batches):
        for batch in batches:
            out = [v for _, _, data, offs in slices(batch.column(1)) for v in vectors(data, offs, vocab, idf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array([v[0] for v in out], pa.list_(pa.int64())),
                                              pa.array([v[1] for v in out], pa.list_(pa.float64()))], ["doc_id", "toxic", "f", "w"])

    proj = ex.mapInArrow(project, "doc_id bigint, toxic int, f array<bigint>, w array<double>")
    entries = proj.withColumn("_w", F.transform("w", lambda x: F.round(x, 9))).groupBy("f", "_w").agg(
        F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("pos")).orderBy("id").collect()
    blank = next(((r.pos + base) / (r.n + 1) for r in entries if not r.f), base)
    used = [r for r in entries if r.f]
    packed = ([r.id for r in used], [(np.array(r.f, np.int64), np.array(r["_w"])) for r in used], [r.n for r in used], [r.pos for r in used])
    return vocab, idf, packed, base, blank, k


def score(docs: DataFrame, model, text: Column) -> Column:
    """Struct column (score, evidence)."""
    sent = docs.sparkSession.sparkContext.broadcast({"fitted": model})  # a worker keeps the model that it builds beside it

    @F.arrow_udf(SCORED)
    def rate(col: pa.Array) -> pa.Array:
        held = sent.value
        m = held.get("model") or held.setdefault("model", Model(*held["fitted"]))
        out = [m.score(*v) for _, _, data, offs in slices(col) for v in vectors(data, offs, m.vocab, m.idf)]
        return pa.StructArray.from_arrays([pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], pa.list_(pa.int64()))], ["score", "evidence"])

    return rate(text)


def score_documents(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """-> (doc_id, held_out, score, predicted, evidence)."""
    d = take_columns(docs, "doc_id", "text")
    s = d.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), score(d, fit(docs, labels, **kw), F.col("text")).alias("_s"))
    return s.select("doc_id", "held_out", "_s.score", (F.col("_s.score") >= 0.5).cast("int").alias("predicted"), "_s.evidence")
