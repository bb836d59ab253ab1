"""Language identification by language-bitmask n-gram filters.

Fitting counts the letter n-grams of labelled texts per language. An n-gram belongs to a language
if it makes up at least ``min_rate`` of that language's n-grams and at least ``min_ratio`` of its
highest rate in any language. The members fill a bit-sliced Bloom filter: each of its positions
holds one bit per language, and the AND of an n-gram's positions names at once all languages that
(seem to) contain it. A text is scored by the population count per language over all its n-grams,
corrected for the share of false positives that the fill of that language's slice lets expect.

The filter has a fixed number of positions (``bits``), so its broadcast size doesn't depend on the
input. It is fitted on all labelled rows; with ``max_rows`` on about so many of each language, taken
by a hash of the id. A task adds up its n-grams before it sends them. Prediction reads whole texts.

Cases: null texts and texts without a letter are ``und`` with score 0; a text whose n-grams no
language knows, or that is too short to have one, gets the most common learned language with score
0; rows without a language aren't learned from; without any labelled row every text is ``und``;
ties go to the first language by name; repeated rows get equal results; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.llm.common import SLICE_BYTES, mix64, take_columns
from wardspark.operators.util import running_sums

NGRAMS = (3, 4)
HASHES = 3
UND = "und"
PREDICTION = "lang_pred string, score double, support double"

_LETTER: list[np.ndarray] = []


def _is_letter(c: np.ndarray) -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(1 << 16)]))
    out = _LETTER[0][np.minimum(c, (1 << 16) - 1)]
    far = np.flatnonzero(c >= 1 << 16)
    if len(far):
        points, where = np.unique(c[far], return_inverse=True)
        out[far] = np.array([chr(int(i)).isalpha() for i in points])[where]
    return out


def _grams(texts: list[str]):
    """Code points are lower-cased and everything but letters becomes a gap. Returns the gap-padded
    letters, the first position of each text, and for each n the n-gram hashes and their validity:
    no gap but at the ends, and a letter inside."""
    parts = [t.lower() for t in texts]
    c = np.frombuffer((" " + " ".join(parts) + " \0\0\0\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts))
    first = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    letter = _is_letter(c)
    x = np.where(letter, c, 0).astype(np.uint64)
    size = len(c) - max(NGRAMS)
    found = []
    for n in NGRAMS:
        h = np.full(size, np.uint64(n))
        ok = np.ones(size, dtype=bool)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + x[j:j + size]
            if 0 < j < n - 1:
                ok &= letter[j:j + size]
        found.append((mix64(h), ok))
    return letter[:size], first, found


@dataclass
class Filter:
    """Bit-sliced Bloom filter: ``planes`` x positions, eight languages a plane."""

    langs: list[str]
    default: str
    table: np.ndarray
    fill: np.ndarray

    def masks(self, h: np.ndarray, plane: int) -> np.ndarray:
        t = self.table[plane]
        top = np.uint64(len(t) - 1)
        step = (h >> np.uint64(32)) | np.uint64(1)
        out = t[h & top]
        for j in range(1, HASHES):
            out &= t[(h + np.uint64(j) * step) & top]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        letter, first, found = _grams(texts)
        has_letter = np.add.reduceat(letter, first, dtype=np.int64) > 0
        total = sum(np.add.reduceat(ok, first, dtype=np.int64) for _, ok in found)
        hits = np.zeros((len(self.langs), len(texts)))
        for h, ok in found:
            for plane in range(len(self.table)):
                m = self.masks(h, plane)
                m[~ok] = 0
                for b in range(min(8, len(self.langs) - 8 * plane)):
                    hits[8 * plane + b] += np.add.reduceat((m >> b) & 1, first, dtype=np.int64)
        rate = hits / np.maximum(total, 1)
        false = self.fill[:, None]
        rate = np.clip((rate - false) / np.maximum(1 - false, 1e-9), 0, 1)
        best = rate.argmax(axis=0)
        top = rate[best, np.arange(len(texts))]
        score = np.where(top > 0, top / np.maximum(rate.sum(axis=0), 1e-12), 0.0)
        names = [UND if not has else self.langs[b] if t > 0 else self.default for has, b, t in zip(has_letter, best, top)]
        return names, np.where(has_letter, score, 0.0), np.where(has_letter, top, 0.0)


def _slices(texts: list[str]):
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE_BYTES:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


SENT_GRAMS = 1 << 20   # entries that a counting task holds before it adds them up, and sums before it sends them


def _count(batches):
    """(text, lang) -> (lang, gram, n), added up over a task's batches in bounded memory."""
    names: list[str] = []
    held = [np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
    parts: list[tuple] = []

    def add_up():
        gram, lang, n = (np.concatenate(x) for x in zip(held, *parts))
        parts.clear()
        order = np.lexsort((gram, lang))
        gram, lang, n = gram[order], lang[order], n[order]
        first = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (lang[1:] != lang[:-1]))[:len(gram)])
        held[:] = gram[first], lang[first], np.add.reduceat(n, first) if len(first) else n

    def send():
        gram, lang, n = held
        held[:] = [x[:0] for x in held]
        for i in range(0, len(gram), SENT_GRAMS // 8):
            j = i + SENT_GRAMS // 8
            yield pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(pa.array(lang[i:j]), pa.array(names, pa.string())).dictionary_decode(),
                                              pa.array(gram[i:j].view(np.int64)), pa.array(n[i:j])], ["lang", "gram", "n"])

    pending = 0
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        names += sorted(set(langs) - set(names))
        number = {x: i for i, x in enumerate(names)}
        for lo, hi in _slices(texts):
            _, first, found = _grams(texts[lo:hi])
            lang = np.repeat([number[x] for x in langs[lo:hi]], np.diff(np.append(first, len(found[0][0]))))
            for h, ok in found:
                for i in np.unique(lang):
                    g, n = np.unique(h[ok & (lang == i)], return_counts=True)
                    parts.append((g, np.full(len(g), i, np.int32), n))
                    pending += len(g)
            if pending >= SENT_GRAMS:
                add_up()
                pending = 0
                if len(held[0]) >= SENT_GRAMS:
                    yield from send()
    add_up()
    yield from send()


def _row_counts(labelled: DataFrame) -> list[tuple[str, int]]:
    return sorted((r[0], r[1]) for r in labelled.groupBy("lang").agg(F.count(F.lit(1))).collect())


def learned_rows(labelled: DataFrame, max_rows: int | None, counts: list[tuple[str, int]] | None = None) -> DataFrame:
    """All rows; with ``max_rows`` about so many of each language, by a hash of the id."""
    if max_rows is None:
        return labelled
    counts = _row_counts(labelled) if counts is None else counts
    if not counts:
        return labelled
    share = F.create_map(*[F.lit(v) for x, n in counts for v in (x, int(min(1.0, max_rows / n) * (1 << 20)))])
    return labelled.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("lang")), F.lit(1 << 20)) < F.element_at(share, F.col("lang")))


def fit(labelled: DataFrame, max_rows: int | None = None, min_rate: float = 1e-5, min_ratio: float = 0.1, bits: int = 20) -> Filter:
    """(doc_id, text, lang) with non-null lang -> the filter.

    What reaches the driver is bounded: the languages, and the filter's set positions.
    """
    labelled = labelled.where(F.col("lang").isNotNull())
    rows = _row_counts(labelled)
    langs = [x for x, _ in rows]
    planes, positions = (len(langs) + 7) // 8, 1 << bits
    table = np.zeros((planes, positions), dtype=np.uint8)
    if not langs:
        return Filter([], UND, table, np.zeros(0))
    counted = learned_rows(labelled, max_rows, rows).where(F.col("text").isNotNull()).select("text", "lang") \
        .mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    number = F.create_map(*[F.lit(v) for i, x in enumerate(langs) for v in (x, i)])
    per_gram = counted.groupBy("gram").agg(F.collect_list(F.struct(F.element_at(number, F.col("lang")).alias("i"), F.col("n"))).alias("in"))
    totals = {r[0]: r[1] for r in counted.groupBy("lang").agg(F.sum("n")).collect()}
    least = {i: max(2, min_rate * totals.get(x, 0)) for i, x in enumerate(langs)}

    def fill(batches):
        for batch in batches:
            grams, inside = batch.column(0).to_numpy().view(np.uint64), batch.column(1)
            which = np.repeat(np.arange(len(grams)), pc.list_value_length(inside).to_numpy(zero_copy_only=False))
            flat = inside.flatten()
            lang, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            rate = n / np.array([max(1, totals.get(x, 0)) for x in langs])[lang]
            most = np.zeros(len(grams))
            np.maximum.at(most, which, rate)
            keep = (n >= np.array([least[i] for i in range(len(langs))])[lang]) & (rate >= min_ratio * most[which])
            h, lang = grams[which[keep]], lang[keep]
            step = (h >> np.uint64(32)) | np.uint64(1)
            for j in range(HASHES):
                at = ((h + np.uint64(j) * step) & np.uint64(positions - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array((lang // 8).astype(np.int32)), pa.array((1 << (lang % 8)).astype(np.int32))], ["at", "plane", "bit"])

    cells = per_gram.mapInArrow(fill, "at bigint, plane int, bit int").groupBy("at", "plane").agg(F.bit_or("bit").alias("mask")).toPandas()
    table[cells["plane"].to_numpy(), cells["at"].to_numpy()] = cells["mask"].to_numpy()
    share_set = np.array([((table[i // 8] >> (i % 8)) & 1).mean() for i in range(len(langs))])
    return Filter(langs, max(rows, key=lambda r: (r[1], r[0]))[0], table, share_set ** HASHES)


def predict(docs: DataFrame, model: Filter, text: Column) -> Column:
    """Struct column (lang_pred, score, support); support is the corrected hit rate."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.default, model.table, model.fill))

    @F.arrow_udf(PREDICTION)
    def identify(col: pa.Array) -> pa.Array:
        texts = pc.fill_null(col, "").to_pylist()
        filters = Filter(*sent.value)
        names, scores, supports = [], [], []
        for lo, hi in _slices(texts):
            if not filters.langs:
                n, s, u = [UND] * (hi - lo), np.zeros(hi - lo), np.zeros(hi - lo)
            else:
                n, s, u = filters.predict(texts[lo:hi])
            names += n
            scores.append(s)
            supports.append(u)
        none = [np.zeros(0)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores or none)), pa.array(np.concatenate(supports or none))],
                                          ["lang_pred", "score", "support"])

    return identify(text)


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % folds


def identify_documents(docs: DataFrame, **kw) -> DataFrame:
    """-> (doc_id, held_out, lang_pred, score, support); learns from the rows outside the held-out fold."""
    d = take_columns(docs, "doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 4) == 2
    model = fit(d.where(~held), **kw)
    return d.select("doc_id", held.alias("held_out"), predict(d, model, F.col("text")).alias("_p")).select("doc_id", "held_out", "_p.*")


def _low_supports(seen: DataFrame, quantile: float) -> DataFrame:
    """(lang, support) -> (lang, its exact ``quantile``: the least support that so large a share doesn't exceed)."""
    counts = seen.groupBy("lang", "support").agg(F.count(F.lit(1)).alias("n"))
    upto = running_sums(counts, ["lang"], [F.col("support")], ["n"])
    total = upto.groupBy("lang").agg(F.sum("n").alias("_all"))
    return upto.join(total, "lang").where(F.col("cum_n") >= F.lit(quantile) * F.col("_all")).groupBy("lang").agg(F.min("support"))


def keep_identified(docs: DataFrame, min_support: float = 0.05, quantile: float = 0.001, share: float = 0.4, max_rows: int | None = None, **kw) -> DataFrame:
    """The documents in some learned language: those with a letter whose n-grams are at least
    ``min_support`` of one language's, and at least ``share`` of that language's ``quantile`` of the
    supports of the labelled rows it was learned from. All columns stay as they were."""
    d = take_columns(docs, "doc_id", "text", "lang")
    labelled = d.where(fold(F.col("doc_id"), 4) != 2)
    model = fit(labelled, max_rows, **kw)
    seen = learned_rows(labelled.where(F.col("lang").isNotNull()), max_rows).select("lang", predict(d, model, F.col("text")).alias("_p"))
    low = _low_supports(seen.where((F.col("_p.lang_pred") == F.col("lang")) & (F.col("_p.support") > 0)).select("lang", F.col("_p.support").alias("support")), quantile)
    least = [F.lit(v) for x, q in sorted(map(tuple, low.collect())) for v in (x, max(min_support, share * q))]
    need = F.coalesce(F.try_element_at(F.create_map(*least), F.col("_p.lang_pred")), F.lit(min_support)) if least else F.lit(min_support)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), predict(docs, model, F.col("`text`")).alias("_p"))
    return packed.where((F.col("_p.lang_pred") != UND) & (F.col("_p.support") >= need)).select("_doc.*")
