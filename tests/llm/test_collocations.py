"""Phrase mining against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from wardspark.llm import collocations as co

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, phrase string, chunk int, n int, part int, k string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, percent, top):
    total, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    often = {p: n for p, n in f.items() if n >= least}
    out = {}
    for (lang, p), a in often.items():
        if len(p) == 1:
            continue
        score, j = min((2000000 * a // (f[lang, p[:j]] + f[lang, p[j:]]), j) for j in range(1, len(p)))
        longer = [n for (g, q), n in often.items() if g == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
        if not any(100 * n >= percent * a for n in longer):
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:j]], f[lang, p[j:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, c in out.items() for i, (s, a, p, l, r) in enumerate(sorted(c)[:top])}


def rows_of(seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "New", "york", "é", "École", "x-1", "zz", " ", "\U0001F600"] + [f"w{i}" for i in range(12)]
    rows = []
    for _ in range(150):
        n = rng.choice([0, 1, 2, 5, 40, 90])
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", " \t", ". ", ",", "\n", "\r\n", " "]) for _ in range(n))
        rows.append((text, rng.choice(["en", "en", "en", "fr", None, "und", ""])))
    rows += [(None, "en"), ("", None), (" . , ;", "fr"), ("same text here again " * 30, "en"), ("same text here again " * 30, "en")]
    rows += [("New York city hall! " * 9, None)] * 4 + [("long run without an end " * 700, "de")]
    return rows


@pytest.mark.parametrize("seed,chunk,segment,mass,top", [(1, 600, 16, 400, 2000), (2, 1 << 20, 1 << 18, 1 << 20, 7)])
def test_collocations_equal_plain_counts(spark, monkeypatch, seed, chunk, segment, mass, top):
    for name, value in (("CHUNK_BYTES", chunk), ("SEGMENT", segment), ("PART_MASS", mass)):
        monkeypatch.setattr(co, name, value)
    rows = rows_of(seed)
    docs = spark.createDataFrame([(i, t, lang, "s", 1, "x", 1, 2, 3, "k") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    got = co.collocations(docs, least=3, percent=80, top=top).collect()
    want = brute(rows, 3, 80, top)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_frequent_key_survives_merging():
    rng = np.random.default_rng(5)
    for least in (3, 30):
        for _ in range(20):
            parts = [np.minimum(rng.zipf(1.3, rng.integers(1, 4000)), 50_000).astype(np.uint32) for _ in range(6)]
            pairs = [np.unique(p, return_counts=True) for p in parts]
            summary = co.Summary(co.capacity(sum(len(p) for p in parts), least))
            for k, n in pairs:
                summary.merge(k, n)
            true = Counter(np.concatenate(parts).tolist())
            assert summary.taken < least and len(summary.keys) <= summary.capacity
            assert {k for k, n in true.items() if n >= least} <= set(summary.reaching(least).tolist())


def test_scores_past_64_bits(spark):
    big = 9_000_000_000_000
    rows = [("en", 1, "a", big + 7), ("en", 1, "b", big * 3 + 1), ("en", 2, "a b", big)]
    r = co.scored(spark.createDataFrame(rows, "lang string, k int, phrase string, f bigint")).collect()[0]
    assert (r.l, r.r, r.score) == (big + 7, big * 3 + 1, 2000000 * big // (4 * big + 8))
