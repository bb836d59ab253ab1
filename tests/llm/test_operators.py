"""Every operator against a brute-force version, on ordinary rows and on odd ones."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardspark.llm import lang_id, licenses, merkle, mixing, ngram_join, ring, rlz, tiling, toxicity, urlrules
from wardspark.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, tag int, class string, shard int"
LONG = " ".join(f"w{i % 700}x{i % 13}" for i in range(30_000))
NEAR = [f"tok{i}" for i in range(200)]


def odd_rows():
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "Alpha beta gamma. " + passage + " tail one\nsecond line here!", "en", "a"), (2, "other start words " + passage, "en", "a"),
            (3, None, None, None), (4, "", "en", "b"), (5, "...\t 123", None, "b"), (6, "one two", "fr", None), (6, "one two", "fr", None),
            (None, "null id text " + passage, "en", None), (7, LONG, "de", "a"), (8, LONG, "de", "z"), (9, "a b " * 200, "es", "z"),
            (10, "été \U0001F600 naïve École", "fr", "b"), (6, "same id, other text " + passage, "en", "b")]
    rows += [(20 + i, " ".join(NEAR[:i * 3] + [f"new{i}"] + NEAR[i * 3 + 1:]), "en", "a") for i in range(12)]
    return [(i, t, lang, s, 0, "x", 1, "y", 2) for i, t, lang, s in rows]


@pytest.fixture(scope="module", params=["odd", "sf"])
def docs(request, spark):
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    if request.param == "odd":
        return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(docs):
    big = (1 << 63) - 1
    return sorted(((r.doc_id if r.doc_id is not None else big, r.text or "") for r in docs.select("doc_id", "text").collect()))


def test_rlz_equals_brute_force(docs):
    rows, first = plain(docs), {}
    words = [WORD.findall(t) for _, t in rows]
    for (i, _), w in zip(rows, words):
        for a in range(len(w) - 19):
            key = tuple(w[a:a + 20])
            first[key] = min(first.get(key, (i, a)), (i, a))
    want = Counter()
    for (i, _), w in zip(rows, words):
        keep = np.ones(len(w), dtype=bool)
        for a in range(len(w) - 19):
            if first[tuple(w[a:a + 20])] < (i, a):
                keep[a:a + 20] = False
        kept = " ".join(x for x, k in zip(w, keep) if k)
        want[(i if i < (1 << 63) - 1 else None, len(w), int((~keep).sum()), hashlib.sha256(kept.encode()).hexdigest())] += 1
    got = rlz.dedup_substrings(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    for r in got:
        assert sum(f["n"] for f in r.factors) == r.n_removed


def shingles(text, k):
    w = WORD.findall(text.translate(LOWER))
    return frozenset(tuple(w[a:a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups(rows, k, percent, by_row=False):
    """Shingle sets, and the smallest doc_id of each row's group (``by_row``: the first row's index; equal rows
    without a word are one)."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if sets[a] and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    if by_row:
        return sets, [root(a) if sets[a] else rows.index(rows[a]) for a in range(len(rows))]
    return sets, [rows[root(a)][0] for a in range(len(rows))]


def test_ngram_join_equals_brute_force(docs):
    rows = plain(docs)
    sets, comp = groups(rows, 4, 85)
    big = (1 << 63) - 1
    want = Counter((i if i < big else None, len(s), c if c < big else None) for (i, _), s, c in zip(rows, sets, comp))
    got = ngram_join.link_documents(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_tree_join_is_complete():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 1 << 40, rng.integers(100, 900)) for _ in range(20)]
    sets = [np.unique(np.where(rng.random(len(b)) < rng.choice([0, .03, .1]), rng.integers(0, 1 << 40, len(b)), b)).astype(np.uint64) for b in base for _ in range(6)]
    points, sizes = [ngram_join.point(s) for s in sets], np.array([len(s) for s in sets])
    i, j, _ = ngram_join.join_by_groups(points, sizes, np.zeros(len(sets), int), True, 85)
    found = set(zip(i.tolist(), j.tolist()))
    for a in range(len(sets)):
        for b in range(a):
            same = len(np.intersect1d(sets[a], sets[b]))
            if 100 * same >= 85 * (len(sets[a]) + len(sets[b]) - same):
                assert (a, b) in found and (b, a) in found


def test_merkle_rows(docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (-(r[0] if r[0] is not None else -(1 << 62)), r[1]))
    want = Counter()
    for a, (i, t) in enumerate(rows):
        new = merkle.edited(t, rows[(a + 1) % len(rows)][1])
        want[(i, len(t), hashlib.sha256(new.encode()).hexdigest(), merkle.fingerprint(t), merkle.fingerprint(new))] += 1
    got = merkle.fingerprint_pairs(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == want
    for r in got:
        assert r.near_edited == merkle.likeness(r.fingerprint, r.edited_fingerprint)


def test_merkle_likeness_and_edits():
    a = "One sentence. Two sentences.\nThird line is here. Fourth.\nLast."
    b = a.replace("Third line", "Changed line")
    assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(a)) == 1
    assert 0.5 < merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) < 1
    assert merkle.edits(merkle.fingerprint(a), merkle.fingerprint(b)) == [(28, 48)]
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("x")) == 0


def test_mix_against_running_sums(docs):
    got = mixing.mix_documents(docs).collect()
    sizes = Counter()
    for r in got:
        sizes[r.source] += r["size"]
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share >= 3 * sizes[s]}
        if not over:
            target |= {s: weight[s] * share for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        rest -= sum(target[s] for s in over)
        open_ -= over
    for s in names:
        mine = [r for r in got if r.source == s]
        assert mine[0].target == pytest.approx(target[s]) and mine[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in mine) - target[s]) <= 1 + 1e-6 * target[s]
        assert all(r.taken <= 3 * r["size"] for r in mine)
    assert Counter(map(tuple, mixing.mix_documents(docs).collect())) == Counter(map(tuple, got))
    assert len(got) == docs.count()


def test_ring_equals_sequential_insertion(docs):
    n, v = 24, 16
    got = ring.shard_documents(docs, n, v).collect()
    points = ring.ring(n, v)
    ends = [p for p, _ in points]
    keys = []
    for r in got:
        d = hashlib.md5(("null" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()
        p = int(d[:8], 16)
        keys.append((int(np.searchsorted(ends, p)) % len(ends), p, d, r.doc_id, r["size"], r.text_crc32, r.shard))
    keys.sort(key=lambda k: (k[0], k[1], k[2], k[4], k[5]))
    room, want, late = ring.quotas(len(keys), n), Counter(), []
    for k in keys:
        s = points[k[0]][1]
        if room[s]:
            room[s] -= 1
            want[k[3:6] + (s,)] += 1
        else:
            late.append(k)
    for k in late:
        at = k[0]
        while not room[points[at][1]]:
            at = (at + 1) % len(points)
        room[points[at][1]] -= 1
        want[k[3:6] + (points[at][1],)] += 1
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard) for r in got) == want
    for s in range(n):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    for r, t in zip(sorted(got, key=lambda r: r.text_crc32), sorted(zlib.crc32(t.encode()) for _, t in plain(docs))):
        assert r.text_crc32 == t


def test_language(docs, spark):
    got = lang_id.identify_documents(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    for r in got:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    sure = [r for r in got if len(r.text or "") > 200 and r.doc_id < 7 or len(got) > 100]
    assert sum(r.lang_pred == r.lang for r in sure) >= 0.97 * len([r for r in sure if r.lang]) - 2


def test_bloom_filter_never_loses_a_member(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 20)]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    names, score, support = model.predict(["the dog and the cat", "le chien et le chat", "?!"])
    assert names == ["en", "fr", "und"] and support[0] > 0.9 and score[2] == 0


def test_tiling_catches_reordered_passages(spark, docs):
    item = " ".join(f"Item{i}," for i in range(40))
    w = item.split()
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "two words"), (1, item)], "item_id bigint, text string")
    extra = spark.createDataFrame([(900, "before " + " ".join(w[20:] + ["mid"] + w[:20]).upper() + " after"), (901, " ".join(w[:12])), (902, "only Two, WORDS here")], "doc_id bigint, text string")
    d = docs.select("doc_id", "text").unionByName(extra)
    got = tiling.contaminated_pairs(d, bench).collect()
    assert Counter((r.doc_id, r.item_id, r.covered) for r in got) == Counter({(900, 1, 40): 2, (902, 4, 2): 1})
    assert tiling.clean_documents(d, bench).count() == d.count() - 2
    assert tiling.clean_documents(d, bench.limit(0)).count() == d.count()


def test_tiles_are_longest_first_and_disjoint():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 4, 30).astype(np.uint64), rng.integers(0, 4, 60).astype(np.uint64)
        got = tiling.tile(a, b, 3)
        fa, fb, want = np.ones(30, bool), np.ones(60, bool), []
        while True:
            best = (0, 0, 0)
            for i in range(30):
                for j in range(60):
                    n = 0
                    while i + n < 30 and j + n < 60 and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                        n += 1
                    if n > best[0]:
                        best = (n, i, j)
            if best[0] < 3:
                break
            n, i, j = best
            fa[i:i + n] = fb[j:j + n] = False
            want.append(n)
        assert [n for _, _, n in got] == want


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(2)
    vecs = []
    for _ in range(500):
        f = np.sort(rng.choice(60, rng.integers(1, 6), replace=False))
        w = rng.random(len(f))
        vecs.append((f, w / np.sqrt((w ** 2).sum())))
    index = toxicity.Index(range(500), vecs, [1] * 500, [0] * 500, 60)
    dense = np.zeros((500, 60))
    for i, (f, w) in enumerate(vecs):
        dense[i, f] = w
    for f, w in vecs[:80]:
        cosine = np.round(dense[:, f] @ w, 9)
        want = sorted(np.flatnonzero(cosine > 0), key=lambda i: (-cosine[i], i))[:10]
        assert np.allclose(cosine[index.nearest(f, w, 10)[0]], cosine[want])


def test_toxicity_learns_the_marking_words(spark):
    rows = [(i, f"plain words number{i} " + ("vile" if i % 4 == 0 else "kind")) for i in range(400)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(1000, None), (None, 1)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(got) == 402 and all(got[i].predicted == int(i % 4 == 0) for i in range(400))
    assert got[1000].score == got[1001].score < 0.5
    assert {r.score for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0.0}


def test_license_rules(spark):
    text = "Some intro.\nLicensed under the Apache License, Version 2.0.\nmore.\nReleased under the MIT License.\n"
    rows = [(1, text), (2, None), (3, ""), (4, "This is not licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: ("2,1", "Apache-2.0,MIT"), 2: ("", ""), 3: ("", ""), 4: ("", "")}


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_NAME = "3. Neither the name of {} nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
GPL = """This {} is free software{} you can redistribute it and/or modify
it under the terms of the GNU {}General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
ISC = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.\n"
NOTICES = [
    ("MIT", MIT), ("BSD-2-Clause", BSD), ("BSD-3-Clause", BSD + BSD_NAME.format("the copyright holder")), ("BSD-3-Clause", BSD + BSD_NAME.format("Example Inc.")),
    ("BSD-3-Clause", BSD + BSD_NAME.format("the University of Somewhere")), ("GPL-3.0-or-later", GPL.format("program", ":", "", ",", 3)),
    ("GPL-2.0-or-later", GPL.format("program", ";", "", ";", 2)), ("LGPL-2.1-or-later", GPL.format("library", ";", "Lesser ", ";", "2.1")),
    ("AGPL-3.0-or-later", GPL.format("program", ":", "Affero ", ",", 3)), ("Apache-2.0", APACHE), ("ISC", ISC), ("MPL-2.0", MPL),
]


def test_licenses_in_wrapped_commented_and_one_line_notices(spark):
    ways = [lambda t: t, lambda t: "Intro without an end\n" + t, lambda t: t.replace("\n", "\r\n"), lambda t: "code;\n" + "".join(f"# {x}".rstrip() + "\n" for x in t.split("\n")),
            lambda t: "/*\n" + "".join(f" * {x}".rstrip() + "\n" for x in t.split("\n")) + " */\nint x;", lambda t: "\n\n".join(" ".join(x.split()) for x in t.split("\n\n"))]
    rows = [(i * 100 + j, f(t)) for i, (_, t) in enumerate(NOTICES) for j, f in enumerate(ways)]
    rows += [(9000 + i, " ".join(t.split())) for i, (name, t) in enumerate(NOTICES) if name != "MIT" and "Redist" not in t]
    rows += [(9900, "// SPDX-License-Identifier: GPL-2.0-only\n"), (9901, "This is not licensed under\n\nthe MIT License, I think. " + GPL[:90]), (9902, "\n" * 50_000 + "Released under the MIT License.")]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = {i: NOTICES[i // 100 if i < 9000 else i - 9000][0] for i, _ in rows if i < 9900} | {9900: "GPL-2.0-only", 9901: "", 9902: "MIT"}
    assert got == want


def test_url_rules(spark):
    rows = [(1, "HTTP://A.Example.NET/en/1?x"), (2, "https://b.net/"), (3, "http://x.example.com/de/"), (4, "http://u.org/fr/2"), (5, None), (6, "nohost"),
            (7, "http://bnet/"), (8, "http://example.net"), (9, "http://x.example.com/en/bad-page"), (9, "http://x.example.com/en/bad-page")]
    rows += [(100 + i, f"http://h{i}.example.com/en/{'bad' if i % 2 else 'good'}/{i}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(100 + i, 1 - i % 2, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(pages, labels).collect()}
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[2][2:] == ("net/", "block")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7][2] is None and got[8] == ("example.net", "", None, got[8][3])
    assert got[9][2:] == (None, "block") and got[100][3] == "allow" and got[101][3] == "block"


def test_url_rules_of_less_than_full_confidence_are_all_kept(spark):
    sure = "/".join("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda".split())
    rows = [(i, f"http://w{i}.example.com/{sure}/{i}") for i in range(200)] + [(1000 + i, f"http://v{i}.shop.test/spam/{i}") for i in range(20)]
    pages = spark.createDataFrame(rows + [(9, "http://new.shop.test/spam/x")], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(1000 + i, int(i >= 19), 0) for i in range(20)], "doc_id bigint, quality int, toxic int")
    got = urlrules.judge(pages, labels, min_support=0.05).collect()
    assert len(got) == 221 and {r.verdict for r in got if "/spam/" in r.path} == {"block"} and {r.verdict for r in got if "/alpha/" in r.path} == {"allow"}


def test_url_rules_without_superfluous_ones(spark):
    rng = np.random.default_rng(3)
    rows = [([x for x in "abcdef" if rng.random() < 0.6], "block" if rng.random() < 0.7 else "allow") for _ in range(60)]
    rows = [([f"p:{x}" for x in t], v) for t, v in rows]
    got = urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.03, 0.6).collect()
    subsets = [frozenset(f"p:{x}" for i, x in enumerate("abcdef") if m >> i & 1) for m in range(1, 64)]
    n, both = Counter(), Counter()
    for t, v in rows:
        for s in subsets:
            n[s] += s <= set(t)
            both[s, v] += s <= set(t)
    rules = {(s, v): c / n[s] for (s, v), c in both.items() if c >= 0.03 * 60 and c / n[s] >= 0.6}
    want = {k for k, c in rules.items() if not any(v == k[1] and s < k[0] and d >= c for (s, v), d in rules.items())}
    assert len(got) == len(want) and {(frozenset(r.tokens), r.verdict) for r in got} == want and len(want) < len(rules)
    assert all(r.key in r.tokens and n[frozenset([r.key])] == min(n[frozenset([x])] for x in r.tokens) for r in got)


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert rlz.dedup_substrings(none).count() == 0
    assert ngram_join.link_documents(none).count() == 0
    assert merkle.fingerprint_pairs(none).count() == 0
    assert mixing.mix_documents(none).count() == 0
    assert ring.shard_documents(none).count() == 0
    assert lang_id.identify_documents(none).count() == 0
    assert toxicity.score_documents(none, labels).count() == 0
    assert licenses.scan(none).count() == 0
    assert urlrules.judge(spark.createDataFrame([], "page_id bigint, url string"), labels).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 11))
    assert set(ORACLE) <= set(QUERIES)


def test_merkle_next_of_large_ids(spark):
    rows = [((1 << 53) + i, f"text number {i} of several. And more.") for i in range(12)] + [(-(1 << 63), "least"), (None, "none"), ((1 << 63) - 1, "greatest")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [(None, "none")]
    want = {i: hashlib.sha256(merkle.edited(t, order[(a + 1) % len(order)][1]).encode()).hexdigest() for a, (i, t) in enumerate(order)}
    assert {r.doc_id: r.edited_sha256 for r in merkle.fingerprint_pairs(docs).collect()} == want


def test_rlz_of_many_equal_rows(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    text = " ".join(f"w{i % 50}" for i in range(400))
    for ids in ([5] * 2000, [None] * 2000):
        docs = spark.createDataFrame([(i, text) for i in ids] + [(9, "x " + text)], "doc_id bigint, text string").repartition(4)
        got = Counter((r.doc_id, r.n_words, r.n_removed) for r in rlz.dedup_substrings(docs).select("doc_id", "n_words", "n_removed").collect())
        assert sum(got.values()) == 2001 and got[(ids[0], 400, 350 if ids[0] else 400)] == 2000


def test_tiles_of_repeated_words_are_found_along_diagonals(monkeypatch):
    rng = np.random.default_rng(6)
    for _ in range(60):
        a, b = rng.integers(0, 3, rng.integers(3, 30)).astype(np.uint64), rng.integers(0, 3, rng.integers(3, 60)).astype(np.uint64)
        listed = tiling.tile(a, b, 3)
        monkeypatch.setattr(tiling, "PAIRS_HELD", -1)
        assert tiling.tile(a, b, 3) == listed
        monkeypatch.undo()
    same = np.zeros(1_000_000, dtype=np.uint64)
    assert tiling.tile(same[:200], same, 4) == [(0, 0, 200)]


def test_tiling_of_items_without_an_id(spark):
    item = " ".join(f"item{i}" for i in range(30))
    bench = spark.createDataFrame([(None, item), (-1, item)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "before " + item, 3, "x"), (2, None, 3, "x")], "doc_id bigint, text string, item_id int, tiles string")
    assert {(r.doc_id, r.item_id) for r in tiling.contaminated_pairs(docs, bench).collect()} == {(1, None), (1, -1)}
    none = docs.limit(0)
    assert tiling.contaminated_pairs(none, bench).count() == 0 and tiling.clean_documents(none, bench).columns == docs.columns


def test_license_scan_of_long_runs(spark):
    rows = [(1, "." * 1_000_000 + "x"), (2, "\n" * 1_000_000 + "x"), (3, " \n" * 500_000 + "x"), (4, "a. " * 300_000 + "\nReleased under the MIT License.\n"), (5, "!?" * 400_000)]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: "", 2: "", 3: "", 4: "MIT", 5: ""}


def test_toxicity_of_repeated_rows_and_clashing_columns(spark):
    rows = [(i, f"plain words number{i} " + ("vile" if i % 4 == 0 else "kind"), 1, "x", 2) for i in range(400)] * 2 + [(7, "another text of that id", 1, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int, _t string, f int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x") for i in range(400)] * 2, "doc_id bigint, toxic int, text string")
    ex = toxicity.examples(docs, labels).collect()
    assert len(ex) == len({r.doc_id for r in ex}) == len({r.text for r in ex})
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == 801 and all(r.predicted == int(r.doc_id % 4 == 0) for r in got if r.doc_id != 7)


def test_url_tokens_of_the_same_rows_are_mined_once(spark):
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(80):
        t = [x for x in "abcd" if rng.random() < 0.6]
        t += [x + "2" for x in t if x in "ab"] + [f"common{i}" for i in range(40)]   # b2 as b; forty tokens in every row
        rows.append(([f"p:{x}" for x in t], "block" if rng.random() < 0.75 else "allow"))
    got = urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.03, 0.6).collect()
    plain = [([x for x in t if not x.startswith("p:common") or x == "p:common0"], v) for t, v in rows]
    names = sorted({x for t, _ in plain for x in t})
    subsets = [frozenset(x for i, x in enumerate(names) if m >> i & 1) for m in range(1, 1 << len(names))]
    n, both = Counter(), Counter()
    for t, v in plain:
        for s in subsets:
            n[s] += s <= set(t)
            both[s, v] += s <= set(t)
    rules = {(s, v): c / n[s] for (s, v), c in both.items() if c >= 0.03 * 80 and c / n[s] >= 0.6}
    least = {k for k, c in rules.items() if not any(v == k[1] and s < k[0] and d >= c for (s, v), d in rules.items())}
    want = {(frozenset(x if x != "p:common0" else f"p:common{i}" for x in s), v) for s, v in least for i in range(40 if "p:common0" in s else 1)}
    assert {(frozenset(r.tokens), r.verdict) for r in got} == want and len(got) == len(want)


def test_url_verdicts_equal_brute_force(spark):
    pages, labels = spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = urlrules.judge(pages.withColumn("tokens", F.lit(1)).withColumn("verdict", F.lit("x")), labels).collect()
    p = urlrules.with_parts(pages).withColumn("e", urlrules.explicit_rule(urlrules.EXPLICIT)).withColumn("tokens", urlrules.tokens())
    bad = {r.doc_id: r.quality == 0 or r.toxic == 1 for r in labels.collect()}
    rows = p.collect()
    label = {r.page_id: r.e.verdict if r.e else {True: "block", False: "allow", None: None}[bad.get(r.page_id)] for r in rows}
    train = [(r.tokens, label[r.page_id]) for r in rows if label[r.page_id]]
    rules = urlrules.mine(spark.createDataFrame(train, "tokens array<string>, verdict string")).collect()
    want = Counter()
    for r in rows:
        fire = [(x.confidence, x.verdict == "block", x.verdict) for x in rules if set(x.tokens) <= set(r.tokens)]
        mined = max(fire)[2] if fire else None
        want[r.page_id, r.e.rule if r.e else None, r.e.verdict if r.e else mined or "allow", mined] += 1
    assert Counter((r.page_id, r.rule, r.verdict, r.mined) for r in got) == want and len(rules) > 3


def letter_grams(text):
    s = [c if c.isalpha() else None for c in " " + (text or "").lower() + "    "]
    return [tuple(s[i:i + n]) for n in (3, 4) for i in range(len(s) - 4) if all(s[i + 1:i + n - 1])]


def test_language_filters_equal_plain_sets(spark):
    """Counts, membership and votes with plain sets of n-grams in place of the bit-sliced filter."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(10_000 + i, t, lang) for i, (t, lang) in enumerate([(None, "en"), ("", None), ("12 .,", "fr"), ("ab", "en"), ("été été", None)])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = [(t, lang) for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 4 != 2]
    seen = {}
    for t, lang in learned:
        seen.setdefault(lang, Counter()).update(letter_grams(t))
    total = {x: sum(c.values()) for x, c in seen.items()}
    most = Counter()
    for x, c in seen.items():
        for g, n in c.items():
            most[g] = max(most[g], n / total[x])
    member = {x: {g for g, n in c.items() if n >= max(2, 1e-5 * total[x]) and n / total[x] >= 0.1 * most[g]} for x, c in seen.items()}
    got = {r.doc_id: r for r in lang_id.identify_documents(docs, max_rows=10 ** 9).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        grams = letter_grams(t)
        share = {x: sum(g in m for g in grams) / max(1, len(grams)) for x, m in member.items()}
        best = sorted(share.values())
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not any(c.isalpha() for c in t or ""):
            assert (r.lang_pred, r.score, r.support) == ("und", 0, 0)
            continue
        assert abs(r.support - best[-1]) < 0.01 and abs(r.score - best[-1] / max(sum(best), 1e-12)) < 0.02
        if best[-1] - best[-2] > 0.02:
            assert r.lang_pred == max(share, key=share.get)


def toxic_features(text):
    plain = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in (text or "").encode()).decode("utf-8", "ignore").translate(LOWER)
    words = [w.encode() for w in re.split(r"[\x20\x09-\x0D]+", plain) if w]
    return Counter([(0, w) for w in words] + [(k, w[:k]) for w in words for k in (4, 5) if len(w) > k])


def test_toxicity_equals_plain_nearest_examples(spark):
    """Features, selection, weights, neighbours and votes in plain numpy."""
    rng = np.random.default_rng(12)
    bad, good, both = ["vilest", "nasty", "rotten"], ["kindly", "gentle", "calm"], [f"word{i}" for i in range(30)]
    rows = []
    for i in range(500):
        toxic = int(rng.random() < 0.3)
        words = list(rng.choice(both, 8)) + [w for w in (bad if toxic else good) if rng.random() < 0.6] + [w for w in bad if rng.random() < 0.02]
        rows.append((i, " ".join(words), toxic))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").drop("toxic"), spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id bigint, toxic int")
    texts = {}
    for i, t, x in rows:
        if zlib.crc32(str(i).encode()) % 5:
            texts.setdefault(t, (i, x))
    ex = [(i, toxic_features(t), x) for t, (i, x) in texts.items()]
    base = sum(x for _, _, x in ex) / len(ex)
    n, pos = Counter(), Counter()
    for _, f, x in ex:
        n.update(f.keys())
        pos.update({w: x for w in f})
    keep = {w for w, c in n.items() if c >= 5 and (pos[w] - c * base) / (c * base * (1 - base)) ** 0.5 >= 6 and pos[w] >= 0.5 * c}
    assert keep

    def vector(f):
        v = {w: (1 + np.log(c)) * (np.log((len(ex) + 1) / (n[w] + 1)) + 1) for w, c in f.items() if w in keep}
        size = sum(x * x for x in v.values()) ** 0.5
        return {w: x / size for w, x in v.items()}

    entries = {}
    for i, f, x in sorted(ex, key=lambda e: e[0]):
        v = vector(f)
        key = tuple(sorted((w, round(x, 9)) for w, x in v.items()))
        e = entries.setdefault(key, [i, dict(key), 0, 0])
        e[2], e[3] = e[2] + 1, e[3] + x
    blank = entries.pop((), [0, {}, 0, 0])
    found = 0
    for r in toxicity.score_documents(docs, labels).collect():
        v = vector(toxic_features(rows[r.doc_id][1]))
        near = sorted(((-round(sum(x * e[1].get(w, 0) for w, x in v.items()), 9), e[0], e) for e in entries.values()), key=lambda x: x[:2])
        near = [x for x in near if x[0] < 0][:10]
        if not near:
            assert r.score == pytest.approx((blank[3] + base) / (blank[2] + 1)) and not r.evidence
            continue
        vote = [1 / (1 - min(-c, 1) + 0.05) for c, _, _ in near]
        up, down = sum(a * e[3] for a, (_, _, e) in zip(vote, near)), sum(a * e[2] for a, (_, _, e) in zip(vote, near))
        assert r.score == pytest.approx((up + base / 1.05) / (down + 1 / 1.05), abs=1e-6) and r.evidence == [i for _, i, _ in near[:3]]
        found += 1
    assert found > 50
