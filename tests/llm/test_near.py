"""Near duplicates by fast similarity sketching, and linking inside cells."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_operators import SCHEMA, SF, groups, odd_rows, plain
from wardspark.llm import cells, fast_minhash, ngram_join
from wardspark.llm.common import pack

BIG = (1 << 63) - 1


def family(rng, size, words, changed, name):
    base = [f"{name}{i}" for i in range(words)]
    out = []
    for m in range(size):
        w = list(base)
        for at in rng.choice(words, changed, replace=False):
            w[at] = f"{name}v{m}x{at}"
        out.append(" ".join(w))
    return out


def rows_of():
    rng = np.random.default_rng(11)
    texts = [t for n, (size, words, changed) in enumerate([(40, 200, 2), (40, 200, 5), (40, 200, 6), (30, 30, 1), (30, 9, 1), (6, 3000, 40)]) for t in family(rng, size, words, changed, f"f{n}w")]
    texts += ["a", "A", "a b", "a  b", "b a", "one two three", "one two three four", "one two three four five six seven eight", "one two three four five six seven eight nine"]
    rows = [(100 + i, t, "en", "a", 0, "x", 1, "y", 2) for i, t in enumerate(texts)] + [(BIG, "one two three four five six seven eight", None, None, 0, "x", 1, "y", 2)]
    return rows + [r for r in odd_rows() if r[0] is not None] + [(None, "null only", "en", None, 0, "x", 1, "y", 2)] * 2


def expected(rows, k):
    sets, comp = groups(rows, k, 85)
    return sets, comp


def test_near_duplicates_equal_brute_force(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    docs = spark.createDataFrame(rows_of(), SCHEMA).repartition(3)
    known = [r for r in plain(docs) if r[1] != "null only"]
    sets, comp = groups(known, 3, 85)
    want = Counter((i, len(s), c, i == c) for (i, _), s, c in zip(known, sets, comp))
    want[None, 1, None, True] = 2
    got = fast_minhash.near_duplicates(docs).collect()
    assert Counter(tuple(r) for r in got) == want
    assert fast_minhash.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fast_minhash.near_duplicates(docs, percent=60)


def test_near_duplicates_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = plain(docs)
    sets, comp = groups(rows, 3, 85)
    got = {r.doc_id: r for r in fast_minhash.near_duplicates(docs).collect()}
    assert len(got) == len(rows) and all((got[i].n_shingles, got[i].component_id) == (len(s), c) for (i, _), s, c in zip(rows, sets, comp))


def test_sketches_fill_and_concentrate():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 60, 900):
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        s = fast_minhash.sketches([np.unique(base), np.unique(base)])
        assert (s != np.iinfo(np.uint64).max).all() and (s[0] == s[1]).all()
    for share in (0.5, 0.85, 0.95):
        agree = []
        for _ in range(60):
            x = rng.integers(0, 1 << 63, 400).astype(np.uint64)
            cut = int(400 * (1 - share) / (1 + share))
            a, b = np.unique(x[cut:]), np.unique(x[:len(x) - cut])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            s = fast_minhash.sketches([a, b])
            agree.append((s[0] == s[1]).mean() - true)
        assert abs(np.mean(agree)) < 0.02 and np.std(agree) < 1.2 * np.sqrt(share * (1 - share) / fast_minhash.BINS)
    lone = fast_minhash.sketches([base[:40], base[:3], base[5:6]])
    for i, s in enumerate([base[:40], base[:3], base[5:6]]):
        assert (fast_minhash.sketches([s])[0] == lone[i]).all()


@pytest.mark.parametrize("describe,survivors", [(fast_minhash._describe, fast_minhash._survivors),
                                                (ngram_join._describe(85, type("Often", (), {"value": np.zeros(0, np.uint64)})), ngram_join._survivors)])
def test_a_cell_below_the_threshold_sends_few_rows(describe, survivors):
    """300 texts whose pairs are all just below the threshold: no stage lists their pairs."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    sets = []
    for _ in range(300):
        s = base.copy()
        s[rng.choice(1000, 90, replace=False)] = rng.integers(0, 1 << 62, 90).astype(np.uint64)
        sets.append(np.unique(s))
    sets += [np.unique(np.append(sets[0][1:], np.uint64(5))), sets[7][2:]]
    m = len(sets)
    marks = [mark for mark, _ in describe()(sets)]

    def batch(last, kind):
        body = [[1] * m, [0] * m, [0] * m, [0] * m, list(range(m)), list(range(m))]
        names = ["cell", "x", "y", "side", "class", "comp"]
        if kind == "mark":
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (*body, [len(s) for s in sets], last)], [*names, "n", "mark"])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*body, last)], [*names, "grams"])

    sent = [b.num_rows for f in (cells._forests, cells._open) for b in f(survivors, 85)(iter([batch(marks, "mark")]))]
    links = pa.Table.from_batches(cells._compare(85)(iter([batch([pack(s) for s in sets], "sets")]))).to_pydict()
    assert sum(sent) + len(links["a"]) < 4 * m
    assert set(zip(links["a"], links["b"])) == {(0, m - 2), (7, m - 1)}


def test_blocks_of_a_large_cell(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL", 8)
    rng = np.random.default_rng(2)
    texts = family(rng, 60, 120, 3, "w") + family(rng, 30, 120, 4, "z")
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for k, run in ((3, fast_minhash.near_duplicates), (4, ngram_join.link_documents)):
        _, comp = groups(rows, k, 85)
        assert {r.doc_id: r.component_id for r in run(docs).collect()} == {i: c for (i, _), c in zip(rows, comp)}
