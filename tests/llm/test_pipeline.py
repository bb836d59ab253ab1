"""The pipeline's stages, each on what the one before kept."""

from collections import Counter

import numpy as np

import corpus_pipeline
from tests.llm.test_operators import SF, groups, odd_rows, plain, SCHEMA
from wardspark.llm import lang_id
from wardspark.llm.common import read, stage


def test_stages(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    docs = read(spark, SF, "documents")
    seen = {}
    for name, f in corpus_pipeline.STAGES:
        before = docs
        docs = stage(f(spark, docs, SF), name)
        seen[name] = (before, docs)
        if name != "shard":
            assert docs.columns == before.columns
    before, after = seen["language"]
    assert Counter(plain(after)) == Counter(r for r in plain(before) if any(c.isalpha() for c in r[1]))
    before, after = seen["near_duplicates"]
    rows = plain(before)
    _, comp = groups(rows, 5, 80)
    assert plain(after) == [r for r, c in zip(rows, comp) if r[0] == c]
    before, after = seen["decontaminate"]
    items = [r.text for r in read(spark, SF, "benchmark").collect()]
    assert Counter(plain(after)) == Counter(r for r in plain(before) if not any(t in r[1] for t in items))
    before, after = seen["mix"]
    assert set(plain(after)) <= set(plain(before)) and max(Counter(plain(after)).values()) <= 3
    before, after = seen["shard"]
    counts = Counter(r.shard for r in after.collect())
    assert sum(counts.values()) == before.count() and max(counts.values()) - min(counts.values()) <= 1


def test_near_duplicates_keeps_one_of_repeated_rows(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert max(got.values()) == 1
    rows = plain(docs)
    kept = {(i if i is not None else (1 << 63) - 1, t or "") for i, t in got}
    members = {}
    for r, c in zip(rows, groups(rows, 5, 80, True)[1]):
        members.setdefault(c, set()).add(r)
    for group in members.values():  # one row of each group, of its smallest id; rows without a word stand alone
        assert [i for i, _ in kept & group] == [min(i for i, _ in group)]
    assert kept <= set(rows) and (6, "one two") in kept and not any(i == 6 and "passage" in t for i, t in kept)


def test_language_stage_drops_languages_that_were_not_learned(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    rng = np.random.default_rng(4)
    odd = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
           "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
           "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek."]
    odd += [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(60)) for _ in range(20)]
    extra = spark.createDataFrame([(1_000_000 + i, t, None) for i, t in enumerate(odd)], "doc_id bigint, text string, lang string")
    got = {r.doc_id for r in lang_id.keep_identified(docs.unionByName(extra)).select("doc_id").collect()}
    want = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert got == want


def test_near_duplicates_of_rows_without_an_id(spark):
    words = [[f"{g}tok{i}" for i in range(200)] for g in "abc"]
    near = [[" ".join(w[:i * 3] + [f"new{i}"] + w[i * 3 + 1:]) for i in range(6)] for w in words]
    rows = [(None, t) for t in near[0] + near[0][:2] + near[1]] + [(None, "alone and without a near copy"), (None, ""), (None, "..."), (5, near[2][0])]
    rows += [(None, t) for t in near[2][1:]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert len(got) == 6 and len({t for _, t in got}) == 6
    assert [sum(t in n for _, t in got) for n in near] == [1, 1, 1] and (5, near[2][0]) in got


def test_stages_on_an_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA + ", _doc int, _k int, tokens int, cell int")
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, none, SF)
        assert out.count() == 0
        assert name == "shard" or out.columns == none.columns


def test_mix_of_repeated_rows_and_rows_without_an_id(spark):
    from wardspark.llm import mixing
    rows = [(None, f"w{i} " * 20, "a") for i in range(30)] + [(7, "x y z " * 10, "b")] * 40 + [(i, "one two " * 15, None) for i in range(100, 160)] + [(8, None, "b"), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    out = mixing.mixed_corpus(docs).collect()
    assert {(r.doc_id, r.text, r.source) for r in out} <= set(rows)
    taken = {s: sum(len(r.text.split()) for r in out if r.source == s) for s in ("a", "b", None)}
    target = {r.source: r.target for r in mixing.mix_documents(docs).collect()}
    for s, t in target.items():  # rows of one id share what the mix takes evenly, so a source is off by rounding those rows
        assert abs(taken[s] - t) <= 0.5 * sum(len((x or "").split()) for _, x, y in rows if y == s) + 60
    counts = Counter((r.doc_id, r.text, r.source) for r in out)
    have = Counter(rows)
    assert all(n <= 3 * have[k] for k, n in counts.items())


def test_language_stage_learns_from_every_labelled_row(spark):
    """9,000 rows of one language: the model and the least support are those of all learned rows, told by plain counts."""
    words = ["alpha beta gamma", "delta epsilon", "zeta eta theta iota"]
    rows = [(i, f"{words[i % 3]} {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}x", "aa" if i % 10 else "bb") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    labelled = docs.where(lang_id.fold(docs.doc_id, 4) != 2)
    learned = [(r.text, r.lang) for r in labelled.collect()]
    assert sum(x == "aa" for _, x in learned) > 4000
    counts = Counter()
    for lo in range(0, len(learned), 50):
        for text, lang in learned[lo:lo + 50]:
            for h, ok in lang_id._grams([text])[2]:
                counts.update((lang, int(g)) for g in h[ok])
    got = labelled.select("text", "lang").mapInArrow(lang_id._count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").sum("n").collect()
    assert {(r[0], r[1] & (1 << 64) - 1): r[2] for r in got} == counts
    assert lang_id.learned_rows(labelled, lang_id.fit.__defaults__[0]).count() == len(learned)
    seen = spark.createDataFrame([("aa", i / 7000) for i in range(5000)] + [("bb", 0.5)] * 3, "lang string, support double")
    assert dict(map(tuple, lang_id._low_supports(seen, 0.001).collect())) == {"aa": 4 / 7000, "bb": 0.5}
    model, sampled = lang_id.fit(labelled), lang_id.fit(labelled, 4000)
    assert model.table.any(axis=0).sum() != sampled.table.any(axis=0).sum()
    assert lang_id.keep_identified(docs).count() > 0
