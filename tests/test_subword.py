"""Sub-word pieces and the frequency-split lookup of words."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from wardspark.operators import subword as S
from wardspark.operators import tokens as K


def greedy(word, pieces):
    out, at = [], 0
    while at < len(word):
        fits = [(p, i) for (p, inner), i in pieces.items() if inner == (at > 0) and word.startswith(p, at)]
        if not fits:
            return [K.UNK]
        p, i = max(fits, key=lambda x: len(x[0]))
        out.append(i)
        at += len(p)
    return out


def vocab_of(spark, words):
    return K.build_vocab(spark.createDataFrame([(w,) for w in words], "token string"))


def test_pieces_and_greedy_split(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdé\U0001F600") for _ in range(rng.randint(1, 7))) for _ in range(3000)] + ["z" * 70]
    vocab = vocab_of(spark, words)
    ids = {r.token: r.id for r in vocab.collect()}
    table = S.piece_table(vocab, 40)
    pieces = {(r.piece, r.inner): r.id for r in table.collect()}
    assert len(set(pieces.values())) == len(pieces) == table.count()
    top = {w for w, i in ids.items() if i < K.WORD_BASE + 40}
    assert {p for p, inner in pieces if not inner} == top | set("".join(words))
    unseen = spark.createDataFrame([(w,) for w in sorted(set(words)) + ["", "abxa", "xab", "aбb"]], "token string")
    got = {r.token: r.ids for r in S.split_words(unseen, table).collect()}
    assert got == {w: greedy(w, pieces) for w in got} and len(got) == len(set(words)) + 4
    assert got[""] == [] and got["xab"] == got["abxa"] == got["aбb"] == [K.UNK]
    assert all(K.UNK not in got[w] for w in words) and got["z" * 70] == [pieces["z", False]] + [pieces["z", True]] * 69


def test_lookup_in_place_and_by_shuffle_agree(spark):
    rng = random.Random(5)
    common, rare = [f"w{i}" for i in "abcdef"], ["rare" + c + d for c in "abcdefghij" for d in "klmno"]
    docs = [(i, [rng.choice(common + ["1", "7", ".", ","] + rare) for _ in range(rng.choice([0, 1, 30]))]) for i in range(200)] + [(900, None), (901, ["unknown", "1", "unknown"])]
    df = spark.createDataFrame(docs, "doc_id int, toks array<string>").repartition(3)
    vocab = K.build_vocab(df.where("doc_id < 900").select(F.explode(K.words_of(F.col("toks"))).alias("token")))
    ids = {r.token: r.id for r in vocab.collect()}
    fixed = {str(d): 121 + d for d in range(10)} | {".": 119}
    assert not set(ids) & set(fixed)
    want = {i: [fixed.get(t, ids.get(t, K.UNK)) for t in toks or []] for i, toks in docs}
    for top in (0, 3, 1 << 16):
        assert {r.doc_id: r.ids for r in K.encode_tokens(df, "doc_id", "toks", vocab, "ids", top=top).collect()} == want
    others = vocab.select("token", F.array("id", F.lit(7)).alias("ids"))
    got = {r.doc_id: r.ids for r in K.encode_tokens(df, "doc_id", "toks", vocab, "ids", top=3, others=others).collect()}
    first = {t for t, i in ids.items() if i < K.WORD_BASE + 3}
    assert got == {i: [x for t in toks or [] for x in ([fixed[t]] if t in fixed else [ids[t]] if t in first else [ids[t], 7] if t in ids else [K.UNK])] for i, toks in docs}


def test_only_other_words_are_sent():
    known = K.Known(["the"], [1000])
    col = pa.array([["the", "1", ".", "odd", "x", "odd"], None, [], ["x"]], pa.list_(pa.string()))
    got = known.resolve(col.slice(0)).to_pylist()
    rest = [r["rest"] for r in got]
    assert [sorted(r) for r in rest] == [["odd", "x"], [], [], ["x"]]
    back = [[x if x >= 0 else r["rest"][-x - 1] for x in r["ids"]] for r in got]
    assert back == [[1000, 122, 119, "odd", "x", "odd"], [], [], ["x"]]
    assert known.resolve(col.slice(2)).to_pylist() == got[2:]
