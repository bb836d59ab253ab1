import random

import pytest
from pyspark.sql import functions as F

from wardspark.functions import text as T
from wardspark.operators import tokens as K


def budget_count(event_types, max_len):
    """Contract: the start token, the first k events and one closing slot fit the limit."""
    return max(k for k in range(len(event_types) + 1) if 1 + sum(map(len, event_types[:k])) <= max_len - 1)


@pytest.mark.parametrize("lengths, limit, k", [([3, 3, 3], 8, 2), ([3, 3, 3], 7, 1), ([3, 3, 3], 11, 3), ([9], 10, 0), ([8], 10, 1), ([8, 1], 10, 1)])
def test_budget_by_hand(spark, lengths, limit, k):
    rows = [(1, i, [5] * (n - 1) + [4]) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "ID long, ORDER int, types array<int>")
    assert {r[0] for r in K.with_budget(df, max_len=limit).select("n_budget").collect()} == {k}


@pytest.mark.parametrize("seed", range(4))
def test_budget_matches_procedural_rule(spark, seed):
    rnd = random.Random(seed)
    rows, expect = [], {}
    for pid in range(30):
        evs = [[5] * rnd.randint(1, 3) + [7] * rnd.randint(0, 6) + [4] for _ in range(rnd.randint(1, 12))]
        expect[pid] = budget_count(evs, 40)
        rows += [(pid, k, ev) for k, ev in enumerate(evs)]
    df = spark.createDataFrame(rows, "ID long, ORDER int, types array<int>")
    got = {r["ID"]: r["n_budget"] for r in K.with_budget(df, max_len=40).select("ID", "n_budget").distinct().collect()}
    assert got == expect


def test_budget_boundaries(spark):
    # totals of 8190 and 8191 tokens: the second leaves no room for SEP after its last event
    rows = [(1, 0, [5] * 4094 + [4]), (1, 1, [5] * 4094 + [4]), (2, 0, [5] * 4094 + [4]), (2, 1, [5] * 4095 + [4])]
    df = spark.createDataFrame(rows, "ID long, ORDER int, types array<int>")
    got = {r["ID"]: r["n_budget"] for r in K.with_budget(df).select("ID", "n_budget").distinct().collect()}
    assert got == {1: 2, 2: 1}


def fixed(spark, ids, types, dpes, width=8):
    df = spark.createDataFrame([(ids, types, dpes)], "i array<int>, t array<int>, d array<int>")
    r = df.select(K.fixed_event(F.col("i"), F.col("t"), F.col("d"), width).alias("e")).collect()[0]["e"]
    return [x["i"] for x in r], [x["t"] for x in r], [x["d"] for x in r]


def test_fixed_event_pads(spark):
    ids, ts, ds = fixed(spark, [11, 12, 13, 9], [5, 6, 7, 4], [1, 1, 1, 1])
    assert ids == [101, 11, 12, 13, 9, 102, 0, 0]
    assert ts == [1, 5, 6, 7, 4, 2, 0, 0]
    assert ds == [0, 1, 1, 1, 1, 0, 0, 0]


def test_fixed_event_exact_fit(spark):
    ids, ts, _ = fixed(spark, [11, 12, 13, 14, 15, 9], [5, 6, 7, 6, 7, 4], [1] * 6)
    assert ids == [101, 11, 12, 13, 14, 15, 9, 102] and ts[-1] == 2


def test_fixed_event_truncates_at_last_complete_run(spark):
    # CLS + 9 tokens > width-1: runs of type 7 end at positions 3 and 6 (0-based with CLS)
    ids = [11, 12, 13, 14, 15, 16, 17, 18, 9]
    types = [5, 6, 7, 6, 7, 7, 6, 7, 4]
    out_i, out_t, out_d = fixed(spark, ids, types, [1] * 9)
    # last run end inside the first 8 is 7 (>= width-2) -> previous run end 5... recompute:
    # head types: [1,5,6,7,6,7,7,6] -> run ends at 3 and 6; 6 >= 6 -> use 3
    assert out_i == [101, 11, 12, 13, 9, 102, 0, 0]
    assert out_t == [1, 5, 6, 7, 4, 2, 0, 0]
    assert out_d == [0, 1, 1, 1, 1, 0, 0, 0]


def test_fixed_event_without_run_keeps_cls_time_sep(spark):
    out_i, out_t, _ = fixed(spark, [11] * 9 + [9], [5] * 9 + [4], [1] * 10)
    assert out_i == [101, 9, 102, 0, 0, 0, 0, 0] and out_t == [1, 4, 2, 0, 0, 0, 0, 0]


def test_flatten_and_counts(spark):
    seq = spark.createDataFrame([(1, [[11, 12, 9], [13, 8]], [[5, 7, 4], [5, 4]], [[1, 1, 1], [1, 1]])],
                                "ID long, ids array<array<int>>, types array<array<int>>, dpes array<array<int>>")
    h = K.hierarchical(seq, width=6, max_events=4)
    r = h.select(K.flatten_hi(F.col("hi"), 12).alias("f"), K.count_nonempty_rows(F.col("hi")).alias("n"),
                 F.size("hi").alias("rows")).collect()[0]
    assert [x["i"] for x in r["f"]] == [101, 11, 12, 9, 13, 8, 102, 0, 0, 0, 0, 0]
    assert r["n"] == 2 and r["rows"] == 4


def dpe_expected(tokens):
    """Digit places from the rule: 1 for text; integer part counts down to 7 at the units
    place; the point and the fraction count up from 2; a run with two points that starts
    with a point drops the leading one."""
    num = set(range(121, 131)) | {119}
    out = [1] * len(tokens)
    i = 0
    while i < len(tokens):
        if tokens[i] not in num:
            i += 1
            continue
        j = i
        while j + 1 < len(tokens) and tokens[j + 1] in num:
            j += 1
        s = i
        dots = [p for p in range(i, j + 1) if tokens[p] == 119]
        if len(dots) == 2 and dots[0] == i:
            s, dots = i + 1, dots[1:]
        for p in range(s, j + 1):
            if not dots:
                out[p] = 7 + j - p
            elif p < dots[0]:
                out[p] = 6 + dots[0] - p
            else:
                out[p] = p - dots[0] + 2
        i = j + 1
    return out


D = {str(k): 121 + k for k in range(10)}
D["."] = 119


@pytest.mark.parametrize("text", ["12", "1.25", ".5", "1.0.2", ".1.2", "x 1 2 y 3 . 5 z", "a", "9 9 9 . 0 0 1"])
def test_digit_places(spark, text):
    toks = [D.get(c, 1000 + ord(c)) for c in text.replace(" ", "")]
    df = spark.createDataFrame([(toks,)], "t array<int>")
    got = T.with_digit_places(df, "t", "d").collect()[0]["d"]
    assert got == dpe_expected(toks)


def test_pretokenize_and_vocab(spark):
    df = spark.createDataFrame([("b a a, 1 2 . 5 b a",)], "text string")
    toks = df.select(F.explode(K.pretokenize(F.col("text"))).alias("token"))
    v = {r["token"]: (r["freq"], r["id"]) for r in K.build_vocab(toks).collect()}
    assert v == {"a": (3, 1000), "b": (2, 1001), ",": (1, 1002)}


def test_document_tokens_are_those_of_the_digit_splitter(spark):
    texts = ["", " ", "plain words, no digit!", "12.5mg 1.2.3 ... .5 5. a.b a1b2c v1.2.3-x", "x y z 7é7", "número 3,4;5 \U0001f600 8\U0001f6009", ".", "..", "a..", "1e-5", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 60)], "i int, t string").repartition(3)
    x = df.select(K.document_tokens(F.col("t")).alias("a"), K.pretokenize(T.digit_split_text(F.col("t"))).alias("b"))
    assert all(r.a == r.b for r in x.collect())


def test_a_vocabulary_held_whole_needs_no_second_pass(spark):
    df = spark.createDataFrame([(1, ["a", "7", "new"]), (2, []), (3, None)], "k int, toks array<string>")
    vocab = spark.createDataFrame([("a", 3, K.WORD_BASE), ("b", 1, K.WORD_BASE + 1)], "token string, freq long, id int")
    x = K.encode_tokens(df, "k", "toks", vocab, "ids")
    assert "Join" not in x._jdf.queryExecution().optimizedPlan().toString()
    more = K.encode_tokens(df, "k", "toks", vocab, "ids", top=1)
    assert "Join" in more._jdf.queryExecution().optimizedPlan().toString()
    assert [r.ids for r in x.orderBy("k").collect()] == [r.ids for r in more.orderBy("k").collect()]
    assert x.where("k = 1").first().ids == [K.WORD_BASE, 128, K.UNK]


def test_stored_parts_are_not_spelled_again(spark):
    df = spark.createDataFrame([(1, "LAB", "ab 12", 0)], "event_id long, TABLE_NAME string, c string, time_bucket int")
    parts = K.event_parts(df, ["c"])
    assert K.event_parts(parts, ["c"]) is parts
    vocab = spark.createDataFrame([("ab", 1, 1000), ("LAB", 1, 1001), ("c", 1, 1002)], "token string, freq long, id int")
    plain, stored = (K.event_tokens(x, ["c"], vocab).select("ids", "types", "dpes").collect() for x in (df, parts))
    assert plain == stored and plain[0].ids == [1001, 1002, 1000, 122, 123, 4]


def test_flattening_passes_over_padding(spark):
    df = spark.sql("""SELECT array(array(named_struct('i', 101, 't', 1, 'd', 0), named_struct('i', 7, 't', 4, 'd', 1)), array(named_struct('i', 0, 't', 0, 'd', 0)),
      array(named_struct('i', -3, 't', 7, 'd', 1), named_struct('i', 0, 't', 0, 'd', 0)), array(named_struct('i', 102, 't', 2, 'd', 0))) AS hi""")
    r = df.select(K.flatten_hi(F.col("hi"), 6).alias("f"), K.count_nonempty_rows(F.col("hi")).alias("n")).first()
    assert [tuple(s) for s in r.f] == [(101, 1, 0), (7, 4, 1), (-3, 7, 1), (102, 2, 0), (0, 0, 0), (0, 0, 0)] and r.n == 3
    assert df.select(K.count_time_tokens(K.flatten_hi(F.col("hi"))).alias("n")).first().n == 1
