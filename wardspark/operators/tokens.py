"""Vocabulary, event tokenisation and fixed-shape sequences.

Token ids: fixed ids for [PAD] 0, [CLS]/[SEP] 101/102 on input ids, digits 121-130 and the
point 119, time buckets 4 + k; every other token gets 1000 + its frequency rank. Type ids:
1 CLS, 2 SEP, 4 time, 5 table, 6 column, 7 value, 0 PAD.

Work split: the per-event arrays (tokens, types, digit places) are pure array SQL; the
vocabulary lookup resolves fixed ids and frequent words in place and shuffles each row's other
distinct words; a patient's events are collected only after the token budget has cut them
to at most ``max_events``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from wardspark.functions import text as T
from wardspark.operators.util import global_rank, rank_within, running_sums

# Fixed values (must equal the reference's special ids and limits).
PAD, UNK, CLS, SEP = 0, 100, 101, 102
TYPE_CLS, TYPE_SEP, TYPE_TIME, TYPE_TABLE, TYPE_COL, TYPE_VALUE = 1, 2, 4, 5, 6, 7
TIME_BASE = 4               # TB_0 -> 4, TB_k -> 4 + k
WORD_BASE = 1000            # first id of corpus words
MAX_LEN, MAX_EVENTS, MAX_WORDS = 8192, 256, 128

TOP_TOKENS, TOP_CHARS = 65_536, 64   # words, and characters of a word, that are resolved without a shuffle

PUNCT = r"!-/:-@\[-`{-~"
TOKEN_RE = f"[0-9]|[{PUNCT}]|[^0-9{PUNCT}{T.WS_CHARS}]+"


def pretokenize(text: Column) -> Column:
    """Single digits, single ASCII punctuation marks, and runs of anything else."""
    return F.regexp_extract_all(text, F.lit(TOKEN_RE), 0)


def _split_word(w: str) -> str:
    """One word with a digit or point as ``text.digit_split_text`` spells it."""
    last = max(w.rfind(c) for c in "0123456789.") + 1
    if not _DIGIT.search(w) and w.strip("."):
        return w
    head, point, tail = w[:last].partition(".")
    return " ".join([*head, *point, *tail.replace(".", ""), *filter(None, [w[last:]])])


_DIGIT, _NUMBER, _TOKEN = re.compile("[0-9]"), re.compile("[0-9.]"), re.compile(TOKEN_RE)
TOKEN_ROWS = 256            # documents whose tokens one step holds as Python strings


def document_tokens(text: Column) -> Column:
    """``pretokenize(text.digit_split_text(text))`` for whole documents: words without a digit or point, nearly all, are
    passed over by one search each instead of an array a word."""
    @F.arrow_udf("array<string>")
    def split(col: pa.Array) -> pa.Array:
        done = []
        for at in range(0, max(1, len(col)), TOKEN_ROWS):
            rows = col.slice(at, TOKEN_ROWS).to_pylist()
            done.append(pa.array([None if t is None else _TOKEN.findall(" ".join([_split_word(w) if _NUMBER.search(w) else w for w in t.split()]))
                                  for t in rows], pa.list_(pa.string())))
        return pa.concat_arrays(done)

    return split(text)


def fixed_id(tok: Column) -> Column:
    """Ids that do not depend on the vocabulary (digits and the decimal point)."""
    return F.when(tok.rlike("^[0-9]$"), F.lit(121) + tok.cast("int")).when(tok == ".", F.lit(119))


def _is_fixed(tok: Column) -> Column:
    return tok.isin(*"0123456789.")


def build_vocab(tokens: DataFrame, token: str = "token") -> DataFrame:
    """(token, freq, id) from a token column: frequency rank (ties by token) -> 1000 + rank - 1.

    The rank is global but computed without a single-partition sort (range partitions +
    per-partition counts + offsets)."""
    counts = tokens.where(F.coalesce(~_is_fixed(F.col(token)), F.lit(True))).groupBy(token).agg(F.count(F.lit(1)).alias("freq"))
    ranked = global_rank(counts, [F.desc("freq"), F.asc(token)], "_rk")
    return ranked.select(token, "freq", (F.col("_rk") + (WORD_BASE - 1)).cast("int").alias("id"))


def words_of(tokens: Column) -> Column:
    """The tokens without fixed ids: digits and points are left out before anything is exploded."""
    return F.filter(tokens, lambda t: ~_is_fixed(t))


class Known:
    """Tokens resolved where the rows lie: fixed ids and the most frequent words of a vocabulary."""

    def __init__(self, tokens: list[str], ids: list[int]):
        fixed = [*(str(d) for d in range(10)), "."]
        self.tokens = pa.array([*fixed, *tokens], pa.string())
        self.ids = np.array([*range(121, 131), 119, *ids], dtype=np.int32)

    def resolve(self, col: pa.Array) -> pa.Array:
        """Lists of tokens -> struct of ids and of the row's other distinct tokens; an id below 0 stands for the
        other token at place -id - 1."""
        size = pc.fill_null(pc.list_value_length(col), 0).to_numpy().astype(np.int64)
        flat = col.flatten()
        at = pc.index_in(flat, value_set=self.tokens)
        known = pc.is_valid(at).to_numpy(zero_copy_only=False)
        ids = np.empty(len(flat), dtype=np.int32)
        ids[known] = self.ids[pc.drop_null(at).to_numpy()]
        lost = np.flatnonzero(~known)
        words = pc.dictionary_encode(flat.take(pa.array(lost)))
        width = max(1, len(words.dictionary))
        key, inverse = np.unique(np.repeat(np.arange(len(size)), size)[lost] * width + words.indices.to_numpy(), return_inverse=True)
        row = key // width
        first = np.searchsorted(row, np.arange(len(size) + 1))
        ids[lost] = -(np.arange(len(key)) - first[row] + 1)[inverse]
        rest = words.dictionary.take(pa.array(key % width))
        offsets = np.append(0, np.cumsum(size))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)),
                                           pa.ListArray.from_arrays(pa.array(first, pa.int32()), rest)], ["ids", "rest"])


def known_tokens(vocab: DataFrame, top: int = TOP_TOKENS) -> tuple[list[str], list[int]]:
    """The ``top`` first words of at most TOP_CHARS characters and their ids: a map of bounded size."""
    rows = vocab.where((F.col("id") < WORD_BASE + top) & (F.length("token") <= TOP_CHARS)).select("token", "id").collect()
    return [r["token"] for r in rows], [r["id"] for r in rows]


def encode_tokens(df: DataFrame, key: str, tokens: str, vocab: DataFrame, out: str, top: int = TOP_TOKENS,
                  others: DataFrame | None = None) -> DataFrame:
    """Replace the string array ``tokens`` by ids (OOV -> [UNK]); rows keyed by unique ``key``.

    Digits, the point and the ``top`` most frequent words are resolved where the rows lie, by a map of bounded
    size. Each row's other distinct words, and only these, are shuffled to the vocabulary; where the map holds the whole
    vocabulary, they are [UNK] without a shuffle. ``others`` (token, ids) gives the ids of these words (several a word)
    in place of the vocabulary.
    """
    sent = df.sparkSession.sparkContext.broadcast({"words": known_tokens(vocab, top)})  # a worker keeps its map beside it

    @F.arrow_udf("struct<ids:array<int>,rest:array<string>>")
    def resolve(col: pa.Array) -> pa.Array:
        held = sent.value
        known = held.get("known") or held.setdefault("known", Known(*held["words"]))
        return known.resolve(col)

    many = others is not None
    if not many and vocab.where((F.col("id") >= WORD_BASE + top) | (F.length("token") > TOP_CHARS)).isEmpty():
        x = df.withColumn("_r", resolve(F.col(tokens)))
        return x.withColumn(out, F.transform("_r.ids", lambda i: F.when(i >= 0, i).otherwise(F.lit(UNK)))).drop("_r")
    table = (others.select(F.col("token").alias("_tok"), F.col("ids").alias("_vid")) if many
             else vocab.select(F.col("token").alias("_tok"), F.col("id").alias("_vid")))
    x = df.withColumn("_r", resolve(F.col(tokens)))
    rest = df.select(key, F.posexplode(resolve(F.col(tokens))["rest"]).alias("_j", "_tok")).join(table, "_tok", "left")
    unknown = F.array(F.lit(UNK)) if many else F.lit(UNK)
    got = rest.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_j", F.coalesce("_vid", unknown).alias("i")))).alias("_s"))
    got = got.select(key, F.transform("_s", lambda s: s["i"]).alias("_o"))
    x = x.join(got, key, "left")
    if many:
        ids = F.flatten(F.transform("_r.ids", lambda i: F.when(i >= 0, F.array(i)).otherwise(F.get("_o", -i - 1))))
    else:
        ids = F.transform("_r.ids", lambda i: F.when(i >= 0, i).otherwise(F.get("_o", -i - 1)))
    return x.withColumn(out, ids).drop("_r", "_o")


# ----------------------------------------------------------------------------- events
def cell_text(df: DataFrame, col: str) -> Column:
    """Cell -> text by type (float: spelled digits of round(x,4); integer; text: digit split)."""
    dt = dict(df.dtypes)[col]
    c = F.col(col)
    if dt in ("double", "float"):
        return T.round_digits_double(c)
    if dt in ("int", "bigint", "smallint", "tinyint"):
        return T.round_digits_long(c)
    return F.when(c.isNull() | (c == "nan"), F.lit(" ")).otherwise(T.digit_split_text(c))


def event_parts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Adds ``_tok`` (token strings) and ``_typ`` (type ids) for table name, then each
    non-blank cell's column name and value. Events that were stored with both keep them."""
    if {"_tok", "_typ"} <= set(df.columns):
        return df
    parts = F.array(*[F.struct(F.lit(c).alias("col"), pretokenize(cell_text(df, c)).alias("vt")) for c in cols])
    parts = F.filter(parts, lambda p: F.size(p["vt"]) > 0)   # a cell without tokens is skipped whole
    table = F.struct(pretokenize(F.col("TABLE_NAME")).alias("t"), F.lit(TYPE_TABLE).alias("k"))
    cells = F.transform(parts, lambda p: F.array(
        F.struct(pretokenize(p["col"]).alias("t"), F.lit(TYPE_COL).alias("k")),
        F.struct(p["vt"].alias("t"), F.lit(TYPE_VALUE).alias("k"))))
    seq = F.concat(F.array(table), F.flatten(cells))
    toks = F.flatten(F.transform(seq, lambda s: s["t"]))
    typs = F.flatten(F.transform(seq, lambda s: F.array_repeat(s["k"], F.size(s["t"]))))
    return df.withColumn("_tok", toks).withColumn("_typ", typs)


def event_tokens(df: DataFrame, cols: Sequence[str], vocab: DataFrame, key: str = "event_id",
                 bucket: str = "time_bucket") -> DataFrame:
    """Per event: ``ids``, ``types``, ``dpes`` arrays (table, columns, values, time token)."""
    x = event_parts(df, cols)
    num = F.transform(F.arrays_zip(F.col("_tok").alias("t"), F.col("_typ").alias("k")),
                      lambda z: F.when(z["k"] == TYPE_VALUE, F.coalesce(fixed_id(z["t"]), F.lit(0))).otherwise(0))
    x = T.with_digit_places(x.withColumn("_num", num), "_num", "_dpe")
    x = encode_tokens(x, key, "_tok", vocab, "_ids")
    time_id = (F.lit(TIME_BASE) + F.col(bucket)).cast("int")
    return (x.withColumn("ids", F.concat("_ids", F.array(time_id)))
             .withColumn("types", F.concat(F.col("_typ").cast("array<int>"), F.array(F.lit(TYPE_TIME))))
             .withColumn("dpes", F.concat(F.col("_dpe").cast("array<int>"), F.array(F.lit(1))))
             .drop("_tok", "_typ", "_num", "_dpe", "_ids"))


def event_corpus(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Token column of every event's parts (vocabulary input)."""
    return event_parts(df, cols).select(F.explode("_tok").alias("token"))


# ----------------------------------------------------------------------------- budget
def budget(lengths: DataFrame, max_len: int = MAX_LEN, key: str = "ID", order: str = "ORDER") -> DataFrame:
    """(key, order, _len: tokens of the event, its time token counted) -> (key, order, in_budget, n_budget): whether the
    running count per patient still leaves room for [CLS] and [SEP] inside ``max_len``, and the events that do."""
    x = running_sums(lengths.select(key, order, "_len"), [key], [F.col(order)], ["_len"])
    x = x.select(key, order, (F.col("cum__len") <= max_len - 2).alias("in_budget"))
    return x.join(x.groupBy(key).agg(F.count_if(F.col("in_budget")).alias("n_budget")), key)


def with_budget(df: DataFrame, max_len: int = MAX_LEN, key: str = "ID", order: str = "ORDER") -> DataFrame:
    """``df`` (with ``types``) and its ``budget``; (key, order) names a row. Only lengths are stored and summed."""
    return df.join(budget(df.select(key, order, F.size("types").alias("_len")), max_len, key, order), [key, order])


def sequences(df: DataFrame, max_events: int = MAX_EVENTS, key: str = "ID", order: str = "ORDER") -> DataFrame:
    """One row per kept patient: events inside the budget, in order; patients whose budget
    holds more than ``max_events`` events are discarded before anything is collected."""
    x = df.where(F.col("in_budget") & (F.col("n_budget") <= max_events))
    ev = F.struct(F.col(order).alias("o"), "ids", "types", "dpes")
    g = x.groupBy(key).agg(F.array_sort(F.collect_list(ev)).alias("_e"))
    return g.select(key, F.size("_e").alias("n_events"),
                    F.transform("_e", lambda e: e["ids"]).alias("ids"),
                    F.transform("_e", lambda e: e["types"]).alias("types"),
                    F.transform("_e", lambda e: e["dpes"]).alias("dpes"))


def observe_budget(df: DataFrame, seen: Observation, max_events: int = MAX_EVENTS, order: str = "ORDER") -> DataFrame:
    """``df`` (with ``in_budget``, ``n_budget``) unchanged; when it runs, ``seen`` counts what the sequences keep and
    discard, without another scan: patients (by their first event) and events."""
    long, fits = F.col("n_budget") > max_events, F.col("in_budget")
    first = F.col(order) == 1
    return df.observe(seen, F.count_if(first & ~long).alias("patients_kept"), F.count_if(first & long).alias("patients_discarded"),
                      F.count_if(fits & ~long).alias("events_kept"), F.count_if(~fits & ~long).alias("events_beyond_budget"),
                      F.count_if(long).alias("events_of_discarded"))


# ----------------------------------------------------------------------------- fixed shape
def fixed_event(ids: Column, types: Column, dpes: Column, width: int = MAX_WORDS) -> Column:
    """One event -> array<struct<i,t,d>> of exactly ``width``: CLS first; if it does not fit,
    cut after the last complete value run that leaves room, then time token and SEP; pad 0."""
    z = F.arrays_zip(F.concat(F.array(F.lit(CLS)), ids).alias("i"),
                     F.concat(F.array(F.lit(TYPE_CLS)), types).alias("t"),
                     F.concat(F.array(F.lit(0)), dpes).alias("d"))
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("t"), F.lit(0).alias("d"))
    sep = F.struct(F.lit(SEP).alias("i"), F.lit(TYPE_SEP).alias("t"), F.lit(0).alias("d"))
    n = F.size(z)
    fits = F.concat(z, F.array(sep), F.array_repeat(zero, F.greatest(F.lit(0), F.lit(width) - n - 1)))
    head = F.slice(z, 1, width)
    # 0-based positions of value tokens that end a run inside the first ``width`` tokens
    ends = F.filter(F.sequence(F.lit(0), F.lit(width - 1)),
                    lambda p: (head[p]["t"] == TYPE_VALUE) &
                    F.when(p == width - 1, F.lit(True)).otherwise(head[p + 1]["t"] != TYPE_VALUE))
    last = F.try_element_at(ends, F.lit(-1))
    prev = F.try_element_at(ends, F.lit(-2))
    cut = F.when(last < width - 2, last).otherwise(prev)
    time_tok = F.struct(F.element_at(ids, -1).alias("i"), F.lit(TYPE_TIME).alias("t"), F.lit(1).alias("d"))
    kept = F.when(cut.isNull(), F.slice(head, 1, 1)).otherwise(F.slice(head, 1, (cut + 1).cast("int")))
    trunc = F.concat(kept, F.array(time_tok, sep))
    trunc = F.concat(trunc, F.array_repeat(zero, F.lit(width) - F.size(trunc)))
    return F.when(n > width - 1, trunc).otherwise(fits)


def hierarchical(seqs: DataFrame, width: int = MAX_WORDS, max_events: int = MAX_EVENTS,
                 pad: bool = True) -> DataFrame:
    """Per patient ``hi``: array<array<struct<i,t,d>>> (events x width), zero-padded to
    ``max_events`` rows when ``pad`` (the sink form)."""
    ev = F.transform(F.arrays_zip(F.col("ids").alias("a"), F.col("types").alias("b"), F.col("dpes").alias("c")),
                     lambda e: fixed_event(e["a"], e["b"], e["c"], width))
    x = seqs.withColumn("hi", ev)
    if pad:
        zero_row = F.array_repeat(F.struct(F.lit(0).alias("i"), F.lit(0).alias("t"), F.lit(0).alias("d")), width)
        x = x.withColumn("hi", F.concat("hi", F.array_repeat(zero_row, F.lit(max_events) - F.size("hi"))))
    return x


def _has_ids(row: Column) -> Column:
    return (F.array_max(row["i"]) != PAD) | (F.array_min(row["i"]) != PAD)


def flatten_hi(hi: Column, max_len: int = MAX_LEN) -> Column:
    """Hierarchical -> flat: drop PAD/CLS/SEP ids, CLS first, SEP last, zero-pad to ``max_len``."""
    # rows of padding alone, nearly all of a padded sequence, are told by their largest and least id
    body = F.flatten(F.transform(F.filter(hi, _has_ids), lambda row: F.filter(row, lambda s: ~s["i"].isin(PAD, CLS, SEP))))
    cls = F.struct(F.lit(CLS).alias("i"), F.lit(TYPE_CLS).alias("t"), F.lit(0).alias("d"))
    sep = F.struct(F.lit(SEP).alias("i"), F.lit(TYPE_SEP).alias("t"), F.lit(0).alias("d"))
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("t"), F.lit(0).alias("d"))
    seq = F.concat(F.array(cls), body, F.array(sep))
    return F.concat(seq, F.array_repeat(zero, F.greatest(F.lit(0), F.lit(max_len) - F.size(seq))))


def count_time_tokens(arr: Column) -> Column:
    return F.size(arr) - F.size(F.array_remove(arr["t"], TYPE_TIME))


def count_nonempty_rows(hi: Column) -> Column:
    return F.size(F.filter(hi, _has_ids))


# ----------------------------------------------------------------------------- batches
def batch_sizes(samples: DataFrame, client: str, pid: str, batch_size: int = 64,
                max_seq: int = MAX_EVENTS, max_word: int = MAX_WORDS) -> DataFrame:
    """Collator shapes: batch = (rank of pid within client) / batch_size; target sizes are the
    batch maxima capped by the limits. The rank inside a client is a global rank of (client, pid) minus
    client offsets (no window per client; no sample is stored); the batch maxima are windows over 64 rows."""
    ranks = rank_within(samples.select(client, pid), [client], [F.col(pid)], "_rk")
    ranks = ranks.select(F.col(client).alias("_c"), F.col(pid).alias("_p"), F.floor((F.col("_rk") - 1) / batch_size).alias("batch"))
    x = samples.join(ranks, samples[client].eqNullSafe(F.col("_c")) & (samples[pid] == F.col("_p"))).drop("_c", "_p")
    x = x.withColumn("_seq", F.size("ids")).withColumn("_word", F.array_max(F.transform("ids", lambda e: F.size(e))))
    wb = Window.partitionBy(client, "batch")
    return (x.withColumn("target_seq", F.least(F.max("_seq").over(wb), F.lit(max_seq)))
             .withColumn("target_word", F.least(F.max("_word").over(wb), F.lit(max_word))).drop("_seq", "_word"))


def pad_sample(ids: Column, target_seq: Column, target_word: Column, prefix: int) -> Column:
    """Pad/crop each event to ``target_word`` and the event list to ``target_seq``; new rows
    start with ``prefix`` (CLS for ids, 1 for types and digit places)."""
    rows = F.transform(ids, lambda e: F.when(F.size(e) >= target_word, F.slice(e, 1, target_word))
                       .otherwise(F.concat(e, F.array_repeat(F.lit(0), target_word - F.size(e)))))
    new_row = F.concat(F.array(F.lit(prefix)), F.array_repeat(F.lit(0), target_word - 1))
    return F.when(F.size(rows) >= target_seq, F.slice(rows, 1, target_seq)).otherwise(
        F.concat(rows, F.array_repeat(new_row, target_seq - F.size(rows))))
