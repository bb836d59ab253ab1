"""Vocabulary, event token and sequence queries."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from wardspark.operators import subword as S
from wardspark.operators import tokens as K
from wardspark.plans.catalog import query
from wardspark.plans.oracle_fx import cte, with_ctes
from wardspark.plans.q_events import VALUE_COLS, event_stage
from wardspark.plans.q_text import digit_split_sql, float_text_sql, spell_sql
from wardspark.sources import fixtures as X
from wardspark.sources.stage import store

RE = K.TOKEN_RE.replace("'", "''")
DOUBLE_COLS = {"valuenum", "dose_val", "rate"}


def ints_text(c, sep=","):
    return F.array_join(F.transform(c, lambda v: v.cast("string")), sep)


# ============================================================================ Spark stages
def doc_tokens(spark, d):
    """Tokenised corpus: a stage output (vocabulary build and encoding both read it)."""
    t = X.fx_text(spark, d)
    return store(t.select("doc_id", K.document_tokens(F.col("text")).alias("toks")), "doc-tokens")


def doc_vocab(spark, d, toks=None):
    toks = doc_tokens(spark, d) if toks is None else toks
    return K.build_vocab(toks.select(F.explode(K.words_of(F.col("toks"))).alias("token")))


def events_and_vocab(spark, d):
    """The canonical event table with the parts of its events, a stage output, and the vocabulary of all of them: the
    parts are spelled once and read by vocabulary, budget and encoding."""
    ev = store(K.event_parts(event_stage(spark, d), VALUE_COLS), "events")
    return ev, K.build_vocab(K.event_corpus(ev, VALUE_COLS))


def event_token_stage(spark, d):
    ev, vocab = events_and_vocab(spark, d)
    return K.event_tokens(ev, VALUE_COLS, vocab)


def event_budget(ev):
    """Budget from the lengths of the events' parts; no token is looked up for it."""
    return K.budget(K.event_parts(ev, VALUE_COLS).select("ID", "ORDER", (F.size("_tok") + 1).alias("_len")))


def sequence_stage(spark, d):
    """Sequences: only events inside the budget of patients that are kept are encoded."""
    ev, vocab = events_and_vocab(spark, d)
    fits = event_budget(ev).where(F.col("in_budget") & (F.col("n_budget") <= K.MAX_EVENTS))
    return K.sequences(K.event_tokens(ev.join(fits, ["ID", "ORDER"]), VALUE_COLS, vocab))


# ============================================================================ DuckDB twins
def _cell_sql(c: str) -> str:
    if c in DOUBLE_COLS:
        return f"CASE WHEN {c} IS NULL OR isnan({c}) THEN ' ' ELSE {spell_sql(float_text_sql(c))} END"
    return f"CASE WHEN {c} IS NULL OR {c} = 'nan' THEN ' ' ELSE {digit_split_sql(c)} END"


CELLS = ", ".join(f"{{'col': '{c}', 'vt': regexp_extract_all({_cell_sql(c)}, '{RE}')}}" for c in VALUE_COLS)
cte("tk_parts", ("ev_tb",), f"""
SELECT event_id, "ID", "ORDER", time_bucket,
  list_concat([{{'t': regexp_extract_all("TABLE_NAME", '{RE}'), 'k': 5}}],
    flatten(list_transform(list_filter([{CELLS}], lambda p: len(p.vt) > 0),
       lambda p: [{{'t': regexp_extract_all(p.col, '{RE}'), 'k': 6}}, {{'t': p.vt, 'k': 7}}]))) AS parts
FROM ev_tb""")
cte("tk_flat", ("tk_parts",), """
SELECT event_id, "ID", "ORDER", time_bucket,
  flatten(list_transform(parts, lambda s: s.t)) AS toks,
  flatten(list_transform(parts, lambda s: list_transform(s.t, lambda x: s.k))) AS typs
FROM tk_parts""")
VOCAB_SQL = """
SELECT token, freq, CAST(row_number() OVER (ORDER BY freq DESC, token) + 999 AS INTEGER) AS id FROM (
  SELECT token, count(*) AS freq FROM (SELECT unnest({col}) AS token FROM {src}) t
  WHERE NOT (regexp_matches(token, '^[0-9]$') OR token = '.') GROUP BY token) c"""
cte("tk_vocab", ("tk_flat",), VOCAB_SQL.format(col="toks", src="tk_flat"))
cte("tk_pos", ("tk_flat",), """
SELECT event_id, unnest(toks) AS tok, unnest(typs) AS k, unnest(range(1, len(toks) + 1)) AS i FROM tk_flat""")
ID_SQL = ("CASE WHEN regexp_matches({t}, '^[0-9]$') THEN 121 + CAST({t} AS INTEGER) WHEN {t} = '.' THEN 119 "
          "ELSE coalesce({v}, 100) END")
cte("tk_ids", ("tk_pos", "tk_vocab"), f"""
SELECT p.event_id, list({ID_SQL.format(t='p.tok', v='v.id')} ORDER BY p.i) AS ids
FROM tk_pos p LEFT JOIN tk_vocab v ON p.tok = v.token GROUP BY p.event_id""")
cte("tk_num", ("tk_pos",), """
SELECT event_id, i, CASE WHEN k = 7 AND regexp_matches(tok, '^[0-9]$') THEN 121 + CAST(tok AS INTEGER)
                         WHEN k = 7 AND tok = '.' THEN 119 ELSE 0 END AS t FROM tk_pos""")
cte("tk_rid", ("tk_num",), """
SELECT *, sum(CASE WHEN isnum AND NOT coalesce(prev, false) THEN 1 ELSE 0 END)
            OVER (PARTITION BY event_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS rid
FROM (SELECT *, lag(isnum) OVER (PARTITION BY event_id ORDER BY i) AS prev
      FROM (SELECT *, t <> 0 AS isnum FROM tk_num) a) x""")
cte("tk_runs", ("tk_rid",), """
SELECT event_id, rid, s, e, CASE WHEN nd = 2 AND d1 = s THEN s + 1 ELSE s END AS s2,
  CASE WHEN nd = 2 AND d1 = s THEN d2 ELSE d1 END AS d
FROM (SELECT event_id, rid, min(i) AS s, max(i) AS e, count(*) FILTER (WHERE t = 119) AS nd,
             min(i) FILTER (WHERE t = 119) AS d1, (list(i ORDER BY i) FILTER (WHERE t = 119))[2] AS d2
      FROM tk_rid WHERE isnum GROUP BY event_id, rid) x""")
cte("tk_dpe", ("tk_rid", "tk_runs"), """
SELECT p.event_id, list(CASE WHEN r.rid IS NULL OR p.i < r.s2 THEN 1 WHEN r.d IS NULL THEN 7 + r.e - p.i
                             WHEN p.i < r.d THEN 6 + r.d - p.i ELSE p.i - r.d + 2 END ORDER BY p.i) AS dpe
FROM tk_rid p LEFT JOIN tk_runs r ON p.event_id = r.event_id AND p.rid = r.rid AND p.isnum
GROUP BY p.event_id""")
cte("tk_event", ("tk_flat", "tk_ids", "tk_dpe"), """
SELECT f.event_id, f."ID", f."ORDER", list_concat(i.ids, [CAST(4 + f.time_bucket AS INTEGER)]) AS ids,
       list_concat(f.typs, [4]) AS types, list_concat(d.dpe, [1]) AS dpes
FROM tk_flat f JOIN tk_ids i ON f.event_id = i.event_id JOIN tk_dpe d ON f.event_id = d.event_id""")
cte("tk_budget", ("tk_event",), """
SELECT *, sum(len(types)) OVER (PARTITION BY "ID" ORDER BY "ORDER" ROWS UNBOUNDED PRECEDING) <= 8190 AS in_budget
FROM tk_event""")
cte("tk_nb", ("tk_budget",), """
SELECT "ID", count(*) FILTER (WHERE in_budget) AS n_budget, count(*) AS n_events FROM tk_budget GROUP BY "ID" """)

cte("tk_fix_in", ("tk_budget", "tk_nb"), """
SELECT "ID", CAST(row_number() OVER (PARTITION BY "ID" ORDER BY "ORDER") - 1 AS INTEGER) AS k,
       list_concat([101], ids) AS z, list_concat([1], types) AS t, list_concat([0], dpes) AS d, ids[-1] AS tm
FROM tk_budget WHERE in_budget AND "ID" IN (SELECT "ID" FROM tk_nb WHERE n_budget <= 256)""")
cte("tk_fix_cut", ("tk_fix_in",), """
SELECT *, coalesce(CASE WHEN ends[-1] < 126 THEN ends[-1] ELSE ends[-2] END, 0) + 1 AS keep FROM (
  SELECT *, list_filter(range(0, 128), lambda p: t[p + 1] = 7 AND (p = 127 OR coalesce(t[p + 2], 0) <> 7)) AS ends
  FROM tk_fix_in) x""")
ZEROS = "list_transform(range({n}), lambda x: 0)"
cte("tk_fixed", ("tk_fix_cut",), f"""
SELECT "ID", k,
  CASE WHEN len(z) <= 127 THEN list_concat(z, [102], {ZEROS.format(n='128 - len(z) - 1')})
       ELSE list_concat(z[1:keep], [tm, 102], {ZEROS.format(n='128 - keep - 2')}) END AS fi,
  CASE WHEN len(z) <= 127 THEN list_concat(t, [2], {ZEROS.format(n='128 - len(z) - 1')})
       ELSE list_concat(t[1:keep], [4, 2], {ZEROS.format(n='128 - keep - 2')}) END AS ft,
  CASE WHEN len(z) <= 127 THEN list_concat(d, [0], {ZEROS.format(n='128 - len(z) - 1')})
       ELSE list_concat(d[1:keep], [1, 0], {ZEROS.format(n='128 - keep - 2')}) END AS fd
FROM tk_fix_cut""")
cte("tk_flatseq", ("tk_fixed",), """
SELECT "ID", count(*) AS hi_rows, list_filter(flatten(list(
    list_transform(range(1, len(fi) + 1), lambda i: {'i': fi[i], 't': ft[i], 'd': fd[i]}) ORDER BY k)),
  lambda s: s.i NOT IN (0, 101, 102)) AS body
FROM tk_fixed GROUP BY "ID" """)
cte("tk_flat8192", ("tk_flatseq",), """
SELECT "ID", hi_rows, list_concat([{'i': 101, 't': 1, 'd': 0}], body, [{'i': 102, 't': 2, 'd': 0}],
  list_transform(range(greatest(0, 8192 - len(body) - 2)), lambda x: {'i': 0, 't': 0, 'd': 0})) AS flat
FROM tk_flatseq""")
STRUCT_TXT = "array_to_string(list_transform({a}, lambda s: CAST(s.i AS VARCHAR) || ':' || CAST(s.t AS VARCHAR) || ':' || CAST(s.d AS VARCHAR)), ',')"

cte("tk_seq", ("tk_budget", "tk_nb"), """
SELECT "ID", CAST("ID" % 3 AS VARCHAR) AS client, list(ids ORDER BY "ORDER") AS evs FROM tk_budget
WHERE in_budget AND "ID" IN (SELECT "ID" FROM tk_nb WHERE n_budget <= 256) GROUP BY "ID" """)
cte("tk_batch", ("tk_seq",), """
SELECT *, CAST(least(max(len(evs)) OVER (PARTITION BY client, batch), 256) AS INTEGER) AS target_seq,
       CAST(least(max(list_max(list_transform(evs, lambda e: len(e)))) OVER (PARTITION BY client, batch), 128)
            AS INTEGER) AS target_word
FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY client ORDER BY "ID") - 1) / 64) AS BIGINT) AS batch
      FROM tk_seq) x""")

cte("doc_tok", ("fx_text",), f"SELECT doc_id, regexp_extract_all({digit_split_sql('text')}, '{RE}') AS toks FROM fx_text")
cte("doc_vocab", ("doc_tok",), VOCAB_SQL.format(col="toks", src="doc_tok"))


# ============================================================================ queries
@query("vocab_build", with_ctes("SELECT token, freq, id FROM doc_vocab", "doc_vocab"))
def vocab_build(spark, d):
    return doc_vocab(spark, d)


@query("vocab_encode", with_ctes(f"""
SELECT t.doc_id, CAST(len(t.toks) AS INTEGER) AS n_tokens, md5(coalesce(e.ids, '')) AS ids_md5
FROM doc_tok t LEFT JOIN (
  SELECT doc_id, array_to_string(list({ID_SQL.format(t='p.tok', v='v.id')} ORDER BY p.i), ',') AS ids
  FROM (SELECT doc_id, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS i FROM doc_tok) p
  LEFT JOIN doc_vocab v ON p.tok = v.token GROUP BY doc_id) e ON t.doc_id = e.doc_id""", "doc_tok", "doc_vocab"))
def vocab_encode(spark, d):
    toks = doc_tokens(spark, d)
    enc = K.encode_tokens(toks, "doc_id", "toks", doc_vocab(spark, d, toks), "ids")
    return enc.select("doc_id", F.size("toks").alias("n_tokens"), F.md5(ints_text(F.col("ids"))).alias("ids_md5"))


MAX_WORDS = 5000
cte("sw_words", ("doc_vocab",), f"SELECT token, id FROM doc_vocab WHERE id < {K.WORD_BASE + MAX_WORDS} AND length(token) <= {K.TOP_CHARS}")
cte("sw_chars", ("doc_vocab", "sw_words"), f"""
SELECT c AS piece, {K.WORD_BASE + 2 * MAX_WORDS} + 2 * (row_number() OVER (ORDER BY c) - 1) AS id
FROM (SELECT DISTINCT unnest(string_split(token, '')) AS c FROM doc_vocab) x
WHERE c <> '' AND c NOT IN (SELECT token FROM sw_words)""")
cte("sw_pieces", ("sw_words", "sw_chars"), f"""
SELECT token AS piece, false AS inner_, id FROM sw_words UNION ALL SELECT token, true, id + {MAX_WORDS} FROM sw_words
UNION ALL SELECT piece, false, id FROM sw_chars UNION ALL SELECT piece, true, id + 1 FROM sw_chars""")
cte("sw_split", ("doc_vocab", "sw_words", "sw_pieces"), f"""
WITH RECURSIVE cut AS (SELECT token, 0 AS pos, []::BIGINT[] AS ids, false AS lost FROM doc_vocab WHERE token NOT IN (SELECT token FROM sw_words)
  UNION ALL
  SELECT token, pos + coalesce(n, length(token)), CASE WHEN n IS NULL THEN [100] ELSE list_append(ids, id) END, n IS NULL FROM (
    SELECT c.token, c.pos, c.ids, length(p.piece) AS n, p.id,
           row_number() OVER (PARTITION BY c.token ORDER BY length(p.piece) DESC NULLS LAST) AS r
    FROM (SELECT cut.*, unnest(range(1, least(length(token) - pos, {K.TOP_CHARS}) + 1)) AS m FROM cut WHERE pos < length(token)) c
    LEFT JOIN sw_pieces p ON p.piece = substr(c.token, c.pos + 1, c.m) AND p.inner_ = (c.pos > 0)) x WHERE r = 1)
SELECT token, ids FROM cut WHERE pos >= length(token)""")


@query("subword_encode", with_ctes(f"""
SELECT t.doc_id, CAST(len(t.toks) AS INTEGER) AS n_tokens, CAST(len(coalesce(e.ids, [])) AS INTEGER) AS n_ids,
       CAST(len(list_filter(coalesce(e.ids, []), lambda i: i = 100)) AS INTEGER) AS n_unk, md5(coalesce(array_to_string(e.ids, ','), '')) AS ids_md5
FROM doc_tok t LEFT JOIN (
  SELECT doc_id, flatten(list(CASE WHEN regexp_matches(tok, '^[0-9]$') THEN [121 + CAST(tok AS BIGINT)] WHEN tok = '.' THEN [119]
           WHEN w.id IS NOT NULL THEN [w.id] ELSE coalesce(s.ids, [100]) END ORDER BY i)) AS ids
  FROM (SELECT doc_id, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS i FROM doc_tok) p
  LEFT JOIN sw_words w ON p.tok = w.token LEFT JOIN sw_split s ON p.tok = s.token GROUP BY doc_id) e ON t.doc_id = e.doc_id""",
                                 "doc_tok", "sw_words", "sw_split"))
def subword_encode(spark, d):
    """Documents as ids of whole words and, for words beyond the most frequent, of their longest known pieces."""
    toks = doc_tokens(spark, d)
    vocab = doc_vocab(spark, d, toks)
    pieces = S.piece_table(vocab, MAX_WORDS)
    unseen = vocab.where((F.col("id") >= K.WORD_BASE + MAX_WORDS) | (F.length("token") > K.TOP_CHARS))
    enc = K.encode_tokens(toks, "doc_id", "toks", vocab, "ids", top=MAX_WORDS, others=S.split_words(unseen, pieces))
    unk = F.size(F.filter("ids", lambda i: i == K.UNK))
    return enc.select("doc_id", F.size("toks").alias("n_tokens"), F.size("ids").alias("n_ids"), unk.alias("n_unk"), F.md5(ints_text(F.col("ids"))).alias("ids_md5"))


@query("event_tokens", with_ctes("""
SELECT event_id, array_to_string(ids, ',') AS ids, array_to_string(types, ',') AS types,
       array_to_string(dpes, ',') AS dpes FROM tk_event""", "tk_event"))
def event_tokens(spark, d):
    x = event_token_stage(spark, d)
    return x.select("event_id", ints_text(F.col("ids")).alias("ids"), ints_text(F.col("types")).alias("types"),
                    ints_text(F.col("dpes")).alias("dpes"))


@query("token_budget", with_ctes('SELECT "ID", n_budget, n_events FROM tk_nb', "tk_nb"))
def token_budget(spark, d):
    b = event_budget(store(event_stage(spark, d), "events"))
    return b.groupBy("ID").agg(F.first("n_budget").alias("n_budget"), F.count(F.lit(1)).alias("n_events"))


@query("seq_discard_long", with_ctes('SELECT "ID", n_budget FROM tk_nb WHERE n_budget <= 256', "tk_nb"))
def seq_discard_long(spark, d):
    s = sequence_stage(spark, d)
    return s.select("ID", F.col("n_events").cast("bigint").alias("n_budget"))


@query("event_sequence", with_ctes("""
SELECT "ID", count(*) AS n_events, md5(string_agg(array_to_string(ids, ','), '|' ORDER BY "ORDER")) AS seq_md5
FROM tk_budget WHERE in_budget AND "ID" IN (SELECT "ID" FROM tk_nb WHERE n_budget <= 256) GROUP BY "ID" """, "tk_budget", "tk_nb"))
def event_sequence(spark, d):
    s = sequence_stage(spark, d)
    txt = F.array_join(F.transform("ids", lambda e: ints_text(e)), "|")
    return s.select("ID", F.col("n_events").cast("bigint").alias("n_events"), F.md5(txt).alias("seq_md5"))


SHORT = 12   # events of a sequence, for the report on what is discarded


@query("seq_discards", with_ctes(f"""
SELECT count(*) FILTER (WHERE k = 1 AND n <= {SHORT}) AS patients_kept, count(*) FILTER (WHERE k = 1 AND n > {SHORT}) AS patients_discarded,
  count(*) FILTER (WHERE in_budget AND n <= {SHORT}) AS events_kept, count(*) FILTER (WHERE NOT in_budget AND n <= {SHORT}) AS events_beyond_budget,
  count(*) FILTER (WHERE n > {SHORT}) AS events_of_discarded, count(DISTINCT "ID") FILTER (WHERE n <= {SHORT} AND in_budget) AS sequences
FROM (SELECT "ID", "ORDER" AS k, in_budget, count(*) FILTER (WHERE in_budget) OVER (PARTITION BY "ID") AS n FROM (
  SELECT "ID", "ORDER", sum(len(types)) OVER (PARTITION BY "ID" ORDER BY "ORDER" ROWS UNBOUNDED PRECEDING) <= 298 AS in_budget FROM tk_event) a) b""", "tk_event"))
def seq_discards(spark, d):
    """What the sequences keep and discard, counted while they are built and stored: a budget of 300 tokens and
    12 events."""
    ev, vocab = events_and_vocab(spark, d)
    lengths = K.event_parts(ev, VALUE_COLS).select("ID", "ORDER", (F.size("_tok") + 1).alias("_len"))
    seen = Observation("discards")
    fits = K.observe_budget(K.budget(lengths, max_len=300), seen, SHORT).where(F.col("in_budget") & (F.col("n_budget") <= SHORT))
    stored = store(K.sequences(K.event_tokens(ev.join(fits, ["ID", "ORDER"]), VALUE_COLS, vocab), SHORT), "sequences")
    names = ("patients_kept", "patients_discarded", "events_kept", "events_beyond_budget", "events_of_discarded")
    return stored.agg(F.count(F.lit(1)).alias("sequences")).select(*[F.lit(seen.get[n]).cast("bigint").alias(n) for n in names], "sequences")


def _struct_text(arr):
    def spelled(s):
        padding = (s["i"] == 0) & (s["t"] == 0) & (s["d"] == 0)
        return F.when(padding, F.lit("0:0:0")).otherwise(F.concat_ws(":", s["i"].cast("string"), s["t"].cast("string"), s["d"].cast("string")))
    return F.array_join(F.transform(arr, spelled), ",")


@query("event_fixed", with_ctes("""
SELECT "ID", k, CAST(len(fi) AS INTEGER) AS width, md5(""" + STRUCT_TXT.format(
    a="list_transform(range(1, len(fi) + 1), lambda i: {'i': fi[i], 't': ft[i], 'd': fd[i]})") + """) AS ev_md5
FROM tk_fixed""", "tk_fixed"))
def event_fixed(spark, d):
    """Fixed 128-wide events (CLS, budgeted truncation at a value-run end, time, SEP, zeros)."""
    h = K.hierarchical(sequence_stage(spark, d), pad=False)
    x = h.select("ID", F.posexplode("hi").alias("k", "ev"))
    return x.select("ID", "k", F.size("ev").alias("width"), F.md5(_struct_text(F.col("ev"))).alias("ev_md5"))


@query("seq_flat", with_ctes("""
SELECT "ID", CAST(len(flat) AS INTEGER) AS length,
       CAST(len(list_filter(flat, lambda s: s.t = 4)) AS INTEGER) AS n_events,
       md5(""" + STRUCT_TXT.format(a="flat") + """) AS flat_md5 FROM tk_flat8192""", "tk_flat8192"))
def seq_flat(spark, d):
    """Hierarchical (256 x 128) -> flat 8192 sequence per patient, with the event recount."""
    h = K.hierarchical(sequence_stage(spark, d))
    f = h.withColumn("flat", K.flatten_hi(F.col("hi")))
    return f.select("ID", F.size("flat").alias("length"), K.count_time_tokens(F.col("flat")).alias("n_events"),
                    F.md5(_struct_text(F.col("flat"))).alias("flat_md5"))


@query("seq_check", with_ctes("""
SELECT "ID", flat_count, hi_count, flat_count = hi_count AS equal FROM (
  SELECT "ID", CAST(len(list_filter(flat, lambda s: s.t = 4)) AS INTEGER) AS flat_count,
         CAST(hi_rows AS INTEGER) AS hi_count FROM tk_flat8192) t""", "tk_flat8192"))
def seq_check(spark, d):
    """Data-quality query: flat vs hierarchical event counts per patient (and whether equal)."""
    h = K.hierarchical(sequence_stage(spark, d))
    f = h.select("ID", K.count_time_tokens(K.flatten_hi(F.col("hi"))).alias("flat_count"),
                 K.count_nonempty_rows(F.col("hi")).alias("hi_count"))
    return f.withColumn("equal", F.col("flat_count") == F.col("hi_count"))
