"""Text queries: drug strings, digit splitting, number spelling, digit places."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspark.functions import text as T
from wardspark.plans.catalog import query
from wardspark.plans.oracle_fx import cte, with_ctes
from wardspark.plans.q_events import LAB, SPECS, windowed_table
from wardspark.operators.events import union_outer
from wardspark.sources import fixtures as X

WS = T.WS
PD = T.PD_NUMBER


def _q(s: str) -> str:
    return s.replace("'", "''")


# ============================================================================ DuckDB helpers
def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}'), lambda w: w <> '')"


def collapse_sql(d: str) -> str:
    return (f"CASE WHEN strpos({d}, '.') > 0 THEN substr({d}, 1, strpos({d}, '.')) || "
            f"replace(substr({d}, strpos({d}, '.') + 1), '.', '') ELSE {d} END")


def chars_sql(x: str) -> str:
    return f"list_filter(string_split({x}, ''), lambda c: c <> '')"


def digit_split_sql(x: str) -> str:
    rest = "regexp_extract(w, '^.*[0-9.](.*)$', 1)"
    first = f"substr(w, 1, length(w) - length({rest}))"
    piece = (f"CASE WHEN regexp_matches(w, '[0-9]') AND NOT regexp_matches(w, '^[0-9.]*$') "
             f"THEN list_concat({chars_sql(collapse_sql(first))}, CASE WHEN {rest} = '' THEN []::VARCHAR[] ELSE [{rest}] END) "
             f"WHEN regexp_matches(w, '^[0-9.]*$') THEN {chars_sql(collapse_sql('w'))} ELSE [w] END")
    return f"array_to_string(flatten(list_transform({words_sql(x)}, lambda w: {piece})), ' ')"


def float_text_sql(x: str, places: int = 4) -> str:
    s = f"regexp_replace(printf('%.{places}f', {x}), '0+$', '')"
    return f"CASE WHEN {s} LIKE '%.' THEN {s} || '0' ELSE {s} END"


def spell_sql(s: str) -> str:
    return f"array_to_string({chars_sql(s)}, ' ')"


# ============================================================================ queries
@query("dosage_parse", with_ctes(f"""
SELECT id, line, dosage, CASE WHEN u = '' THEN ' ' ELSE u END AS uom,
       coalesce(CAST(CAST(regexp_extract_all(src, '(-?\\d+\\.?\\d*)', 1)[-1] AS DOUBLE) AS VARCHAR), ' ') AS value
FROM (SELECT id, line, dosage, trim(regexp_replace(j, '[0-9.\\-]', '', 'g')) AS u,
             CASE WHEN strpos(j, '-') > 0 THEN substr(j, strpos(j, '-') + 1) ELSE j END AS src
      FROM (SELECT id, line, dosage, array_to_string(
              CASE WHEN len(toks) >= 2 AND len(list_filter(toks, lambda t: NOT regexp_matches(t, '{PD}'))) = 0
                   THEN toks[2:] ELSE toks END, ' ') AS j
            FROM (SELECT id, line, dosage, {words_sql("replace(coalesce(dosage, 'nan'), ',', '')")} AS toks
                  FROM fx_dose) a) b) c""", "fx_dose"))
def dosage_parse(spark, d):
    x = X.fx_dose(spark, d)
    value, unit = T.dosage_parts(F.col("dosage"))
    return x.select("id", "line", "dosage", unit.alias("uom"), value.alias("value"))


@query("infusion_parse", with_ctes(f"""
SELECT id, CASE WHEN regexp_matches(n, '[0-9]$') THEN n || ' [UNK]' ELSE n END AS name,
       CASE WHEN u IN ({", ".join("'" + _q(u) + "'" for u in T.UNIT_REMOVE)}) THEN ' ' ELSE u END AS uom
FROM (SELECT id,
        CASE WHEN strpos(s, '(') > 0 THEN substr(s, 1, length(s) - length(after) - 1) ELSE s END AS n,
        CASE WHEN strpos(s, '(') > 0 AND strpos('(' || after, ')') > 0
             THEN substr('(' || after, 1, strpos('(' || after, ')')) ELSE '' END AS u
      FROM (SELECT id, coalesce(drugname, 'nan') AS s, string_split(coalesce(drugname, 'nan'), '(')[-1] AS after
            FROM fx_infusion) a) b""", "fx_infusion"))
def infusion_parse(spark, d):
    x = X.fx_infusion(spark, d)
    name, unit = T.infusion_parts(F.col("drugname"))
    return x.select("id", name.alias("name"), unit.alias("uom"))


@query("digit_split", with_ctes(f"SELECT doc_id, md5({digit_split_sql('text')}) AS split_md5 FROM fx_text", "fx_text"))
def digit_split(spark, d):
    """Whole documents through the digit splitter (hash of the full output text)."""
    return X.fx_text(spark, d).select("doc_id", F.md5(T.digit_split_text(F.col("text"))).alias("split_md5"))


@query("is_numeric_text", with_ctes(f"""
SELECT doc_id, CAST(len(ws) AS INTEGER) AS n_words,
  CAST(len(list_filter(ws, lambda w: regexp_matches(w, '^[0-9.]*$') OR regexp_matches(w, '[0-9]'))) AS INTEGER) AS n_numeric,
  CAST(len(list_filter(ws, lambda w: regexp_matches(w, '^[0-9.]*$'))) AS INTEGER) AS n_all_num
FROM (SELECT doc_id, {words_sql('text')} AS ws FROM fx_text) t""", "fx_text"))
def is_numeric_text(spark, d):
    ws = T.words(F.col("text"))
    return X.fx_text(spark, d).select(
        "doc_id", F.size(ws).alias("n_words"),
        F.size(F.filter(ws, T.is_numeric_word)).alias("n_numeric"),
        F.size(F.filter(ws, lambda w: w.rlike(r"^[0-9.]*$"))).alias("n_all_num"))


cte("rd_src", ("ev_union",), """
SELECT event_id, "ID", coalesce(itemid, drug) AS code, coalesce(valuenum, dose_val, rate) AS v FROM ev_union""")


def rd_src(spark, d):
    u = union_outer([windowed_table(spark, d, s) for s in SPECS])
    return u.select("event_id", "ID", F.coalesce("itemid", "drug").alias("code"),
                    F.coalesce("valuenum", "dose_val", "rate").alias("v"))


@query("round_digits", with_ctes(f"""
SELECT event_id, CASE WHEN v IS NULL OR isnan(v) THEN ' ' ELSE {spell_sql(float_text_sql('v'))} END AS v_txt,
       {spell_sql('CAST("ID" AS VARCHAR)')} AS id_txt, {digit_split_sql('code')} AS code_txt
FROM rd_src""", "rd_src"))
def round_digits(spark, d):
    x = rd_src(spark, d)
    return x.select("event_id", T.round_digits_double(F.col("v")).alias("v_txt"),
                    T.round_digits_long(F.col("ID")).alias("id_txt"),
                    T.round_digits_text(F.col("code")).alias("code_txt"))


@query("cap_decimals", with_ctes(f"""
SELECT event_id, array_to_string(CASE WHEN coalesce(list_position(c, '.'), 0) > 0
         AND len(c) - list_position(c, '.') + 1 > 5 THEN c[1:list_position(c, '.') + 4] ELSE c END, '') AS capped
FROM (SELECT event_id, {chars_sql("printf('%.8f', v / 7.0)")} AS c FROM rd_src) t""", "rd_src"))
def cap_decimals(spark, d):
    x = rd_src(spark, d)
    chars = F.filter(F.split(F.format_string("%.8f", F.col("v") / 7.0), ""), lambda c: c != "")
    return x.select("event_id", F.array_join(T.cap_decimals(chars), "").alias("capped"))


DPE_TEXT_SQL = f"""CASE WHEN event_id % 5 = 0 THEN '.' ELSE '' END || {float_text_sql('valuenum')} || ' '
  || CASE WHEN event_id % 3 = 0 THEN '.' ELSE '' END || valueuom || ' ' || itemid"""
TOKEN_SQL = ("list_transform({w}, lambda x: CASE WHEN regexp_matches(x, '^[0-9]$') THEN 121 + CAST(x AS INTEGER) "
             "WHEN x = '.' THEN 119 ELSE 1000 + ascii(x) END)")
cte("dpe_tok", ("ev_lab",), f"""
SELECT event_id, {TOKEN_SQL.format(w=words_sql(digit_split_sql(DPE_TEXT_SQL)))} AS tokens FROM ev_lab""")
cte("dpe_pos", ("dpe_tok",), """
SELECT event_id, t, i, list_contains([121, 122, 123, 124, 125, 126, 127, 128, 129, 130, 119], t) AS isnum
FROM (SELECT event_id, unnest(tokens) AS t, unnest(range(1, len(tokens) + 1)) AS i FROM dpe_tok) x""")
cte("dpe_rid", ("dpe_pos",), """
SELECT *, sum(CASE WHEN isnum AND NOT coalesce(prev, false) THEN 1 ELSE 0 END)
            OVER (PARTITION BY event_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS rid
FROM (SELECT *, lag(isnum) OVER (PARTITION BY event_id ORDER BY i) AS prev FROM dpe_pos) x""")
cte("dpe_runs", ("dpe_rid",), """
SELECT event_id, rid, s, e,
  CASE WHEN nd = 2 AND d1 = s THEN s + 1 ELSE s END AS s2,
  CASE WHEN nd = 2 AND d1 = s THEN d2 ELSE d1 END AS d
FROM (SELECT event_id, rid, min(i) AS s, max(i) AS e, count(*) FILTER (WHERE t = 119) AS nd,
             min(i) FILTER (WHERE t = 119) AS d1,
             (list(i ORDER BY i) FILTER (WHERE t = 119))[2] AS d2
      FROM dpe_rid WHERE isnum GROUP BY event_id, rid) x""")


def dpe_tokens(spark, d):
    lab = windowed_table(spark, d, LAB)
    txt = F.concat(F.when(F.col("event_id") % 5 == 0, F.lit(".")).otherwise(F.lit("")), T.float_text(F.col("valuenum")),
                   F.lit(" "), F.when(F.col("event_id") % 3 == 0, F.lit(".")).otherwise(F.lit("")),
                   F.col("valueuom"), F.lit(" "), F.col("itemid"))
    w = T.words(T.digit_split_text(txt))
    ids = F.transform(w, lambda x: F.when(x.rlike("^[0-9]$"), F.lit(121) + x.cast("int"))
                      .when(x == ".", F.lit(119)).otherwise(F.lit(1000) + F.ascii(x)))
    return lab.select("event_id", ids.alias("tokens"))


@query("digit_place", with_ctes("""
SELECT p.event_id, array_to_string(list(p.t ORDER BY p.i), ',') AS tokens,
  array_to_string(list(CASE WHEN r.rid IS NULL OR p.i < r.s2 THEN 1 WHEN r.d IS NULL THEN 7 + r.e - p.i
                            WHEN p.i < r.d THEN 6 + r.d - p.i ELSE p.i - r.d + 2 END ORDER BY p.i), ',') AS dpe
FROM dpe_rid p LEFT JOIN dpe_runs r ON p.event_id = r.event_id AND p.rid = r.rid AND p.isnum
GROUP BY p.event_id""", "dpe_rid", "dpe_runs"))
def digit_place(spark, d):
    x = T.with_digit_places(dpe_tokens(spark, d), "tokens", "dpe")
    txt = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return x.select("event_id", txt(F.col("tokens")).alias("tokens"), txt(F.col("dpe")).alias("dpe"))
