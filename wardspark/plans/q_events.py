"""Event-table queries over the ``fx_event`` family of views."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from wardspark.operators import events as V
from wardspark.operators.buckets import bucketize_values, dense_rank_by
from wardspark.plans.catalog import query
from wardspark.plans import q_cohort  # noqa: F401  (registers the cohort CTE fragments)
from wardspark.plans.oracle_fx import cte, with_ctes
from wardspark.sources import fixtures as X
from wardspark.sources.stage import store
from wardspark.spec import TableSpec, sources_from_config

WINDOW_MIN = 7200  # observation window of the fixture (12 h would leave ~1 event per id)

LAB = TableSpec("LABEVENTS", "charttime", "SUBJ", time_excluded=("storetime",), id_excluded=("row_id",),
                code_column="itemid", value_columns=("valuenum",),
                selected=("itemid", "valuenum", "valueuom"), dictionary=True)
MED = TableSpec("PRESCRIPTIONS", "starttime", "SUBJ", time_excluded=("stoptime",), code_column="drug",
                value_columns=("dose_val",), category_columns=("route",),
                selected=("drug", "dose_val", "dose_unit", "route"))
INF = TableSpec("INPUTEVENTS", "starttime", "SUBJ", id_excluded=("row_id",), code_column="itemid",
                value_columns=("rate",), selected=("itemid", "rate", "rateuom", "amount"), dictionary=True)
SPECS = (LAB, MED, INF)
TABLES = tuple(s.name for s in SPECS)
RAW = {"LABEVENTS": X.fx_lab, "PRESCRIPTIONS": X.fx_med, "INPUTEVENTS": X.fx_inf}
VALUE_COLS = ("itemid", "valuenum", "valueuom", "drug", "dose_val", "dose_unit", "route", "rate", "rateuom")


def canonical_tables(spark, d):
    return [V.canonical(RAW[s.name](spark, d), s) for s in SPECS]


def windowed_table(spark, d, spec, drop_null=True):
    t = V.canonical(RAW[spec.name](spark, d), spec)
    if spec.dictionary:
        t = V.map_dictionary(t, spec.code_column, X.fx_item(spark, d))
    t = V.window_absolute(t, X.fx_event_stay(spark, d), WINDOW_MIN)
    return V.drop_all_null(t, keep=("event_id", "ID", "TIME", "TABLE_NAME")) if drop_null else t


def event_stage(spark, d, hour=False, bucket=True):
    # the windows are joined once: columns without a value, and the patients' counts, are found in what is stored
    u = store(V.union_outer([windowed_table(spark, d, s, drop_null=False) for s in SPECS]), "windowed")
    u = V.drop_all_null(u, keep=("event_id", "ID", "TIME", "TABLE_NAME"))
    if hour:
        u = u.withColumn("TIME", (F.floor(F.col("TIME") / 60) * 60).cast("bigint"))
    # canonical event table: a stage output; ordering samples its keys and reads it once
    u = store(V.min_events(u, 10), "canonical")
    u = V.with_order(u, TABLES)
    return V.with_time_bucket(u) if bucket else u


# ============================================================================ DuckDB twins
def qcut_edges_sql(src: str, value: str, q: int = 20, keys: str = "") -> str:
    """SELECT [keys,] edges FROM src -- exact qcut edges (all i/k fractions, pick k)."""
    fr = sorted({Fraction(i, k) for k in range(1, q + 1) for i in range(k + 1)})
    pos = {f: i + 1 for i, f in enumerate(fr)}
    lits = ", ".join(repr(float(f)) for f in fr)
    cases = " ".join(
        "WHEN k = {kk} THEN [{items}]".format(
            kk=kk, items=", ".join(f"v[{pos[Fraction(i, kk)]}]" for i in range(kk + 1)))
        for kk in range(1, q + 1))
    kc = f"{keys}, " if keys else ""
    gb = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {kc}list_sort(list_distinct(list_transform(CASE {cases} END, lambda e: round(e, 6)))) AS edges
FROM (SELECT {kc}quantile_cont({value}, [{lits}]) AS v, least(count(DISTINCT {value}), {q}) AS k
      FROM {src} WHERE {value} IS NOT NULL {gb}) t"""


def label_sql(x: str, edges: str) -> str:
    return f"CAST(greatest(1, len(list_filter({edges}, lambda e: e < {x}))) AS INTEGER)"


EV_WIN = f"e.ts > s.intime AND e.ts < s.intime + INTERVAL {WINDOW_MIN} MINUTE"
EV_TIME = "CAST(date_sub('minute', s.intime, e.ts) AS BIGINT)"
cte("ev_lab", ("fx_event", "fx_event_stay", "fx_item"), f"""
SELECT e.event_id, e.id AS "ID", {EV_TIME} AS "TIME", 'LABEVENTS' AS "TABLE_NAME",
       i."LABEL" AS itemid, e.value AS valuenum, e.uom AS valueuom
FROM fx_event e JOIN fx_event_stay s ON e.id = s.id JOIN fx_item i ON e.code = i."ITEMID"
WHERE e.tab = 'lab' AND {EV_WIN}""")
cte("ev_med", ("fx_event", "fx_event_stay"), f"""
SELECT e.event_id, e.id AS "ID", {EV_TIME} AS "TIME", 'PRESCRIPTIONS' AS "TABLE_NAME",
       e.code AS drug, e.value AS dose_val, e.uom AS dose_unit,
       CASE WHEN e.value > 25 THEN 'IV' ELSE 'PO' END AS route
FROM fx_event e JOIN fx_event_stay s ON e.id = s.id WHERE e.tab = 'med' AND {EV_WIN}""")
cte("ev_inf", ("fx_event", "fx_event_stay", "fx_item"), f"""
SELECT e.event_id, e.id AS "ID", {EV_TIME} AS "TIME", 'INPUTEVENTS' AS "TABLE_NAME",
       i."LABEL" AS itemid, e.value AS rate, e.uom AS rateuom
FROM fx_event e JOIN fx_event_stay s ON e.id = s.id JOIN fx_item i ON e.code = i."ITEMID"
WHERE e.tab = 'inf' AND {EV_WIN}""")
cte("ev_union", ("ev_lab", "ev_med", "ev_inf"), """
SELECT * FROM ev_lab UNION ALL BY NAME SELECT * FROM ev_med UNION ALL BY NAME SELECT * FROM ev_inf""")
cte("ev_min", ("ev_union",), """
SELECT u.*, c.n_events FROM ev_union u JOIN
  (SELECT "ID", count(*) AS n_events FROM ev_union GROUP BY "ID" HAVING count(*) >= 10) c ON u."ID" = c."ID" """)
ORDER_SQL = """
SELECT *, CAST(row_number() OVER (PARTITION BY "ID" ORDER BY "TIME",
  list_position(['LABEVENTS', 'PRESCRIPTIONS', 'INPUTEVENTS'], "TABLE_NAME"), event_id) AS INTEGER) AS "ORDER"
FROM {src}"""
GAP_SQL = """
SELECT *, CAST(coalesce("TIME" - lag("TIME") OVER (PARTITION BY "ID" ORDER BY "ORDER"), 0) AS BIGINT) AS time_gap
FROM {src}"""
cte("ev_ord", ("ev_min",), ORDER_SQL.format(src="ev_min"))
cte("ev_gap", ("ev_ord",), GAP_SQL.format(src="ev_ord"))
cte("ev_gap_edges", ("ev_gap",), qcut_edges_sql("(SELECT NULLIF(time_gap, 0) AS g FROM ev_gap) z", "g"))
cte("ev_tb", ("ev_gap", "ev_gap_edges"), f"""
SELECT g.*, CASE WHEN time_gap = 0 THEN 0 ELSE {label_sql('time_gap', 'x.edges')} END AS time_bucket
FROM ev_gap g, ev_gap_edges x""")
cte("evh_min", ("ev_union",), """
SELECT u.* REPLACE (CAST(floor("TIME" / 60) * 60 AS BIGINT) AS "TIME"), c.n_events FROM ev_union u JOIN
  (SELECT "ID", count(*) AS n_events FROM ev_union GROUP BY "ID" HAVING count(*) >= 10) c ON u."ID" = c."ID" """)
cte("evh_ord", ("evh_min",), ORDER_SQL.format(src="evh_min"))
cte("evh_gap", ("evh_ord",), GAP_SQL.format(src="evh_ord"))
cte("evh_gap_edges", ("evh_gap",), qcut_edges_sql("(SELECT NULLIF(time_gap, 0) AS g FROM evh_gap) z", "g"))
cte("evh_tb", ("evh_gap", "evh_gap_edges"), f"""
SELECT g.*, CASE WHEN time_gap = 0 THEN 0 ELSE {label_sql('time_gap', 'x.edges')} END AS time_bucket
FROM evh_gap g, evh_gap_edges x""")

BLANK = "CASE WHEN CAST({c} AS VARCHAR) IS NULL OR CAST({c} AS VARCHAR) = 'nan' THEN ' ' ELSE CAST({c} AS VARCHAR) END"
NUM_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
cte("lab_txt", ("ev_lab",), """
SELECT event_id, itemid, valuenum,
  CASE WHEN event_id % 13 = 0 THEN 'neg' WHEN event_id % 29 = 0 THEN '5d' ELSE printf('%.2f', valuenum) END AS value_txt
FROM ev_lab""")


def lab_txt(spark, d):
    lab = windowed_table(spark, d, LAB).select("event_id", "itemid", "valuenum")
    txt = (F.when(F.col("event_id") % 13 == 0, F.lit("neg")).when(F.col("event_id") % 29 == 0, F.lit("5d"))
           .otherwise(F.format_string("%.2f", F.col("valuenum"))))
    return lab.withColumn("value_txt", txt)


# ============================================================================ queries
@query("event_canonical", with_ctes("""
SELECT event_id, id AS "ID", CASE tab WHEN 'lab' THEN 'LABEVENTS' WHEN 'med' THEN 'PRESCRIPTIONS'
       ELSE 'INPUTEVENTS' END AS "TABLE_NAME", CAST(ts AS VARCHAR) AS "TIME" FROM fx_event""", "fx_event"))
def event_canonical(spark, d):
    u = V.union_outer(canonical_tables(spark, d))
    return u.select("event_id", "ID", "TABLE_NAME", F.col("TIME").cast("string").alias("TIME"))


@query("src_union_missing", with_ctes("""
SELECT event_id, itemid, valueuom, flag FROM (
  SELECT event_id, code AS itemid, uom AS valueuom, NULL AS flag FROM fx_event WHERE code = 'view'
  UNION ALL SELECT event_id, code, NULL, CASE WHEN value > 25 THEN 'abnormal' END FROM fx_event WHERE code = 'click') t""",
                                       "fx_event"))
def src_union_missing(spark, d):
    """One table stored as two files with different columns, read as one (outer columns)."""
    lab = X.fx_lab(spark, d)
    mv = lab.where(F.col("itemid") == "view").select("event_id", "itemid", "valueuom")
    cv = lab.where(F.col("itemid") == "click").select(
        "event_id", "itemid", F.when(F.col("valuenum") > 25, F.lit("abnormal")).alias("flag"))
    return V.union_outer([mv, cv]).select("event_id", "itemid", "valueuom", "flag")


@query("event_union", with_ctes('SELECT * FROM ev_union', "ev_union"))
def event_union(spark, d):
    return V.union_outer([windowed_table(spark, d, s) for s in SPECS])


@query("null_profile", with_ctes("""
SELECT 'LABEVENTS' AS table_name, column_name, n_nonnull FROM (UNPIVOT (SELECT count(event_id) AS event_id,
  count("ID") AS "ID", count("TIME") AS "TIME", count("TABLE_NAME") AS "TABLE_NAME", count(itemid) AS itemid,
  count(valuenum) AS valuenum, count(valueuom) AS valueuom FROM ev_lab) ON COLUMNS(*) INTO NAME column_name VALUE n_nonnull)
UNION ALL
SELECT 'INPUTEVENTS', column_name, n_nonnull FROM (UNPIVOT (SELECT count(event_id) AS event_id,
  count("ID") AS "ID", count("TIME") AS "TIME", count("TABLE_NAME") AS "TABLE_NAME", count(itemid) AS itemid,
  count(rate) AS rate, 0::BIGINT AS amount, count(rateuom) AS rateuom FROM ev_inf) ON COLUMNS(*) INTO NAME column_name VALUE n_nonnull)""",
                                  "ev_lab", "ev_inf"))
def null_profile(spark, d):
    out = None
    for s in (LAB, INF):
        p = V.null_profile(windowed_table(spark, d, s, drop_null=False)).withColumn("table_name", F.lit(s.name))
        out = p if out is None else out.unionByName(p)
    return out.select("table_name", "column_name", "n_nonnull")


@query("col_select", with_ctes('SELECT event_id, "ID", "TIME", itemid, valuenum FROM ev_lab', "ev_lab"))
def col_select(spark, d):
    t = windowed_table(spark, d, LAB)
    keep = ["event_id", "ID", "TIME", "itemid", "valuenum"]
    return t.select(*keep)


@query("code_dict_map", with_ctes("""
SELECT e.event_id, i."LABEL" AS label FROM fx_event e JOIN fx_item i ON e.code = i."ITEMID" """, "fx_event", "fx_item"))
def code_dict_map(spark, d):
    e = X.fx_event(spark, d).select("event_id", F.col("code").alias("label"))
    return V.map_dictionary(e, "label", X.fx_item(spark, d))


@query("obs_window", with_ctes('SELECT event_id, "ID", "TIME" FROM ev_union', "ev_union"))
def obs_window(spark, d):
    return V.union_outer([windowed_table(spark, d, s) for s in SPECS]).select("event_id", "ID", "TIME")


@query("obs_window_rel", with_ctes("""
SELECT * FROM (SELECT e.event_id, e.id AS "ID", CAST(date_sub('minute', s.intime, e.ts) AS BIGINT) AS t
               FROM fx_event e JOIN fx_event_stay s ON e.id = s.id) x
WHERE t > 0 AND t < 7200""", "fx_event", "fx_event_stay"))
def obs_window_rel(spark, d):
    from wardspark.functions.clinical import minutes_between
    st = X.fx_event_stay(spark, d)
    e = X.fx_event(spark, d).join(st, "id").select(
        "event_id", F.col("id").alias("ID"), minutes_between("intime", "ts").alias("t"))
    return V.window_relative(e, st, WINDOW_MIN, "t")


@query("min_events", with_ctes('SELECT event_id, "ID", n_events FROM ev_min', "ev_min"))
def min_events(spark, d):
    u = V.union_outer([windowed_table(spark, d, s) for s in SPECS])
    return V.min_events(u, 10).select("event_id", "ID", "n_events")


@query("event_order", with_ctes('SELECT event_id, "ID", "ORDER" FROM ev_ord', "ev_ord"))
def event_order(spark, d):
    return event_stage(spark, d, bucket=False).select("event_id", "ID", "ORDER")


@query("time_gap", with_ctes('SELECT event_id, "ID", time_gap FROM ev_gap', "ev_gap"))
def time_gap(spark, d):
    return event_stage(spark, d, bucket=False).select("event_id", "ID", "time_gap")


@query("time_bucket", with_ctes("SELECT event_id, time_gap, time_bucket FROM ev_tb", "ev_tb"))
def time_bucket(spark, d):
    return event_stage(spark, d).select("event_id", "time_gap", "time_bucket")


@query("time_bucket_hour", with_ctes("SELECT event_id, time_gap, time_bucket FROM evh_tb", "evh_tb"))
def time_bucket_hour(spark, d):
    return event_stage(spark, d, hour=True).select("event_id", "time_gap", "time_bucket")


@query("blank_fill", with_ctes("SELECT event_id, " + ", ".join(
    BLANK.format(c=c) + f" AS {c}" for c in VALUE_COLS) + " FROM ev_tb", "ev_tb"))
def blank_fill(spark, d):
    s = event_stage(spark, d)
    return s.select("event_id", *[V.blank(F.col(c)).alias(c) for c in VALUE_COLS])


@query("code_dense_rank", with_ctes("""
SELECT event_id, itemid, CAST(dense_rank() OVER (PARTITION BY itemid ORDER BY valuenum) AS INTEGER) AS rk
FROM ev_lab""", "ev_lab"))
def code_dense_rank(spark, d):
    lab = windowed_table(spark, d, LAB).select("event_id", "itemid", "valuenum")
    return dense_rank_by(lab, "itemid", "valuenum", "rk").select("event_id", "itemid", "rk")


cte("lab_num", ("lab_txt",), f"""
SELECT *, CASE WHEN num IS NULL THEN NULL ELSE dense_rank() OVER (PARTITION BY itemid, num IS NULL ORDER BY num) END AS rk
FROM (SELECT *, CASE WHEN regexp_matches(value_txt, '{NUM_RE}') THEN TRY_CAST(trim(value_txt) AS DOUBLE) END AS num
      FROM lab_txt) t""")
cte("lab_edges", ("lab_num",), qcut_edges_sql("lab_num", "rk", keys="itemid"))


@query("code_bucket", with_ctes(f"""
SELECT n.event_id, n.itemid, CASE WHEN n.num IS NOT NULL THEN 'B_' || CAST({label_sql('n.rk', 'e.edges')} AS VARCHAR)
       ELSE n.value_txt END AS value_bucket
FROM lab_num n LEFT JOIN lab_edges e ON n.itemid = e.itemid""", "lab_num", "lab_edges"))
def code_bucket(spark, d):
    b = bucketize_values(lab_txt(spark, d), "itemid", "value_txt", "value_bucket")
    return b.select("event_id", "itemid", "value_bucket")


@query("categorize", with_ctes("""
SELECT event_id, CASE WHEN route IS NULL THEN ' ' ELSE 'route_' || route END AS route_cat FROM ev_med""", "ev_med"))
def categorize(spark, d):
    m = windowed_table(spark, d, MED)
    return m.select("event_id", V.categorize(F.col("route"), "route").alias("route_cat"))


@query("code_events", with_ctes("SELECT event_id, " + """
  array_to_string(list_concat(list_transform(list_filter([{cells}], lambda s: s.val <> ' '), lambda s: s.val),
                  ['TB_' || CAST(time_bucket AS VARCHAR)]), ' ') AS event_list,
  array_to_string(list_concat(list_transform(list_filter([{cells}], lambda s: s.val <> ' '),
                  lambda s: "TABLE_NAME" || '_' || s.col), ['[TIME]']), ' ') AS type_list
FROM ev_tb""".format(cells=", ".join(
    "{{'col': '{c}', 'val': {b}}}".format(c=c, b=BLANK.format(c=c)) for c in VALUE_COLS)), "ev_tb"))
def code_events(spark, d):
    s = V.code_event(event_stage(spark, d), VALUE_COLS)
    return s.select("event_id", F.array_join("event_list", " ").alias("event_list"),
                    F.array_join("type_list", " ").alias("type_list"))


# ------------------------------------------------------------------------ sources from specs
CONFIG = [
    {"name": "abs", "flavour": "absolute", "window_minutes": WINDOW_MIN, "tables": [
        {"name": "LABEVENTS", "time_column": "charttime", "id_column": "SUBJ", "time_excluded": ["storetime"], "id_excluded": ["row_id"],
         "code_column": "itemid", "value_columns": ["valuenum"], "selected": ["itemid", "valuenum"], "dictionary": True},
        {"name": "PRESCRIPTIONS", "time_column": "starttime", "id_column": "SUBJ", "value_columns": ["dose_val"], "category_columns": ["route"],
         "selected": ["dose_val", "route"]}]},
    {"name": "rel", "flavour": "relative", "relative_time": True, "window_minutes": 4000, "min_events": 5, "tables": [
        {"name": "lab", "time_column": "t", "id_column": "pid", "code_column": "code", "category_columns": ["code"], "selected": ["code"]}]},
    {"name": "anc", "flavour": "anchored", "window_minutes": 5000, "min_events": 2, "tables": [
        {"name": "INPUTEVENTS", "time_column": "starttime", "id_column": "SUBJ", "id_excluded": ["row_id"], "value_columns": ["rate"], "selected": ["rate", "rateuom"]}],
     "cohort": {"gap_hours": 2, "pred_hours": 24, "los_inclusive": True, "mortality_out_bound": False, "discharge_uses_gap": True, "death_location": "DIED"}},
]


def sources(spark, d):
    from wardspark.functions.clinical import minutes_between
    from wardspark.operators.sources import Inputs
    from wardspark.plans.q_cohort import anchored_inputs
    stays = X.fx_event_stay(spark, d)
    rel = X.fx_event(spark, d).where("tab = 'lab'").join(stays, "id").select("event_id", F.col("id").alias("pid"), minutes_between("intime", "ts").alias("t"), "code")
    found = {"abs": Inputs({s.name: RAW[s.name](spark, d) for s in (LAB, MED)}, (X.fx_stay(spark, d),), stays, X.fx_item(spark, d)),
             "rel": Inputs({"lab": rel}, (X.fx_stay(spark, d),)),
             "anc": Inputs({"INPUTEVENTS": X.fx_inf(spark, d)}, anchored_inputs(spark, d), stays)}
    return {s: found[s.name] for s in sources_from_config(CONFIG)}


def _source_sql(name: str, src: str, tables: str, least: int, cols: str) -> str:
    return f"""SELECT '{name}' AS source, event_id, "ID", "TABLE_NAME", row_number() OVER w AS "ORDER", coalesce("TIME" - lag("TIME") OVER w, 0) AS time_gap, {cols}
FROM {src} WHERE "ID" IN (SELECT "ID" FROM {src} GROUP BY "ID" HAVING count(*) >= {least})
WINDOW w AS (PARTITION BY "ID" ORDER BY "TIME", list_position([{tables}], "TABLE_NAME"), event_id)"""


cte("sp_abs", ("ev_lab", "ev_med"), """
SELECT event_id, "ID", "TIME", "TABLE_NAME", itemid, valuenum, NULL AS route, NULL::DOUBLE AS dose_val FROM ev_lab
UNION ALL SELECT event_id, "ID", "TIME", "TABLE_NAME", NULL, NULL, CASE WHEN route IS NULL THEN ' ' ELSE 'route_' || route END, dose_val FROM ev_med""")
cte("sp_rel", ("fx_event", "fx_event_stay"), """
SELECT * FROM (SELECT e.event_id, e.id AS "ID", CAST(date_sub('minute', s.intime, e.ts) AS BIGINT) AS "TIME", 'lab' AS "TABLE_NAME", 'code_' || e.code AS code
  FROM fx_event e JOIN fx_event_stay s ON e.id = s.id WHERE e.tab = 'lab') x WHERE "TIME" > 0 AND "TIME" < 4000""")
cte("sp_anc", ("fx_event", "fx_event_stay"), """
SELECT e.event_id, e.id AS "ID", CAST(date_sub('minute', s.intime, e.ts) AS BIGINT) AS "TIME", 'INPUTEVENTS' AS "TABLE_NAME", e.value AS rate, e.uom AS rateuom
FROM fx_event e JOIN fx_event_stay s ON e.id = s.id WHERE e.tab = 'inf' AND e.ts > s.intime AND e.ts < s.intime + INTERVAL 5000 MINUTE""")


@query("spec_events", with_ctes("SELECT source, event_id, \"ID\", \"TABLE_NAME\", \"ORDER\"::INTEGER AS \"ORDER\", time_gap::BIGINT AS time_gap, itemid, value, category FROM ("
       + _source_sql("abs", "sp_abs", "'LABEVENTS', 'PRESCRIPTIONS'", 10, "itemid, coalesce(valuenum, dose_val) AS value, route AS category") + "\nUNION ALL "
       + _source_sql("rel", "sp_rel", "'lab'", 5, "NULL AS itemid, NULL::DOUBLE AS value, code AS category") + "\nUNION ALL "
       + _source_sql("anc", "sp_anc", "'INPUTEVENTS'", 2, "NULL AS itemid, rate::DOUBLE AS value, NULL AS category") + ") t", "sp_abs", "sp_rel", "sp_anc"))
def spec_events(spark, d):
    """The events of three sources, compiled from one configuration."""
    from wardspark.operators.sources import compile_events
    u = compile_events(sources(spark, d), stored=lambda df: store(df, "source-events"))
    return u.select("source", "event_id", "ID", "TABLE_NAME", "ORDER", "time_gap", "itemid", F.coalesce("valuenum", "dose_val", "rate").alias("value"),
                    F.coalesce("route", "code").alias("category"))


@query("spec_cohorts", with_ctes("""
SELECT 'abs' AS source, stay_id, adm_id, mortality, los_3day, los_7day FROM abs_cohort
UNION ALL SELECT 'rel', stay_id, adm_id, mortality, los_3day, los_7day FROM rel_cohort
UNION ALL SELECT 'anc', stay_id, adm_id, mortality, los_3day, los_7day FROM anc_cohort""", "abs_cohort", "rel_cohort", "anc_cohort"))
def spec_cohorts(spark, d):
    """The cohorts of three sources, compiled from the same configuration."""
    from wardspark.operators.sources import compile_cohorts
    return compile_cohorts(sources(spark, d), ["stay_id", "adm_id", "mortality", "los_3day", "los_7day"])
