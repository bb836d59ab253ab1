"""Fold and client-split queries over the cohort label table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspark.operators import folds as K
from wardspark.operators.clients import clients_by_source
from wardspark.plans.catalog import query
from wardspark.plans.oracle_fx import cte, with_ctes
from wardspark.plans.q_codes import stay_classes
from wardspark.plans.q_cohort import abs_cohort
from wardspark.sources import fixtures as X
from wardspark.sources.stage import store


def fold_labels(spark, d):
    c = abs_cohort(spark, d).select(
        F.col("stay_id").alias("pid"), "adm_id", F.col("mortality").alias("mort"), F.col("los_3day").alias("los3"),
        F.col("los_7day").alias("los7"), F.col("readmission").alias("readm"))
    dx = stay_classes(spark, d).select(F.col("stay_id").alias("pid"), F.col("classes").alias("dx"))
    # the label table is a stage output (one row per patient) read by every split
    return store(c.join(dx, "pid"), "labels")


def client_sources(spark, d):
    return clients_by_source(abs_cohort(spark, d).select("adm_id"), X.fx_stay(spark, d))


def client_labels(spark, d):
    return fold_labels(spark, d).join(client_sources(spark, d), "adm_id")


# ============================================================================ DuckDB twins
cte("fold_labels", ("abs_cohort", "abs_dx"), """
SELECT c.stay_id AS pid, c.adm_id, c.mortality AS mort, c.los_3day AS los3, c.los_7day AS los7,
       c.readmission AS readm, x.classes AS dx
FROM abs_cohort c JOIN abs_dx x ON c.stay_id = x.stay_id""")
cte("seeds", (), "SELECT unnest([2020, 2021, 2022, 2023, 2024]) AS seed")
KEY = "md5(CAST(pid AS VARCHAR) || '_' || CAST(seed AS VARCHAR))"
FOLD = ("CAST(CASE WHEN r <= ceil(n / 10.0) THEN 0 WHEN r <= ceil(n / 10.0) + ceil((n - ceil(n / 10.0)) / 9.0) "
        "THEN 2 ELSE 1 END AS INTEGER)")


def ranked_sql(src: str, part: str) -> str:
    return (f"SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {KEY}, pid) AS r, "
            f"count(*) OVER (PARTITION BY {part}) AS n FROM {src}")


cte("fold_rand", ("fold_labels", "seeds"), f"""
SELECT pid, seed, {FOLD} AS fold FROM ({ranked_sql("(SELECT pid, seed FROM fold_labels, seeds) a", "seed")}) t""")
TASKS_SQL = " UNION ALL ".join(f"SELECT pid, {{g}}'{t}' AS task, CAST({t} AS INTEGER) AS label FROM {{src}}"
                               for t in K.BINARY_TASKS)
cte("fold_strat", ("fold_labels", "seeds"), f"""
SELECT pid, task, seed, label, {FOLD} AS fold FROM ({ranked_sql(
    "(SELECT * FROM (" + TASKS_SQL.format(g="", src="fold_labels") + ") u, seeds) a", "task, seed, label")}) t""")
def iterative_sql(src: str, parts: int, name: str) -> None:
    """CTEs of iterative stratification over the label sets of ``src`` (stratum, ls, n): ``<name>`` has what one of
    ``parts`` folds gets of each. One step a class."""
    cte(f"{name}_0", (src,), f"SELECT stratum, ls, n, NULL::BIGINT AS a FROM {src}")
    for i in range(1, K.MAX_CLASSES + 2):
        last = f"{name}_{i - 1}"
        if i <= K.MAX_CLASSES:
            pick = f"""SELECT c, t, greatest(0, least({parts} * t, (SELECT sum(n) FROM {last} WHERE list_contains(ls, c)) - {parts} *
    coalesce((SELECT sum(a) FROM {last} WHERE list_contains(ls, c)), 0))) AS demand
  FROM (SELECT c, sum(n) AS t FROM (SELECT unnest(ls) AS c, n FROM {last} WHERE a IS NULL) u GROUP BY c ORDER BY t, c LIMIT 1) p"""
            mine = "x.a IS NULL AND list_contains(x.ls, (SELECT c FROM pick))"
        else:
            pick = f"""SELECT 0 AS c, t, greatest(0, least({parts} * t, (SELECT sum(n) FROM {last}) - {parts} * coalesce((SELECT sum(a) FROM {last}), 0))) AS demand
  FROM (SELECT sum(n) AS t FROM {last} WHERE a IS NULL) p"""
            mine = "x.a IS NULL AND (SELECT t FROM pick) > 0"
        cte(f"{name}_{i}", (last,), f"""
WITH pick AS ({pick}),
run AS (SELECT x.stratum, x.n, sum(x.n) OVER (ORDER BY x.stratum COLLATE C ROWS UNBOUNDED PRECEDING) AS upto FROM {last} x WHERE {mine})
SELECT x.stratum, x.ls, x.n, coalesce(x.a, (SELECT (upto * demand) // ({parts} * t) - ((upto - run.n) * demand) // ({parts} * t)
  FROM run, pick WHERE run.stratum = x.stratum))::BIGINT AS a FROM {last} x""")
    cte(name, (f"{name}_{K.MAX_CLASSES + 1}",), f"SELECT stratum, ls, n, coalesce(a, 0) AS a FROM {name}_{K.MAX_CLASSES + 1}")


cte("ml_rows", ("fold_labels",), "SELECT pid, array_to_string(list_sort(list_distinct(dx)), ',') AS stratum, list_distinct(dx) AS ls FROM fold_labels")
cte("ml_sets", ("ml_rows",), "SELECT stratum, any_value(ls) AS ls, count(*)::BIGINT AS n FROM ml_rows GROUP BY stratum")
iterative_sql("ml_sets", 10, "ml_test")
cte("ml_rest", ("ml_test",), "SELECT stratum, ls, n - a AS n FROM ml_test")
iterative_sql("ml_rest", 9, "ml_valid")
cte("fold_ml", ("ml_rows", "ml_test", "ml_valid", "seeds"), f"""
SELECT pid, seed, t.stratum, CAST(CASE WHEN r <= q.a THEN 0 WHEN r <= q.a + v.a THEN 2 ELSE 1 END AS INTEGER) AS fold
FROM ({ranked_sql("(SELECT pid, stratum, seed FROM ml_rows, seeds) a", "stratum, seed")}) t
JOIN ml_test q ON q.stratum = t.stratum JOIN ml_valid v ON v.stratum = t.stratum""")
cte("client_src", ("abs_cohort", "fx_stay"), """
SELECT adm_id, CASE dbsource WHEN 'metavision' THEN 'mimic3_mv' ELSE 'mimic3_cv' END AS client
FROM (SELECT c.adm_id, arg_min(s.dbsource, s.stay_id) FILTER (WHERE s.dbsource IS NOT NULL) AS dbsource
      FROM abs_cohort c JOIN fx_stay s ON c.adm_id = s.adm_id GROUP BY c.adm_id) t
WHERE dbsource IN ('metavision', 'carevue')""")
cte("client_labels", ("fold_labels", "client_src"), "SELECT l.*, c.client FROM fold_labels l JOIN client_src c USING (adm_id)")
cte("fold_client", ("client_labels", "seeds"), f"""
SELECT pid, client, task, seed, label, {FOLD} AS fold FROM ({ranked_sql(
    "(SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT pid, client, '{t}' AS task, CAST({t} AS INTEGER) AS label FROM client_labels" for t in K.BINARY_TASKS)
    + ") u, seeds) a", "client, task, seed, label")}) t""")


# ============================================================================ queries
@query("fold_random", with_ctes("SELECT pid, seed, fold FROM fold_rand", "fold_rand"))
def fold_random(spark, d):
    return K.random_folds(fold_labels(spark, d)).select("pid", "seed", "fold")


@query("fold_stratified", with_ctes("SELECT pid, task, seed, label, fold FROM fold_strat", "fold_strat"))
def fold_stratified(spark, d):
    return K.stratified_folds(fold_labels(spark, d)).select("pid", "task", "seed", "label", "fold")


@query("fold_multilabel", with_ctes("SELECT pid, seed, stratum, fold FROM fold_ml", "fold_ml"))
def fold_multilabel(spark, d):
    return K.multilabel_folds(fold_labels(spark, d)).select("pid", "seed", "stratum", "fold")


@query("fold_grid", with_ctes("""
SELECT pid, task, seed, 'strat' AS scheme, fold FROM fold_strat UNION ALL
SELECT pid, 'dx', seed, 'strat', fold FROM fold_ml UNION ALL
SELECT pid, 'all', seed, 'rand', fold FROM fold_rand""", "fold_strat", "fold_ml", "fold_rand"))
def fold_grid(spark, d):
    return K.fold_grid(fold_labels(spark, d)).select("pid", "task", "seed", "scheme", "fold")


@query("fold_label_share", with_ctes("""
SELECT task, seed, label, fold, count(*) AS n,
       round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY task, seed), 6) AS pct
FROM fold_strat GROUP BY task, seed, label, fold""", "fold_strat"))
def fold_label_share(spark, d):
    return K.label_share(K.stratified_folds(fold_labels(spark, d)))


@query("fold_select", with_ctes("""
SELECT l.pid, l.mort FROM fold_labels l
WHERE l.pid IN (SELECT pid FROM fold_strat WHERE task = 'mort' AND seed = 2020 AND fold = 1)""",
                                "fold_labels", "fold_strat"))
def fold_select(spark, d):
    lab = fold_labels(spark, d)
    f = K.stratified_folds(lab).where((F.col("task") == "mort") & (F.col("seed") == 2020))
    return K.select_fold(lab, f, K.TRAIN).select("pid", "mort")


@query("train_ratio", with_ctes("""
SELECT pid FROM fold_strat WHERE task = 'mort' AND seed = 2020 AND fold = 1
  AND CAST(('0x' || substr(md5(CAST(pid AS VARCHAR)), 1, 8)) AS BIGINT) % 100 < 10""", "fold_strat"))
def train_ratio(spark, d):
    f = K.stratified_folds(fold_labels(spark, d))
    train = f.where((F.col("task") == "mort") & (F.col("seed") == 2020) & (F.col("fold") == K.TRAIN))
    return K.ratio_subset(train.select("pid"), 10)


@query("fold_per_client", with_ctes("SELECT pid, client, task, seed, fold FROM fold_client", "fold_client"))
def fold_per_client(spark, d):
    f = K.stratified_folds(client_labels(spark, d), group=["client"])
    return f.select("pid", "client", "task", "seed", "fold")


@query("pooled_train", with_ctes("""
SELECT l.pid, l.mort FROM client_labels l JOIN fold_client f ON l.pid = f.pid
WHERE f.task = 'mort' AND f.seed = 2020 AND f.fold = 1""", "client_labels", "fold_client"))
def pooled_train(spark, d):
    """Pooled training set: every client's training rows, client key dropped."""
    lab = client_labels(spark, d)
    f = K.stratified_folds(lab, group=["client"])
    f = f.where((F.col("task") == "mort") & (F.col("seed") == 2020) & (F.col("fold") == K.TRAIN))
    return lab.join(f.select("pid"), "pid", "left_semi").select("pid", "mort")


@query("array_json_roundtrip", with_ctes("""
SELECT pid, CAST(to_json(dx) AS VARCHAR) AS dx_json, CAST(len(dx) AS INTEGER) AS n FROM fold_labels""", "fold_labels"))
def array_json_roundtrip(spark, d):
    """Label table exported with JSON text arrays and parsed back with an explicit type."""
    from wardspark.sources.io import arrays_to_json, json_to_arrays
    lab = fold_labels(spark, d).select("pid", "dx")
    txt = arrays_to_json(lab, ["dx"])
    back = json_to_arrays(txt.withColumnRenamed("dx", "dx_json").withColumn("dx", F.col("dx_json")),
                          {"dx": "array<int>"})
    return back.select("pid", "dx_json", F.size("dx").alias("n"))
