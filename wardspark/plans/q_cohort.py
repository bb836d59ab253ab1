"""Cohort and label queries over the ``fx_stay`` view (and its relative/anchored projections)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspark.functions.clinical import age_from_anchor, age_from_dob, age_from_text
from wardspark.operators import cohort as C
from wardspark.operators.util import first_nonnull_by, first_row_by, hash_bucket, share
from wardspark.plans.catalog import query
from wardspark.plans.oracle_fx import cte, with_ctes
from wardspark.sources import fixtures as X
from wardspark.spec import ABSOLUTE, ANCHORED, RELATIVE


def _s(c):
    return F.col(c).cast("string").alias(c)


def abs_cohort(spark, d, min_stay=True):
    return C.cohort_absolute(X.fx_stay(spark, d), ABSOLUTE, min_stay=min_stay)


def rel_cohort(spark, d, min_stay=True):
    return C.cohort_relative(X.fx_stay(spark, d), RELATIVE, min_stay=min_stay)


def anchored_inputs(spark, d):
    s = X.fx_stay(spark, d)
    icu = s.select("stay_id", "adm_id", "subject_id", "intime", "outtime", "los")
    adm = first_row_by(s, ["adm_id"], ["stay_id"], ["deathtime", "disch_loc"])
    adm = adm.withColumn("disch_loc", F.when(F.col("disch_loc") == "DEAD/EXPIRED", F.lit("DIED"))
                         .otherwise(F.col("disch_loc")))
    pat = s.select("subject_id", "anchor_year", "anchor_age").distinct()
    return icu, adm, pat


# ============================================================================ DuckDB twins
AGE_SQL = "CAST(floor(date_diff('day', dob, CAST(intime AS DATE)) / 365) AS BIGINT)"

cte("abs_base", ("fx_stay",), f"""
SELECT *, {AGE_SQL} AS age FROM fx_stay
WHERE first_unit = last_unit AND {AGE_SQL} >= 18""")
cte("abs_readm", ("abs_base",), """
SELECT adm_id, count(stay_id) AS n_stays, CAST(count(stay_id) > 1 AS INTEGER) AS readmission
FROM abs_base GROUP BY adm_id""")
cte("abs_first", ("abs_base",), """
SELECT * FROM abs_base QUALIFY row_number() OVER (PARTITION BY adm_id ORDER BY intime, stay_id) = 1""")
cte("abs_lab", ("abs_first", "abs_readm"), """
SELECT f.*, r.n_stays, r.readmission,
  CAST(coalesce(deathtime >= intime + INTERVAL 12 HOUR AND deathtime <= intime + INTERVAL 72 HOUR
                AND deathtime <= outtime, false) AS INTEGER) AS mortality,
  CAST(coalesce(deathtime > intime AND deathtime <= outtime, false) AS INTEGER) AS in_icu_mortality,
  CAST(los > 3.0 AS INTEGER) AS los_3day, CAST(los > 7.0 AS INTEGER) AS los_7day
FROM abs_first f LEFT JOIN abs_readm r USING (adm_id)""")
LOC_SQL = """
SELECT *, CASE WHEN in_icu_mortality = 1 THEN 'IN_ICU_MORTALITY'
               WHEN in_hospital_mortality = 1 THEN 'IN_HOSPITAL_MORTALITY' ELSE disch_loc END AS location
FROM (SELECT *, CAST(coalesce({death}, false) AND in_icu_mortality <> 1 AS INTEGER) AS in_hospital_mortality
      FROM {src}) t"""
IMM_SQL = """
SELECT *, CASE WHEN i IN ('IN_ICU_MORTALITY', 'IN_HOSPITAL_MORTALITY') THEN 'No Discharge' ELSE i END AS imminent
FROM (SELECT *, CASE WHEN coalesce({cond}, false) THEN location ELSE 'No Discharge' END AS i FROM {src}) t"""
CODE_SQL = """
SELECT * EXCLUDE (i),
  CAST(CASE WHEN location IS NULL THEN -1
       ELSE dense_rank() OVER (PARTITION BY location IS NULL ORDER BY location) - 1 END AS INTEGER) AS final_acuity,
  CAST(CASE WHEN imminent IS NULL THEN -1
       ELSE dense_rank() OVER (PARTITION BY imminent IS NULL ORDER BY imminent) - 1 END AS INTEGER) AS imminent_discharge
FROM {src}"""
cte("abs_12", ("abs_lab",), "SELECT * FROM abs_lab WHERE los > 1.0")
cte("abs_loc", ("abs_12",), LOC_SQL.format(death="disch_loc = 'DEAD/EXPIRED'", src="abs_12"))
cte("abs_imm", ("abs_loc",), IMM_SQL.format(cond="outtime <= intime + INTERVAL 60 HOUR", src="abs_loc"))
cte("abs_cohort", ("abs_imm",), CODE_SQL.format(src="abs_imm"))

REL_AGE = ("CAST(CASE WHEN age_text IS NULL THEN 1 WHEN age_text = '> 89' THEN 89 "
           "ELSE TRY_CAST(age_text AS INTEGER) END AS INTEGER)")
cte("rel_base", ("fx_stay",), f"SELECT *, {REL_AGE} AS age FROM fx_stay WHERE {REL_AGE} >= 18")
cte("rel_readm", ("rel_base",), """
SELECT adm_id, count(stay_id) AS n_stays, CAST(count(stay_id) > 1 AS INTEGER) AS readmission
FROM rel_base GROUP BY adm_id""")
cte("rel_first", ("rel_base",), """
SELECT * FROM rel_base
QUALIFY row_number() OVER (PARTITION BY adm_id ORDER BY unit_offset DESC, stay_id DESC) = 1""")
cte("rel_lab", ("rel_first", "rel_readm"), """
SELECT f.*, r.n_stays, r.readmission,
  CAST(coalesce(out_offset < 4320 AND out_offset > 720 AND status = 'Expired', false) AS INTEGER) AS mortality,
  CAST(coalesce(status = 'Expired', false) AS INTEGER) AS in_icu_mortality,
  CAST(CAST(out_offset AS DOUBLE) / 1440.0 > 3.0 AS INTEGER) AS los_3day,
  CAST(CAST(out_offset AS DOUBLE) / 1440.0 > 7.0 AS INTEGER) AS los_7day
FROM rel_first f LEFT JOIN rel_readm r USING (adm_id)""")
cte("rel_loc", ("rel_lab",), LOC_SQL.format(death="hosp_status = 'Expired'", src="rel_lab"))
cte("rel_imm", ("rel_loc",), IMM_SQL.format(cond="out_offset < 4320", src="rel_loc"))
cte("rel_coded", ("rel_imm",), CODE_SQL.format(src="rel_imm"))
cte("rel_cohort", ("rel_coded",), "SELECT * FROM rel_coded WHERE out_offset > 1440")

cte("anc_adm", ("fx_stay",), """
SELECT adm_id, deathtime, CASE WHEN disch_loc = 'DEAD/EXPIRED' THEN 'DIED' ELSE disch_loc END AS disch_loc
FROM fx_stay QUALIFY row_number() OVER (PARTITION BY adm_id ORDER BY stay_id) = 1""")
cte("anc_pat", ("fx_stay",), "SELECT DISTINCT subject_id, anchor_year, anchor_age FROM fx_stay")
cte("anc_t", ("fx_stay", "anc_adm", "anc_pat"), """
SELECT * FROM (
  SELECT i.stay_id, i.adm_id, i.subject_id, i.intime, i.outtime, i.los, a.deathtime,
         CAST(year(i.intime) - p.anchor_year + p.anchor_age AS BIGINT) AS age
  FROM fx_stay i JOIN anc_adm a ON i.adm_id = a.adm_id JOIN anc_pat p ON i.subject_id = p.subject_id
  WHERE i.los > 0.5 + 2 / 24.0) t WHERE age >= 18""")
cte("anc_first", ("anc_t",), """
SELECT adm_id,
  arg_min(stay_id, (intime, stay_id)) FILTER (WHERE stay_id IS NOT NULL) AS stay_id,
  arg_min(intime, (intime, stay_id)) FILTER (WHERE intime IS NOT NULL) AS intime,
  arg_min(outtime, (intime, stay_id)) FILTER (WHERE outtime IS NOT NULL) AS outtime,
  arg_min(los, (intime, stay_id)) FILTER (WHERE los IS NOT NULL) AS los,
  arg_min(deathtime, (intime, stay_id)) FILTER (WHERE deathtime IS NOT NULL) AS deathtime,
  arg_min(age, (intime, stay_id)) FILTER (WHERE age IS NOT NULL) AS age,
  CAST(count(*) > 1 AS INTEGER) AS readmission
FROM anc_t GROUP BY adm_id""")
cte("anc_lab", ("anc_first", "anc_adm"), """
SELECT f.*, a.disch_loc,
  CAST(coalesce(f.deathtime >= intime + INTERVAL 12 HOUR AND f.deathtime <= intime + INTERVAL 38 HOUR, false) AS INTEGER) AS mortality,
  CAST(coalesce(f.deathtime > intime AND f.deathtime <= outtime, false) AS INTEGER) AS in_icu_mortality,
  CAST(los >= 3.0 AS INTEGER) AS los_3day, CAST(los >= 7.0 AS INTEGER) AS los_7day
FROM anc_first f LEFT JOIN anc_adm a ON f.adm_id = a.adm_id""")
cte("anc_loc", ("anc_lab",), LOC_SQL.format(death="disch_loc = 'DIED'", src="anc_lab"))
cte("anc_imm", ("anc_loc",), IMM_SQL.format(cond="outtime <= intime + INTERVAL 38 HOUR", src="anc_loc"))
cte("anc_cohort", ("anc_imm",), CODE_SQL.format(src="anc_imm"))

LABELS = "stay_id, adm_id, readmission, mortality, los_3day, los_7day, final_acuity, imminent_discharge"


# ============================================================================ queries
@query("cohort_labels", with_ctes(f"SELECT {LABELS} FROM abs_cohort", "abs_cohort"))
def cohort_labels(spark, d):
    """Flagship: adult first stays above the minimum stay with all outcome labels."""
    return abs_cohort(spark, d).select(*LABELS.split(", "))


@query("cohort_base", with_ctes("SELECT stay_id, adm_id, age FROM abs_base", "abs_base"))
def cohort_base(spark, d):
    return C.base_absolute(X.fx_stay(spark, d)).select("stay_id", "adm_id", "age")


@query("cohort_min_los", with_ctes("SELECT stay_id, adm_id, round(los, 6) AS los FROM abs_cohort", "abs_cohort"))
def cohort_min_los(spark, d):
    return abs_cohort(spark, d).select("stay_id", "adm_id", F.round("los", 6).alias("los"))


@query("first_stay", with_ctes("SELECT adm_id, stay_id, CAST(intime AS VARCHAR) AS intime FROM abs_first", "abs_first"))
def first_stay(spark, d):
    b = C.base_absolute(X.fx_stay(spark, d))
    return C.first_stay(b, ["stay_id", "intime"]).select("adm_id", "stay_id", _s("intime"))


@query("first_stay_max", with_ctes("SELECT adm_id, stay_id, unit_offset FROM rel_first", "rel_first"))
def first_stay_max(spark, d):
    s = X.fx_stay(spark, d).withColumn("age", age_from_text("age_text")).where(F.col("age") >= 18)
    return C.first_stay(s, ["stay_id", "unit_offset"], order=("unit_offset", "stay_id"), desc=True) \
        .select("adm_id", "stay_id", "unit_offset")


@query("first_nonnull", with_ctes("""
SELECT adm_id,
  arg_min(stay_id, (intime, stay_id)) AS first_stay_id,
  CAST(arg_min(deathtime, (intime, stay_id)) FILTER (WHERE deathtime IS NOT NULL) AS VARCHAR) AS deathtime,
  arg_min(disch_loc, (intime, stay_id)) FILTER (WHERE disch_loc IS NOT NULL) AS disch_loc
FROM fx_stay GROUP BY adm_id""", "fx_stay"))
def first_nonnull(spark, d):
    s = X.fx_stay(spark, d).withColumnRenamed("stay_id", "first_stay_id")
    s = s.withColumn("stay_id", F.col("first_stay_id"))
    out = first_nonnull_by(s, ["adm_id"], F.struct("intime", "stay_id"), ["first_stay_id", "deathtime", "disch_loc"])
    return out.select("adm_id", "first_stay_id", _s("deathtime"), "disch_loc")


@query("age_days", with_ctes(f"SELECT stay_id, {AGE_SQL} AS age FROM fx_stay", "fx_stay"))
def age_days(spark, d):
    return X.fx_stay(spark, d).select("stay_id", age_from_dob("intime", "dob").alias("age"))


@query("age_anchor", with_ctes(
    "SELECT stay_id, CAST(year(intime) - anchor_year + anchor_age AS BIGINT) AS age FROM fx_stay", "fx_stay"))
def age_anchor(spark, d):
    return X.fx_stay(spark, d).select(
        "stay_id", age_from_anchor("intime", "anchor_year", "anchor_age").cast("bigint").alias("age"))


@query("age_text", with_ctes(f"SELECT stay_id, age_text, {REL_AGE} AS age FROM fx_stay", "fx_stay"))
def age_text(spark, d):
    return X.fx_stay(spark, d).select("stay_id", "age_text", age_from_text("age_text").alias("age"))


@query("readmission", with_ctes("SELECT adm_id, n_stays, readmission FROM abs_readm", "abs_readm"))
def readmission_q(spark, d):
    return C.readmission(C.base_absolute(X.fx_stay(spark, d)))


@query("obs_marks", with_ctes("""
SELECT stay_id, CAST(intime + INTERVAL 12 HOUR AS VARCHAR) AS obs_12h,
       CAST(intime + INTERVAL 24 HOUR AS VARCHAR) AS obs_24h FROM fx_stay""", "fx_stay"))
def obs_marks(spark, d):
    return C.obs_marks(X.fx_stay(spark, d)).select("stay_id", _s("obs_12h"), _s("obs_24h"))


@query("mortality_abs", with_ctes("SELECT stay_id, mortality FROM abs_lab", "abs_lab"))
def mortality_abs(spark, d):
    return abs_cohort(spark, d, min_stay=False).select("stay_id", "mortality")


@query("mortality_rel", with_ctes("SELECT stay_id, mortality FROM rel_lab", "rel_lab"))
def mortality_rel(spark, d):
    return rel_cohort(spark, d, min_stay=False).select("stay_id", "mortality")


@query("icu_mortality", with_ctes("SELECT stay_id, in_icu_mortality FROM abs_lab", "abs_lab"))
def icu_mortality(spark, d):
    return abs_cohort(spark, d, min_stay=False).select("stay_id", "in_icu_mortality")


@query("hosp_mortality", with_ctes("SELECT stay_id, in_hospital_mortality FROM abs_loc", "abs_loc"))
def hosp_mortality(spark, d):
    return abs_cohort(spark, d).select("stay_id", "in_hospital_mortality")


@query("los_labels", with_ctes("""
SELECT stay_id, CAST(los > 3.0 AS INTEGER) AS los_3day, CAST(los > 7.0 AS INTEGER) AS los_7day,
       CAST(los >= 3.0 AS INTEGER) AS los_3day_ge, CAST(los >= 7.0 AS INTEGER) AS los_7day_ge,
       round(CAST(out_offset AS DOUBLE) / 1440.0, 6) AS losday
FROM fx_stay""", "fx_stay"))
def los_labels(spark, d):
    s = X.fx_stay(spark, d)
    los = F.col("los")
    return s.select("stay_id", (los > 3.0).cast("int").alias("los_3day"), (los > 7.0).cast("int").alias("los_7day"),
                    (los >= 3.0).cast("int").alias("los_3day_ge"), (los >= 7.0).cast("int").alias("los_7day_ge"),
                    F.round(F.col("out_offset").cast("double") / 1440.0, 6).alias("losday"))


@query("final_acuity", with_ctes("SELECT stay_id, location, final_acuity FROM abs_cohort", "abs_cohort"))
def final_acuity(spark, d):
    return abs_cohort(spark, d).select("stay_id", "location", "final_acuity")


@query("final_acuity_rel", with_ctes("SELECT stay_id, location, final_acuity FROM rel_cohort", "rel_cohort"))
def final_acuity_rel(spark, d):
    return rel_cohort(spark, d).select("stay_id", "location", "final_acuity")


@query("imminent_discharge", with_ctes(
    "SELECT stay_id, imminent, imminent_discharge FROM abs_cohort", "abs_cohort"))
def imminent_discharge(spark, d):
    return abs_cohort(spark, d).select("stay_id", "imminent", "imminent_discharge")


@query("cohort_relative", with_ctes(f"SELECT {LABELS} FROM rel_cohort", "rel_cohort"))
def cohort_relative_q(spark, d):
    return rel_cohort(spark, d).select(*LABELS.split(", "))


@query("cohort_inner", with_ctes(f"SELECT {LABELS}, age FROM anc_cohort", "anc_cohort"))
def cohort_inner(spark, d):
    icu, adm, pat = anchored_inputs(spark, d)
    return C.cohort_anchored(icu, adm, pat, ANCHORED).select(*LABELS.split(", "), "age")


@query("value_share", with_ctes("""
SELECT location, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM abs_cohort GROUP BY location""", "abs_cohort"))
def value_share(spark, d):
    return share(abs_cohort(spark, d), ["location"])


@query("distinct_stays", with_ctes("""
SELECT hospital_id, count(DISTINCT stay_id) AS n_stays, count(DISTINCT adm_id) AS n_adm
FROM fx_stay GROUP BY hospital_id""", "fx_stay"))
def distinct_stays(spark, d):
    return X.fx_stay(spark, d).groupBy("hospital_id").agg(
        F.countDistinct("stay_id").alias("n_stays"), F.countDistinct("adm_id").alias("n_adm"))


@query("semi_dx", with_ctes("""
SELECT stay_id, seq, code FROM fx_dx WHERE stay_id IN (SELECT stay_id FROM abs_cohort)""", "fx_dx", "abs_cohort"))
def semi_dx(spark, d):
    return X.fx_dx(spark, d).join(abs_cohort(spark, d).select("stay_id"), "stay_id", "left_semi") \
        .select("stay_id", "seq", "code")


@query("cohort_dx_list", with_ctes("""
SELECT c.stay_id, l.codes FROM abs_cohort c LEFT JOIN
 (SELECT stay_id, array_to_string(list_sort(list(code)), ',') AS codes FROM fx_dx GROUP BY stay_id) l
 ON c.stay_id = l.stay_id""", "fx_dx", "abs_cohort"))
def cohort_dx_list(spark, d):
    dx = X.fx_dx(spark, d).groupBy("stay_id").agg(
        F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))
    return abs_cohort(spark, d).select("stay_id").join(dx, "stay_id", "left")


@query("client_source", with_ctes("""
SELECT adm_id, CASE dbsource WHEN 'metavision' THEN 'mimic3_mv' ELSE 'mimic3_cv' END AS client
FROM (SELECT c.adm_id, arg_min(s.dbsource, s.stay_id) FILTER (WHERE s.dbsource IS NOT NULL) AS dbsource
      FROM abs_cohort c JOIN fx_stay s ON c.adm_id = s.adm_id GROUP BY c.adm_id) t
WHERE dbsource IN ('metavision', 'carevue')""", "abs_cohort", "fx_stay"))
def client_source(spark, d):
    from wardspark.operators.clients import clients_by_source
    return clients_by_source(abs_cohort(spark, d).select("adm_id"), X.fx_stay(spark, d))


@query("top_clients", with_ctes("""
SELECT c.stay_id, 'eicu_' || CAST(c.hospital_id AS VARCHAR) AS client
FROM rel_cohort c JOIN (
  SELECT hospital_id FROM rel_cohort GROUP BY hospital_id ORDER BY count(*) DESC, hospital_id LIMIT 7) t
  ON c.hospital_id = t.hospital_id""", "rel_cohort"))
def top_clients(spark, d):
    from wardspark.operators.clients import clients_top_k
    return clients_top_k(rel_cohort(spark, d), "hospital_id", 7, "eicu_").select("stay_id", "client")


@query("hash_sample", with_ctes("""
SELECT stay_id FROM fx_stay
WHERE CAST(('0x' || substr(md5(CAST(stay_id AS VARCHAR)), 1, 8)) AS BIGINT) % 1000 = 0""", "fx_stay"))
def hash_sample(spark, d):
    """Deterministic 1/1000 sample (the reference's debug head, made order-free)."""
    s = X.fx_stay(spark, d)
    return s.where(hash_bucket(F.col("stay_id"), 1000) == 0).select("stay_id")
