"""Code dictionary, ICD conversion and diagnosis-path queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspark.operators import codes as K
from wardspark.plans.catalog import query
from wardspark.plans.oracle_fx import cte, with_ctes
from wardspark.plans.q_cohort import abs_cohort
from wardspark.sources import fixtures as X


def ints_text(c):
    return F.array_join(F.transform(F.col(c) if isinstance(c, str) else c, lambda x: x.cast("string")), ",")


def ccs(spark, d):
    return K.clean_ccs(X.fx_ccs_raw(spark, d))


def converted(spark, d):
    return K.icd_convert(X.fx_dx(spark, d), X.fx_gem(spark, d))


def stay_classes(spark, d):
    sets = K.class_sets(converted(spark, d).select("stay_id", F.col("converted").alias("code")), ccs(spark, d))
    return K.with_empty_classes(abs_cohort(spark, d).select("stay_id"), sets)


def resolved(spark, d, until=K.STEPS[-1]):
    return K.resolve_paths(X.fx_stay_path(spark, d), X.fx_known(spark, d), ccs(spark, d),
                           X.fx_gem(spark, d), X.fx_override(spark, d), until=until)


def resolved_by(spark, d, step):
    """Paths that one step of the cascade resolved; later steps aren't computed."""
    return resolved(spark, d, step).where(F.col("resolved_by") == step).select("path", "class")


# ============================================================================ DuckDB twins
cte("gem_exact", ("fx_gem",), "SELECT icd10, min(icd9) AS icd9 FROM fx_gem GROUP BY icd10")
cte("icd_unmapped", ("fx_dx", "fx_gem"), """
SELECT DISTINCT code FROM fx_dx WHERE ver = 10 AND code NOT IN (SELECT icd10 FROM fx_gem)""")
cte("icd_hits", ("icd_unmapped", "fx_gem"), """
SELECT u.code, r.i AS plen, g.icd9 FROM icd_unmapped u, range(1, 64) r(i), fx_gem g
WHERE r.i <= length(u.code) AND contains(g.icd10, substr(u.code, 1, r.i))""")
cte("icd_fallback", ("icd_hits",), """
SELECT code, arg_min(icd9, (-n, icd9)) AS icd9 FROM (
  SELECT h.code, h.icd9, count(*) AS n FROM icd_hits h
  JOIN (SELECT code, max(plen) AS plen FROM icd_hits GROUP BY code) b ON h.code = b.code AND h.plen = b.plen
  GROUP BY h.code, h.icd9) t GROUP BY code""")
cte("icd_conv", ("fx_dx", "gem_exact", "icd_fallback"), """
SELECT d.*, CASE WHEN d.ver = 9 THEN d.code ELSE coalesce(e.icd9, f.icd9) END AS converted
FROM fx_dx d LEFT JOIN gem_exact e ON d.code = e.icd10 LEFT JOIN icd_fallback f ON d.code = f.code""")
cte("dx_sets", ("icd_conv", "fx_ccs"), """
SELECT stay_id, list_sort(list(DISTINCT class)) AS classes
FROM icd_conv JOIN fx_ccs ON icd_conv.converted = fx_ccs.code GROUP BY stay_id""")
cte("abs_dx", ("abs_cohort", "dx_sets"), """
SELECT c.stay_id, coalesce(s.classes, []::INTEGER[]) AS classes
FROM abs_cohort c LEFT JOIN dx_sets s ON c.stay_id = s.stay_id""")

PARENT = "CASE WHEN strpos({p}, '|') = 0 THEN '' ELSE substr({p}, 1, length({p}) - strpos(reverse({p}), '|')) END"
ANC4 = "array_to_string(list_slice(string_split({p}, '|'), 1, greatest(len(string_split({p}, '|')) - 4, 0)), '|')"
cte("path_direct", ("fx_known", "fx_ccs"), """
SELECT k.path, min(c.class) AS class FROM fx_known k
JOIN fx_ccs c ON replace(split_part(k.codes, ',', 1), '.', '') = c.code GROUP BY k.path""")
cte("path_rest", ("fx_known", "path_direct"), """
SELECT path, min(codes) AS codes FROM fx_known WHERE path NOT IN (SELECT path FROM path_direct) GROUP BY path""")
cte("path_icd10", ("path_rest", "gem_exact", "fx_ccs"), """
SELECT r.path, min(c.class) AS class FROM path_rest r
JOIN gem_exact g ON replace(r.codes, '.', '') = g.icd10 JOIN fx_ccs c ON g.icd9 = c.code
WHERE len(string_split(r.codes, ',')) = 1 GROUP BY r.path""")
cte("path_ovr", ("path_rest", "path_icd10", "fx_override"), """
SELECT r.path, min(o.class) AS class FROM path_rest r JOIN fx_override o ON r.path = o.path
WHERE r.path NOT IN (SELECT path FROM path_icd10) GROUP BY r.path""")
cte("path_m0", ("path_direct", "path_icd10", "path_ovr"), """
SELECT path, class, 'direct' AS resolved_by FROM path_direct UNION ALL
SELECT path, class, 'icd10' FROM path_icd10 UNION ALL SELECT path, class, 'override' FROM path_ovr""")
cte("path_wanted", ("fx_stay_path",), "SELECT DISTINCT path FROM fx_stay_path")
cte("path_todo1", ("path_wanted", "path_m0"), "SELECT path FROM path_wanted WHERE path NOT IN (SELECT path FROM path_m0)")
cte("path_parent", ("path_todo1", "path_m0"), f"""
SELECT t.path, m.class FROM path_todo1 t JOIN path_m0 m ON m.path = {PARENT.format(p='t.path')}""")
cte("path_m1", ("path_m0", "path_parent"), "SELECT path, class FROM path_m0 UNION ALL SELECT path, class FROM path_parent")
cte("path_todo2", ("path_todo1", "path_parent"), "SELECT path FROM path_todo1 WHERE path NOT IN (SELECT path FROM path_parent)")
cte("path_desc", ("path_todo2", "path_m1"), """
SELECT t.path, min(m.class) AS class FROM path_todo2 t JOIN path_m1 m ON starts_with(m.path, t.path)
GROUP BY t.path HAVING count(DISTINCT m.class) = 1""")
cte("path_m2", ("path_m1", "path_desc"), "SELECT path, class FROM path_m1 UNION ALL SELECT path, class FROM path_desc")
cte("path_todo3", ("path_todo2", "path_desc"), "SELECT path FROM path_todo2 WHERE path NOT IN (SELECT path FROM path_desc)")
cte("path_sib", ("path_todo3", "path_m2"), f"""
SELECT t.path, min(m.class) AS class FROM path_todo3 t JOIN path_m2 m ON starts_with(m.path, {PARENT.format(p='t.path')})
GROUP BY t.path HAVING count(DISTINCT m.class) = 1""")
cte("path_m3", ("path_m2", "path_sib"), "SELECT path, class FROM path_m2 UNION ALL SELECT path, class FROM path_sib")
cte("path_todo4", ("path_todo3", "path_sib"), "SELECT path FROM path_todo3 WHERE path NOT IN (SELECT path FROM path_sib)")
cte("path_anc", ("path_todo4", "path_m3"), f"""
SELECT path, arg_min(class, (-n, class)) AS class FROM (
  SELECT t.path, m.class, count(*) AS n FROM path_todo4 t JOIN path_m3 m ON starts_with(m.path, {ANC4.format(p='t.path')})
  GROUP BY t.path, m.class) x
GROUP BY path HAVING count(*) > 1""")
cte("path_resolved", ("path_m0", "path_parent", "path_desc", "path_sib", "path_anc", "path_todo4"), """
SELECT path, class, resolved_by FROM path_m0 UNION ALL
SELECT path, class, 'parent' FROM path_parent UNION ALL
SELECT path, class, 'descendants' FROM path_desc UNION ALL
SELECT path, class, 'siblings' FROM path_sib UNION ALL
SELECT path, class, 'ancestor_mode' FROM path_anc UNION ALL
SELECT path, CAST(NULL AS INTEGER), 'unresolved' FROM path_todo4 WHERE path NOT IN (SELECT path FROM path_anc)""")


# ============================================================================ queries
@query("code_clean", with_ctes("SELECT code, class FROM fx_ccs", "fx_ccs"))
def code_clean(spark, d):
    return ccs(spark, d)


@query("gem_text_parse", with_ctes("SELECT icd10, icd9, flags FROM fx_gem", "fx_gem"))
def gem_text_parse(spark, d):
    return K.parse_whitespace_table(X.fx_gem_text(spark, d), ["icd10", "icd9", "flags"])


@query("unmapped_codes", with_ctes("SELECT code FROM icd_unmapped", "icd_unmapped"))
def unmapped_codes(spark, d):
    dx = X.fx_dx(spark, d).where(F.col("ver") == 10)
    return K.unmapped(dx, X.fx_gem(spark, d))


@query("icd_prefix_fallback", with_ctes("SELECT code, icd9 FROM icd_fallback", "icd_fallback"))
def icd_prefix_fallback(spark, d):
    dx = X.fx_dx(spark, d).where(F.col("ver") == 10)
    gem = X.fx_gem(spark, d)
    return K.prefix_fallback(K.unmapped(dx, gem), gem)


@query("icd_convert", with_ctes("SELECT stay_id, seq, ver, code, converted FROM icd_conv", "icd_conv"))
def icd_convert(spark, d):
    return converted(spark, d).select("stay_id", "seq", "ver", "code", "converted")


@query("mode_smallest", with_ctes("""
SELECT stay_id, arg_min(converted, (-n, converted)) AS mode FROM (
  SELECT stay_id, converted, count(*) AS n FROM icd_conv WHERE converted IS NOT NULL GROUP BY stay_id, converted) t
GROUP BY stay_id""", "icd_conv"))
def mode_smallest_q(spark, d):
    return K.modal_code(converted(spark, d), "stay_id", "converted")


@query("dx_classes", with_ctes("""
SELECT stay_id, array_to_string(classes, ',') AS classes, CAST(len(classes) AS INTEGER) AS n_classes
FROM abs_dx""", "abs_dx"))
def dx_classes(spark, d):
    c = stay_classes(spark, d)
    return c.select("stay_id", ints_text("classes").alias("classes"), F.size("classes").alias("n_classes"))


@query("dx_length_stats", with_ctes("""
SELECT n_classes, n_stays,
  round(sum(n_classes * n_stays) OVER () / sum(n_stays) OVER (), 6) AS avg_len,
  min(n_classes) OVER () AS min_len, max(n_classes) OVER () AS max_len
FROM (SELECT CAST(len(classes) AS INTEGER) AS n_classes, count(*) AS n_stays FROM abs_dx GROUP BY 1) t""", "abs_dx"))
def dx_length_stats(spark, d):
    return K.length_stats(stay_classes(spark, d))


@query("dx_multihot", with_ctes("""
SELECT stay_id, array_to_string(list_transform(range(1, 19), lambda c: CAST(list_contains(classes, c) AS INTEGER)), ',') AS multihot
FROM abs_dx""", "abs_dx"))
def dx_multihot(spark, d):
    c = stay_classes(spark, d)
    return c.select("stay_id", ints_text(K.multi_hot(F.col("classes"))).alias("multihot"))


@query("dx_path_direct", with_ctes("SELECT path, class FROM path_direct", "path_direct"))
def dx_path_direct(spark, d):
    return resolved_by(spark, d, "direct")


@query("dx_path_icd10", with_ctes("SELECT path, class FROM path_icd10", "path_icd10"))
def dx_path_icd10(spark, d):
    return resolved_by(spark, d, "icd10")


@query("dx_path_override", with_ctes("SELECT path, class FROM path_ovr", "path_ovr"))
def dx_path_override(spark, d):
    return resolved_by(spark, d, "override")


@query("dx_path_parent", with_ctes("SELECT path, class FROM path_parent", "path_parent"))
def dx_path_parent(spark, d):
    return resolved_by(spark, d, "parent")


@query("dx_path_descend", with_ctes("SELECT path, class FROM path_desc", "path_desc"))
def dx_path_descend(spark, d):
    return resolved_by(spark, d, "descendants")


@query("dx_path_sibling", with_ctes("SELECT path, class FROM path_sib", "path_sib"))
def dx_path_sibling(spark, d):
    return resolved_by(spark, d, "siblings")


@query("dx_path_ancestor_mode", with_ctes("SELECT path, class FROM path_anc", "path_anc"))
def dx_path_ancestor_mode(spark, d):
    return resolved_by(spark, d, "ancestor_mode")


@query("dx_path_coverage", with_ctes("""
SELECT resolved_by, count(*) AS n FROM path_wanted JOIN path_resolved USING (path) GROUP BY resolved_by""",
                                     "path_wanted", "path_resolved"))
def dx_path_coverage(spark, d):
    wanted = X.fx_stay_path(spark, d).select("path").distinct()
    return wanted.join(resolved(spark, d), "path").groupBy("resolved_by").agg(F.count(F.lit(1)).alias("n"))


@query("dx_path_apply", with_ctes("""
SELECT stay_id, array_to_string(list_sort(list(DISTINCT class)), ',') AS classes
FROM fx_stay_path JOIN path_resolved USING (path) WHERE class IS NOT NULL GROUP BY stay_id""",
                                  "fx_stay_path", "path_resolved"))
def dx_path_apply(spark, d):
    out = K.apply_path_map(X.fx_stay_path(spark, d), resolved(spark, d))
    return out.select("stay_id", ints_text("classes").alias("classes"))


@query("label_join", with_ctes("""
SELECT c.stay_id, c.readmission, c.mortality, c.los_3day, c.los_7day, c.final_acuity, c.imminent_discharge,
       array_to_string(x.classes, ',') AS dx
FROM abs_cohort c JOIN abs_dx x ON c.stay_id = x.stay_id""", "abs_cohort", "abs_dx"))
def label_join(spark, d):
    """Cohort labels joined with the diagnosis class sets (the per-patient label table)."""
    lab = abs_cohort(spark, d).select("stay_id", "readmission", "mortality", "los_3day", "los_7day",
                                      "final_acuity", "imminent_discharge")
    return lab.join(stay_classes(spark, d), "stay_id").withColumn("dx", ints_text("classes")).drop("classes")
