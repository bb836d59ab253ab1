"""Fixture views: the clinical shapes of the reference laid over the driver's tables.

This is the only module that knows the TPC-H-ish column names. Every view is a pure
projection/join of whole tables, so its size grows with the scale factor. The DuckDB
twin of each view lives in ``wardspark.plans.oracle_fx`` and must stay expression-for-
expression identical (``floor`` before any double->integer cast, whole minutes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hours(n: Column, ts: Column) -> Column:
    return F.timestamp_add("HOUR", n, ts)


def _brand_no(c: str = "p_brand") -> Column:
    return F.substring(F.col(c), 7, 10)


def _k_code(c: str) -> Column:
    return F.concat(F.lit("K"), F.lpad(F.col(c).cast("string"), 5, "0"))


# ----------------------------------------------------------------------------- stays
def fx_stay(spark: SparkSession, d: str) -> DataFrame:
    """orders x customer -> one row per unit stay (all three source flavours' columns)."""
    o = read(spark, d, "orders")
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey)
    k = F.col("o_orderkey")
    intime = _hours(k % 24, F.col("o_orderdate"))
    los = F.col("o_totalprice") / F.lit(50000.0)
    fin = F.col("o_orderstatus") == "F"
    return j.select(
        k.alias("stay_id"),
        F.col("o_custkey").alias("subject_id"),
        (F.col("o_custkey") * 10 + (F.year("o_orderdate") - 1995)).alias("adm_id"),
        intime.alias("intime"),
        los.alias("los"),
        F.timestamp_add("SECOND", F.floor(los * 86400), intime).alias("outtime"),
        F.floor(los * 1440).alias("out_offset"),
        F.col("c_mktsegment").alias("first_unit"),
        F.when(k % 5 == 0, F.lit("OTHER")).otherwise(F.col("c_mktsegment")).alias("last_unit"),
        F.date_add(F.lit("1960-01-01").cast("date"), ((F.col("c_custkey") * 37) % 14000).cast("int")).alias("dob"),
        F.when(fin, _hours(k % 120, intime)).alias("deathtime"),
        F.when(fin & (k % 4 == 0), F.lit("DEAD/EXPIRED"))
         .when(k % 17 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("o_orderpriority")).alias("disch_loc"),
        F.when(fin, F.lit("Expired")).otherwise(F.lit("Alive")).alias("status"),
        F.when(fin | (k % 7 == 0), F.lit("Expired")).otherwise(F.lit("Alive")).alias("hosp_status"),
        F.col("c_nationkey").alias("hospital_id"),
        F.when(F.col("c_nationkey") % 3 == 0, F.lit("carevue"))
         .when(F.col("c_nationkey") % 3 == 1, F.lit("metavision"))
         .otherwise(F.lit("both")).alias("dbsource"),
        F.when(F.col("c_custkey") % 19 == 0, F.lit("> 89"))
         .when(F.col("c_custkey") % 23 == 0, F.lit(None).cast("string"))
         .otherwise((F.col("c_custkey") % 90).cast("string")).alias("age_text"),
        (-(k % 5000)).alias("unit_offset"),
        (F.lit(1990) + F.col("c_custkey") % 8).alias("anchor_year"),
        ((F.col("c_custkey") * 7) % 80 + 5).alias("anchor_age"),
    )


# ----------------------------------------------------------------------------- codes
def fx_dx(spark: SparkSession, d: str) -> DataFrame:
    """lineitem x part -> diagnosis rows (stay_id, seq, ver, code)."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    p = read(spark, d, "part").select("p_partkey", "p_brand")
    j = li.join(p, li.l_partkey == p.p_partkey)
    ver = F.when(F.col("l_partkey") % 2 == 0, F.lit(9)).otherwise(F.lit(10))
    return j.select(
        F.col("l_orderkey").alias("stay_id"),
        F.col("l_linenumber").alias("seq"),
        ver.alias("ver"),
        F.when(ver == 9, _brand_no()).otherwise(_k_code("l_partkey")).alias("code"),
    )


def fx_gem(spark: SparkSession, d: str) -> DataFrame:
    """ICD-10 -> ICD-9 general equivalence rows (icd10, icd9, flags)."""
    p = read(spark, d, "part").where(F.col("p_partkey") % 3 != 0)
    return p.select(_k_code("p_partkey").alias("icd10"), _brand_no().alias("icd9"),
                    F.lit("10000").alias("flags"))


def fx_gem_text(spark: SparkSession, d: str) -> DataFrame:
    """The same equivalence rows as a header-less whitespace-delimited text column."""
    g = fx_gem(spark, d)
    return g.select(F.concat(F.lit("  "), F.col("icd10"), F.lit("\t "), F.col("icd9"),
                             F.lit("   "), F.col("flags"), F.lit(" ")).alias("value"))


def fx_ccs_raw(spark: SparkSession, d: str) -> DataFrame:
    """CCS single-level rows with the quoted spelling of the public CSV."""
    b = read(spark, d, "part").select(_brand_no().alias("code")).distinct()
    n = F.col("code").cast("int")
    b = b.where(n % 6 != 0)
    return b.select(
        F.concat(F.lit("'"), F.col("code"), F.lit(" '")).alias("icd_raw"),
        F.concat(F.lit("'"), (n % 18 + 1).cast("string"), F.lit("'")).alias("class_raw"))


# ----------------------------------------------------------------------------- paths
def _part_paths(p: DataFrame) -> DataFrame:
    adj = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
    noun = F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
    return p.select(
        "p_partkey", "p_brand", "p_type",
        F.concat_ws("|", "p_type", noun, adj, "p_brand").alias("path4"),
        F.concat_ws("|", "p_type", noun, adj).alias("path3"))


def fx_stay_path(spark: SparkSession, d: str) -> DataFrame:
    """(stay_id, path): hierarchical diagnosis strings per stay."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    p = _part_paths(read(spark, d, "part"))
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.select(F.col("l_orderkey").alias("stay_id"),
                    F.when(F.col("l_partkey") % 7 == 0, F.col("path3"))
                     .otherwise(F.col("path4")).alias("path"))


def fx_known(spark: SparkSession, d: str) -> DataFrame:
    """(path, codes): diagnosis strings that carry a code list (ICD-9 digits or ICD-10)."""
    p = _part_paths(read(spark, d, "part"))
    k = F.col("p_partkey")
    d4 = p.where((k % 4 == 0) & (F.col("p_brand") != "Brand#3")).select(
        F.col("path4").alias("path"),
        F.when(k % 8 == 0, _brand_no())
         .when(k % 40 == 4, F.concat(_k_code("p_partkey"), F.lit(", "),
                                     F.concat(F.lit("K"), F.lpad((k + 1).cast("string"), 5, "0"))))
         .otherwise(_k_code("p_partkey")).alias("codes"))
    bn = _brand_no()
    dotted = F.when(F.length(bn) == 2, F.concat(F.substring(bn, 1, 1), F.lit("."), F.substring(bn, 2, 1))).otherwise(bn)
    d3 = p.where((k % 23 == 0) & (F.col("p_type") != "LARGE")).select(
        F.col("path3").alias("path"), F.concat(dotted, F.lit(", V"), bn).alias("codes"))
    return d4.unionByName(d3)


def fx_override(spark: SparkSession, d: str) -> DataFrame:
    """Manual (path, class) decisions for strings carrying two ICD-10 codes."""
    p = _part_paths(read(spark, d, "part"))
    k = F.col("p_partkey")
    return p.where((k % 4 == 0) & (F.col("p_brand") != "Brand#3") & (k % 40 == 4)).select(
        F.col("path4").alias("path"), (k % 18 + 1).cast("int").alias("class"))


# ----------------------------------------------------------------------------- events
def fx_event(spark: SparkSession, d: str) -> DataFrame:
    """events -> (event_id, id, ts, tab, code, value, uom)."""
    e = read(spark, d, "events")
    return e.select(
        "event_id", F.col("user_id").alias("id"), "ts",
        F.when(F.col("event_type").isin("view", "click"), F.lit("lab"))
         .when(F.col("event_type") == "purchase", F.lit("med"))
         .otherwise(F.lit("inf")).alias("tab"),
        F.col("event_type").alias("code"), "value",
        F.get_json_object("props", "$.k").alias("uom"))


def fx_event_stay(spark: SparkSession, d: str) -> DataFrame:
    """One 'stay' per event id: admission time = first event."""
    e = read(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("intime"))


def fx_lab(spark, d):
    e = fx_event(spark, d).where(F.col("tab") == "lab")
    return e.select("event_id", F.col("id").alias("SUBJ"), F.col("ts").alias("charttime"),
                    F.timestamp_add("MINUTE", F.lit(1), F.col("ts")).alias("storetime"),
                    (F.col("event_id") * 10).alias("row_id"),
                    F.col("code").alias("itemid"), F.col("value").alias("valuenum"),
                    F.col("uom").alias("valueuom"))


def fx_med(spark, d):
    e = fx_event(spark, d).where(F.col("tab") == "med")
    return e.select("event_id", F.col("id").alias("SUBJ"), F.col("ts").alias("starttime"),
                    F.timestamp_add("HOUR", F.lit(1), F.col("ts")).alias("stoptime"),
                    F.col("code").alias("drug"), F.col("value").alias("dose_val"),
                    F.col("uom").alias("dose_unit"),
                    F.when(F.col("value") > 25, F.lit("IV")).otherwise(F.lit("PO")).alias("route"))


def fx_inf(spark, d):
    e = fx_event(spark, d).where(F.col("tab") == "inf")
    return e.select("event_id", F.col("id").alias("SUBJ"), F.col("ts").alias("starttime"),
                    (F.col("event_id") * 10).alias("row_id"),
                    F.col("code").alias("itemid"), F.col("value").alias("rate"),
                    F.lit(None).cast("double").alias("amount"),
                    F.col("uom").alias("rateuom"))


def fx_item(spark: SparkSession, d: str) -> DataFrame:
    """Code dictionary (ITEMID -> LABEL) derived from the event types; 'error' has no entry."""
    e = read(spark, d, "events").select("event_type").distinct().where(F.col("event_type") != "error")
    return e.select(F.col("event_type").alias("ITEMID"),
                    F.concat(F.initcap("event_type"), F.lit(" event")).alias("LABEL"))


# ----------------------------------------------------------------------------- text
def fx_dose(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    q = F.floor("l_quantity").cast("bigint").cast("string")
    m = F.col("l_linenumber") % 6
    txt = (F.when(F.col("l_orderkey") % 50 == 0, F.lit(None).cast("string"))
           .when(F.col("l_orderkey") % 53 == 0, F.lit(""))
           .when(m == 0, F.lit("PRN"))
           .when(m == 1, F.concat(q, F.lit(" mg")))
           .when(m == 2, F.concat(q, F.lit("-"), (F.floor("l_quantity").cast("bigint") + 5).cast("string"), F.lit(" ml")))
           .when(m == 3, F.concat(F.lit("1,"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"), F.lit(" units")))
           .when(m == 4, F.concat(F.col("l_linenumber").cast("string"), F.lit(" "), q))
           .otherwise(F.concat(F.floor(F.col("l_tax") * 100).cast("bigint").cast("string"), F.lit(".5 g"))))
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), txt.alias("dosage"))


def fx_infusion(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    k = F.col("p_partkey")
    suffix = (F.when(k % 11 == 0, F.lit(" (a) (mcg/kg/min)"))
              .when(k % 13 == 0, F.lit(" (units"))
              .when(k % 4 == 0, F.lit(" (ml/hr)"))
              .when(k % 4 == 1, F.lit(" (Unknown)"))
              .when(k % 4 == 2, F.lit(""))
              .otherwise(F.lit(" 0.9")))
    return p.select(k.alias("id"), F.concat(F.col("p_name"), suffix).alias("drugname"))


def fx_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "text", "lang")


# ----------------------------------------------------------------------------- learning
def fx_score(spark: SparkSession, d: str) -> DataFrame:
    lb = read(spark, d, "labels")
    return lb.select(
        F.col("doc_id").alias("pid"), (F.col("doc_id") % 5).cast("string").alias("client"),
        F.col("toxic").cast("int").alias("y"),
        (((F.col("doc_id") * 7919) % 101) / F.lit(101.0)).alias("score"),
        F.floor(F.col("doc_id") / 64).alias("batch"))


def fx_feature(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return e.select(
        F.col("vec_id").alias("pid"), (F.col("vec_id") % 5).cast("string").alias("client"),
        F.transform("embedding", lambda v: v.cast("double")).alias("x"),
        F.when(F.col("label") < 5, F.lit(1)).otherwise(F.lit(0)).alias("y"))


def fx_param(spark: SparkSession, d: str) -> DataFrame:
    """Long parameter table (client, name, idx, value) for 5 clients and the server."""
    e = read(spark, d, "embeddings")
    x = e.select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    owners = F.explode(F.array(*[F.lit(i) for i in range(6)]))
    x = x.select("vec_id", "pos", "v", owners.alias("owner"))
    name = (F.when(F.col("pos") < 8, F.lit("norm.weight"))
            .when(F.col("pos") == 8, F.lit("batch.num_batches_tracked"))
            .otherwise(F.lit("enc.weight")))
    value = (F.when(F.col("pos") == 8, F.col("vec_id").cast("double"))
             .otherwise(F.col("v").cast("double") * (F.col("owner") + 1) / 5.0 + F.col("owner") * 0.01))
    return x.select(
        F.when(F.col("owner") == 5, F.lit("server")).otherwise(F.col("owner").cast("string")).alias("client"),
        name.alias("name"), (F.col("vec_id") * 64 + F.col("pos")).alias("idx"), value.alias("value"))


def fx_metric(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return (e.groupBy(F.col("event_type").alias("client"), (F.dayofyear("ts") - 1).alias("round"))
             .agg(F.round(F.avg("value"), 1).alias("auprc")))


def fx_multilabel(spark: SparkSession, d: str) -> DataFrame:
    """(pid, client, labels int[]) -- p_type classes per order, client = customer nation."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    p = read(spark, d, "part").select("p_partkey", "p_type")
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    cls = (F.when(F.col("p_type") == "ECONOMY", 1).when(F.col("p_type") == "LARGE", 2)
           .when(F.col("p_type") == "MEDIUM", 3).when(F.col("p_type") == "PROMO", 4)
           .when(F.col("p_type") == "SMALL", 5).otherwise(6))
    j = (li.join(p, li.l_partkey == p.p_partkey)
           .join(o, li.l_orderkey == o.o_orderkey)
           .join(c, o.o_custkey == c.c_custkey))
    return (j.groupBy(F.col("l_orderkey").alias("pid"), F.col("c_nationkey").cast("string").alias("client"))
             .agg(F.array_sort(F.collect_set(cls)).alias("labels")))
