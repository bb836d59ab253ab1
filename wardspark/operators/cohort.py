"""Cohort construction and outcome labels.

Three input flavours share one set of expressions, driven by ``CohortSpec``:

* absolute  - admission/discharge/death timestamps (stay table with dob)
* relative  - minute offsets from unit admission, text ages, status strings
* anchored  - unit stays + admissions + patients with anchor year/age, joined inner

Every per-admission pick is an aggregate (``first_row_by``), never a window, so a hot
admission key is reduced map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.functions.clinical import (age_from_anchor, age_from_dob, age_from_text, flag,
                                          plus_hours)
from wardspark.operators.util import first_nonnull_by, first_row_by
from wardspark.spec import ABSOLUTE, ANCHORED, RELATIVE, CohortSpec

ICU_DEATH = "IN_ICU_MORTALITY"
HOSP_DEATH = "IN_HOSPITAL_MORTALITY"
NO_DISCHARGE = "No Discharge"


# ----------------------------------------------------------------------------- filters
def unit_filter(stays: DataFrame, spec: CohortSpec, first: str = "first_unit",
                last: str = "last_unit") -> DataFrame:
    """Same-unit stays (NULL never equals NULL) and the optional unit-type filter."""
    out = stays
    if spec.same_unit:
        out = out.where(F.col(first) == F.col(last))
    if spec.unit_type is not None:
        out = out.where(F.col(last) == spec.unit_type)
    return out


def adult_filter(stays: DataFrame, age: str, spec: CohortSpec) -> DataFrame:
    return stays.where(F.col(age) >= spec.min_age)


def base_absolute(stays: DataFrame, spec: CohortSpec = ABSOLUTE) -> DataFrame:
    s = unit_filter(stays, spec).withColumn("age", age_from_dob("intime", "dob"))
    return adult_filter(s, "age", spec)


def min_stay_absolute(df: DataFrame, spec: CohortSpec) -> DataFrame:
    return df.where(F.col("los") > F.lit(spec.min_los_days))


def min_stay_relative(df: DataFrame, spec: CohortSpec) -> DataFrame:
    return df.where(F.col("out_offset") > F.lit(spec.min_los_minutes))


# ----------------------------------------------------------------------------- aggregates
def readmission(stays: DataFrame, adm: str = "adm_id", stay: str = "stay_id") -> DataFrame:
    """One row per admission: number of unit stays and the readmission flag (> 1 stay)."""
    return (stays.groupBy(adm).agg(F.count(stay).alias("n_stays"))
                 .withColumn("readmission", (F.col("n_stays") > 1).cast("int")))


def first_stay_with_readmission(stays: DataFrame, cols: list[str], adm: str = "adm_id",
                                order: tuple[str, ...] = ("intime", "stay_id"), desc: bool = False,
                                stay: str = "stay_id") -> DataFrame:
    """First (or last) stay per admission and the readmission flag in ONE aggregate pass:
    ``min(struct(order..., cols...))`` and ``count`` combine map-side together."""
    fields = [F.col(o).alias(f"_o{i}") for i, o in enumerate(order)] + [F.col(c).alias(c) for c in cols]
    pick = (F.max if desc else F.min)(F.struct(*fields)).alias("_pick")
    g = stays.groupBy(adm).agg(pick, F.count(stay).alias("n_stays"))
    return g.select(adm, *[F.col(f"_pick.{c}").alias(c) for c in cols], "n_stays",
                    (F.col("n_stays") > 1).cast("int").alias("readmission"))


def first_stay(stays: DataFrame, cols: list[str], adm: str = "adm_id",
               order: tuple[str, ...] = ("intime", "stay_id"), desc: bool = False) -> DataFrame:
    """Whole row of the earliest (``desc``: latest) stay per admission; ties by stay id."""
    return first_row_by(stays, [adm], list(order), cols, desc=desc)


# ----------------------------------------------------------------------------- labels
def absolute_labels(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """mortality, in-unit mortality and stay-length labels from timestamps."""
    obs_end = plus_hours("intime", spec.obs_hours)
    horizon = plus_hours("intime", spec.obs_hours + spec.gap_hours + spec.pred_hours)
    d = F.col("deathtime")
    mort = (d >= obs_end) & (d <= horizon)
    if spec.mortality_out_bound:
        mort = mort & (d <= F.col("outtime"))
    icu = (d > F.col("intime")) & (d <= F.col("outtime"))
    los = F.col("los")
    l3, l7 = ((los >= 3.0), (los >= 7.0)) if spec.los_inclusive else ((los > 3.0), (los > 7.0))
    return df.select("*", flag(mort).alias("mortality"), flag(icu).alias("in_icu_mortality"),
                     flag(l3).alias("los_3day"), flag(l7).alias("los_7day"))


def relative_labels(df: DataFrame, spec: CohortSpec) -> DataFrame:
    off = F.col("out_offset")
    horizon = 60 * (spec.obs_hours + spec.gap_hours + spec.pred_hours)
    expired = F.col("status") == "Expired"
    mort = (off < horizon) & (off > 60 * spec.obs_hours) & expired
    days = off.cast("double") / F.lit(1440.0)
    return df.select("*", flag(mort).alias("mortality"), flag(expired).alias("in_icu_mortality"),
                     flag(days > 3.0).alias("los_3day"), flag(days > 7.0).alias("los_7day"))


def final_location(df: DataFrame, hosp_death: F.Column, loc: str = "disch_loc") -> DataFrame:
    """In-hospital mortality and the discharge location overwritten by the two death labels."""
    icu = F.col("in_icu_mortality") == 1
    hosp = flag(hosp_death & ~icu)
    out = df.withColumn("in_hospital_mortality", hosp)
    return out.withColumn("location", F.when(icu, F.lit(ICU_DEATH))
                          .when(F.col("in_hospital_mortality") == 1, F.lit(HOSP_DEATH))
                          .otherwise(F.col(loc)))


def imminent(df: DataFrame, discharged: F.Column) -> DataFrame:
    im = F.when(F.coalesce(discharged, F.lit(False)), F.col("location")).otherwise(F.lit(NO_DISCHARGE))
    im = F.when(im.isin(ICU_DEATH, HOSP_DEATH), F.lit(NO_DISCHARGE)).otherwise(im)
    return df.withColumn("imminent", im)


def coded(df: DataFrame) -> DataFrame:
    """Category codes of the final location and the imminent-discharge label. Both code
    tables come from one distinct pass over (location, imminent) - a few dozen rows."""
    from pyspark.sql import Window
    pairs = df.select("location", "imminent").distinct()
    codes = []
    for col, out in (("location", "final_acuity"), ("imminent", "imminent_discharge")):
        cats = pairs.select(F.col(col).alias("_v")).where(F.col("_v").isNotNull()).distinct()
        t = cats.select("_v", (F.row_number().over(Window.orderBy("_v")) - 1).cast("int").alias(out))
        codes.append((col, out, t))
    for col, out, t in codes:
        df = df.join(t, df[col].eqNullSafe(t["_v"]), "left").drop("_v") \
            .withColumn(out, F.coalesce(F.col(out), F.lit(-1)))
    return df


# ----------------------------------------------------------------------------- cohorts
STAY_COLS = ["stay_id", "intime", "outtime", "los", "deathtime", "disch_loc", "age",
             "subject_id", "dbsource", "hospital_id"]


def cohort_absolute(stays: DataFrame, spec: CohortSpec = ABSOLUTE, min_stay: bool = True) -> DataFrame:
    """Timestamp flavour: unit + adult filter -> readmission -> first stay -> labels -> min stay."""
    base = base_absolute(stays, spec)
    df = first_stay_with_readmission(base, [c for c in STAY_COLS if c in base.columns])
    df = absolute_labels(df, spec)
    if min_stay:
        df = min_stay_absolute(df, spec)
    df = final_location(df, F.col("disch_loc") == spec.death_location)
    horizon = spec.obs_hours + spec.pred_hours + (spec.gap_hours if spec.discharge_uses_gap else 0)
    df = imminent(df, F.col("outtime") <= plus_hours("intime", horizon))
    return coded(df)


def cohort_relative(stays: DataFrame, spec: CohortSpec = RELATIVE, min_stay: bool = True) -> DataFrame:
    """Offset flavour: codes are assigned before the minimum-stay filter."""
    s = stays
    if spec.unit_type is not None:
        s = s.where(F.col("last_unit") == spec.unit_type)
    s = adult_filter(s.withColumn("age", age_from_text("age_text")), "age", spec)
    cols = ["stay_id", "unit_offset", "out_offset", "status", "hosp_status", "disch_loc",
            "hospital_id", "age"]
    first = first_stay_with_readmission(s, cols, order=("unit_offset", "stay_id"), desc=True)
    df = relative_labels(first, spec)
    df = final_location(df, F.col("hosp_status") == "Expired")
    horizon = 60 * (spec.obs_hours + spec.gap_hours + spec.pred_hours)
    df = imminent(df, F.col("out_offset") < horizon)
    df = coded(df)
    return min_stay_relative(df, spec) if min_stay else df


def cohort_anchored(icu: DataFrame, adm: DataFrame, patients: DataFrame,
                    spec: CohortSpec = ANCHORED) -> DataFrame:
    """Anchor-age flavour: stay filter first, inner joins, readmission after the filters and
    pandas ``groupby().first()`` semantics for the first stay (first non-null per column)."""
    t = icu.where(F.col("los") > F.lit(spec.min_los_days))
    deaths = first_nonnull_by(adm, ["adm_id"], F.col("deathtime"), ["deathtime"])
    t = t.join(deaths, "adm_id").join(patients, "subject_id")
    t = adult_filter(t.withColumn("age", age_from_anchor("intime", "anchor_year", "anchor_age")), "age", spec)
    readm = readmission(t)
    t = t.join(readm.select("adm_id", "readmission"), "adm_id")
    first = first_nonnull_by(t, ["adm_id"], F.struct("intime", "stay_id"),
                             ["stay_id", "intime", "outtime", "los", "deathtime", "age", "readmission"])
    locs = first_row_by(adm, ["adm_id"], ["adm_id"], ["disch_loc"])
    df = absolute_labels(first.join(locs, "adm_id", "left"), spec)
    df = final_location(df, F.col("disch_loc") == spec.death_location)
    horizon = spec.obs_hours + spec.gap_hours + spec.pred_hours
    df = imminent(df, F.col("outtime") <= plus_hours("intime", horizon))
    return coded(df)


def obs_marks(stays: DataFrame) -> DataFrame:
    return stays.select("stay_id", plus_hours("intime", 12).alias("obs_12h"),
                        plus_hours("intime", 24).alias("obs_24h"))


LABEL_COLS = ["readmission", "mortality", "los_3day", "los_7day", "final_acuity", "imminent_discharge"]
