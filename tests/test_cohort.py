import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F

from wardspark.functions.clinical import age_from_dob, age_from_text
from wardspark.operators import cohort as C
from wardspark.operators.util import category_codes, first_nonnull_by, first_row_by
from wardspark.spec import ABSOLUTE, ANCHORED

T0 = dt.datetime(2020, 1, 1, 0, 0)
H = dt.timedelta(hours=1)


def test_age_boundary_and_text(spark):
    rows = [(dt.datetime(2018, 1, 1), dt.date(2000, 1, 6)), (dt.datetime(2018, 1, 1), dt.date(2000, 1, 5)),
            (dt.datetime(2018, 1, 1), dt.date(2018, 1, 2))]
    df = spark.createDataFrame(rows, "intime timestamp_ntz, dob date")
    # 18*365 days = 6570: 2000-01-06 -> 6570 days -> 18; 2000-01-05 -> 6571 -> 18; future dob -> -1 (floor)
    got = [r[0] for r in df.select(age_from_dob("intime", "dob")).collect()]
    assert got == [18, 18, -1]
    t = spark.createDataFrame([("> 89",), (None,), ("42",)], "a string")
    assert [r[0] for r in t.select(age_from_text("a")).collect()] == [89, 1, 42]


def test_mortality_bounds(spark):
    out = T0 + 100 * H
    deaths = [T0, T0 + 12 * H, T0 + 72 * H, T0 + 73 * H, out, None]
    rows = [(i, T0, out, 4.0, d) for i, d in enumerate(deaths)]
    df = spark.createDataFrame(rows, "stay_id long, intime timestamp_ntz, outtime timestamp_ntz, los double, "
                                     "deathtime timestamp_ntz")
    got = {r["stay_id"]: (r["mortality"], r["in_icu_mortality"]) for r in C.absolute_labels(df, ABSOLUTE).collect()}
    assert got == {0: (0, 0), 1: (1, 1), 2: (1, 1), 3: (0, 1), 4: (0, 1), 5: (0, 0)}


def test_stay_length_variants(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 7.0), (3, 7.5)], "stay_id long, los double")
    df = df.select("*", F.lit(None).cast("timestamp_ntz").alias("deathtime"), F.lit(T0).alias("intime"),
                   F.lit(T0).alias("outtime"))
    strict = {r["stay_id"]: (r["los_3day"], r["los_7day"]) for r in C.absolute_labels(df, ABSOLUTE).collect()}
    incl = {r["stay_id"]: (r["los_3day"], r["los_7day"]) for r in C.absolute_labels(df, ANCHORED).collect()}
    assert strict == {1: (0, 0), 2: (1, 0), 3: (1, 1)}
    assert incl == {1: (1, 0), 2: (1, 1), 3: (1, 1)}


def test_category_codes_null_is_minus_one(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "k int, loc string")
    out, codes = category_codes(df, "loc", "code")
    assert {r["k"]: r["code"] for r in out.collect()} == {1: 1, 2: -1, 3: 0, 4: 1}
    assert sorted(tuple(r) for r in codes.collect()) == [("a", 0), ("b", 1)]


def test_first_row_and_first_nonnull(spark):
    rows = [(1, 2, "x", None), (1, 1, None, "p"), (1, 3, "z", "q"), (2, 5, "w", None)]
    df = spark.createDataFrame(rows, "g int, o int, a string, b string")
    whole = {r["g"]: (r["a"], r["b"]) for r in first_row_by(df, ["g"], ["o"], ["a", "b"]).collect()}
    mixed = {r["g"]: (r["a"], r["b"]) for r in first_nonnull_by(df, ["g"], "o", ["a", "b"]).collect()}
    assert whole == {1: (None, "p"), 2: ("w", None)}
    assert mixed == {1: ("x", "p"), 2: ("w", None)}


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["stay_id", "adm_id", "readmission", "mortality", "los_3day", "los_7day", "final_acuity",
                          "imminent_discharge"]


def test_unit_settings_change_the_cohort(spark):
    s = spark.createDataFrame([(1, "A", "A"), (2, "A", "B"), (3, "B", "B"), (4, None, None)], "stay_id long, first_unit string, last_unit string")
    ids = lambda **kw: sorted(r["stay_id"] for r in C.unit_filter(s, replace(ABSOLUTE, **kw)).collect())
    assert ids() == [1, 3]
    assert ids(same_unit=False) == [1, 2, 3, 4]
    assert ids(unit_type="B") == [3]
    assert ids(same_unit=False, unit_type="B") == [2, 3]
