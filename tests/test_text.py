import pytest
from pyspark.sql import functions as F

from wardspark.functions import text as T


def run(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [tuple(r) for r in df.select(*fn(F.col("v"))).collect()]


def test_dosage(spark):
    got = run(spark, ["1,000 mg", "5-10 ml", "2 500", "PRN", "", None, "3 mg/kg", "1 2 3"],
              lambda c: T.dosage_parts(c))
    assert got == [("1000.0", "mg"), ("10.0", "ml"), ("500.0", " "), (" ", "PRN"), (" ", " "), (" ", "nan"),
                   ("3.0", "mg/kg"), ("3.0", " ")]


def test_infusion(spark):
    got = run(spark, ["Drug (ml/hr)", "Drug (Unknown)", "Drug 0.9", "Drug (a) (mcg/min)", "Drug (units", "Plain"],
              lambda c: T.infusion_parts(c))
    assert got == [("Drug ", "(ml/hr)"), ("Drug ", " "), ("Drug 0.9 [UNK]", " "), ("Drug (a) ", "(mcg/min)"),
                   ("Drug ", " "), ("Plain", " ")]


@pytest.mark.parametrize("text,expected", [
    ("12.5mg", "1 2 . 5 mg"),
    ("take 1.0.2 now", "take 1 . 0 2 now"),
    ("a1b", "a 1 b"),
    ("mg12", "m g 1 2"),
    ("...", "."),
    ("e.g. words\tand\nlines", "e.g. words and lines"),
    ("  x  ", "x"),
])
def test_digit_split(spark, text, expected):
    assert run(spark, [text], lambda c: [T.digit_split_text(c)])[0][0] == expected


def test_round_digits(spark):
    got = run(spark, [6.55, 3.0, 0.0001, 2.123456, None], lambda c: [T.round_digits_double(c)], "double")
    assert [g[0] for g in got] == ["6 . 5 5", "3 . 0", "0 . 0 0 0 1", "2 . 1 2 3 5", " "]
    assert run(spark, [1234], lambda c: [T.round_digits_long(c)], "long")[0][0] == "1 2 3 4"


def test_cap_decimals(spark):
    df = spark.createDataFrame([(list("3.1415926"),), (list("2.5"),), (list("42"),)], "c array<string>")
    got = ["".join(r[0]) for r in df.select(T.cap_decimals(F.col("c"))).collect()]
    assert got == ["3.1415", "2.5", "42"]


def test_numeric_word(spark):
    got = run(spark, ["12", "1.2", "abc", "a1", "..", ""], lambda c: [T.is_numeric_word(c)])
    assert [g[0] for g in got] == [True, True, False, True, True, True]
