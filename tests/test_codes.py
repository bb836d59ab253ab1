from collections import Counter

from pyspark.sql import functions as F

from wardspark.operators import codes as K


def brute_fallback(code, gem):
    for n in range(len(code), 0, -1):
        pre = code[:n]
        rows = [g9 for g10, g9 in gem if pre in g10]
        if rows:
            c = Counter(rows)
            top = max(c.values())
            return min(k for k, v in c.items() if v == top)
    return None


def test_prefix_fallback_matches_brute_force(spark):
    gem = [("A0101", "1"), ("A0102", "2"), ("A0201", "2"), ("B0101", "3"), ("XA01", "1"), ("A0101", "1"),
           ("C11", "4"), ("C12", "5"), ("C13", "5")]
    codes = ["A0109", "A0301", "B0999", "C19", "Z99", "A01"]
    g = spark.createDataFrame(gem, "icd10 string, icd9 string")
    c = spark.createDataFrame([(x,) for x in codes], "code string")
    got = {r["code"]: r["icd9"] for r in K.prefix_fallback(c, g).collect()}
    exp = {x: brute_fallback(x, gem) for x in codes}
    assert got == {k: v for k, v in exp.items() if v is not None}


def test_icd_convert_versions(spark):
    gem = spark.createDataFrame([("K00001", "11")], "icd10 string, icd9 string")
    dx = spark.createDataFrame([(1, 9, "250"), (1, 10, "K00001"), (2, 10, "K00009"), (3, 10, "Q")],
                               "stay_id long, ver int, code string")
    got = {(r["stay_id"], r["code"]): r["converted"] for r in K.icd_convert(dx, gem).collect()}
    assert got == {(1, "250"): "250", (1, "K00001"): "11", (2, "K00009"): "11", (3, "Q"): None}


def test_path_cascade_steps(spark):
    ccs = spark.createDataFrame([("1", 1), ("2", 2), ("3", 3)], "code string, class int")
    gem = spark.createDataFrame([("K9", "3")], "icd10 string, icd9 string")
    known = spark.createDataFrame([
        ("a|b|c", "1"), ("a|b|d", "2"), ("x|y", "K9"), ("m|n", "K1, K2"), ("p|q|r", "2"), ("p|q|s", "2"),
        ("u|v|w|z", "3"), ("u|v|w|t", "3"), ("u|k", "1")], "path string, codes string")
    over = spark.createDataFrame([("m|n", 7)], "path string, class int")
    wanted = spark.createDataFrame([(p,) for p in ["a|b|c", "x|y", "m|n", "a|b|c|e", "p|q", "p|q|new",
                                                   "a|b|zz", "u|v|w|z|deep|er", "nothing"]], "path string")
    res = {r["path"]: (r["class"], r["resolved_by"]) for r in
           K.resolve_paths(wanted, known, ccs, gem, over).collect()}
    assert res["a|b|c"] == (1, "direct")
    assert res["x|y"] == (3, "icd10")
    assert res["m|n"] == (7, "override")
    assert res["a|b|c|e"] == (1, "parent")
    assert res["p|q"] == (2, "descendants")
    assert res["p|q|new"] == (2, "siblings")
    assert res["a|b|zz"][1] == "ancestor_mode"     # siblings a|b|c, a|b|d disagree
    assert res["nothing"][1] == "ancestor_mode"    # short path: empty prefix = global mode


def test_class_sets_and_multi_hot(spark):
    ccs = spark.createDataFrame([("1", 3), ("2", 1)], "code string, class int")
    dx = spark.createDataFrame([(1, "1"), (1, "2"), (1, "1"), (1, "9")], "stay_id long, code string")
    s = K.class_sets(dx, ccs).collect()[0]
    assert s["classes"] == [1, 3]
    mh = spark.createDataFrame([([1, 3],)], "c array<int>").select(K.multi_hot(F.col("c"), 4)).collect()[0][0]
    assert mh == [1, 0, 1, 0]
