import random

import pytest

from wardspark.operators import metrics as M


def ap_enumerate(scores, ys):
    """Average precision by direct enumeration over distinct thresholds (descending)."""
    pos = sum(ys)
    if pos == 0:
        return None
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(scores), reverse=True):
        sel = [y for s, y in zip(scores, ys) if s >= t]
        tp = sum(sel)
        r, p = tp / pos, tp / len(sel)
        ap += (r - prev_r) * p
        prev_r = r
    return ap


@pytest.mark.parametrize("seed", range(6))
def test_ap_matches_enumeration(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for c in ("a", "b", "c"):
        for i in range(rnd.randint(1, 60)):
            rows.append((c, round(rnd.random(), 1 if seed % 2 else 3), int(rnd.random() < 0.3)))
    df = spark.createDataFrame(rows, "client string, score double, y int")
    got = {r["client"]: r["auprc"] for r in M.average_precision(df, ["client"]).collect()}
    for c in {r[0] for r in rows}:
        exp = ap_enumerate([r[1] for r in rows if r[0] == c], [r[2] for r in rows if r[0] == c])
        if exp is None:
            assert got[c] is None
        else:
            assert got[c] == pytest.approx(exp, abs=1e-12)


def test_ap_edge_cases(spark):
    df = spark.createDataFrame([("ties", 0.5, 1), ("ties", 0.5, 0), ("none", 0.2, 0), ("one", 0.9, 1),
                                ("one", 0.1, 0)], "client string, score double, y int")
    got = {r["client"]: r["auprc"] for r in M.average_precision(df, ["client"]).collect()}
    assert got["ties"] == pytest.approx(0.5)
    assert got["none"] is None
    assert got["one"] == pytest.approx(1.0)


def early_stop_loop(scores, patience):
    best, counter, stopped, out = None, 0, False, []
    for s in scores:
        if best is None or s >= best:
            best, counter, improved = s, 0, True
        else:
            counter, improved = counter + 1, False
            stopped = stopped or counter >= patience
        out.append((improved, counter, stopped))
    return out


def test_early_stopping_matches_loop(spark):
    series = {"tie": [1, 2, 2, 2, 1, 1, 1], "latch": [5, 1, 1, 1, 6, 1, 1], "never": [1, 2, 3, 4, 5, 6, 7]}
    rows = [(c, r, float(v)) for c, vs in series.items() for r, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "client string, round int, auprc double")
    es = M.early_stopping(df, patience=3).collect()
    for c, vs in series.items():
        got = [(r["improved"], r["counter"], r["stopped"]) for r in sorted(es, key=lambda r: r["round"])
               if r["client"] == c]
        assert got == early_stop_loop(vs, 3)
    stops = M.global_stop(M.early_stopping(df, patience=3)).collect()[0][0]
    assert stops is None  # 'never' never stops
    best = {r["client"]: r["best_round"] for r in M.best_round(M.early_stopping(df, patience=3)).collect()}
    assert best == {"tie": 3, "latch": 4, "never": 6}


def test_bce_is_stable(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1000.0, 1), (-1000.0, 0), (0.0, 1)], "z double, y int")
    got = [r[0] for r in df.select(M.bce_with_logits(F.col("z"), F.col("y").cast("double"))).collect()]
    assert got[0] == pytest.approx(0.0) and got[1] == pytest.approx(0.0) and got[2] == pytest.approx(0.693147, 1e-5)
