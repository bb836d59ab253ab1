import random

import pytest
import math

from pyspark.sql import functions as F

from wardspark.operators import folds as K


def labels(spark, sizes):
    rows, pid = [], 0
    for label, n in sizes.items():
        for _ in range(n):
            rows.append((pid, label, label, label, label, [label + 1]))
            pid += 1
    return spark.createDataFrame(rows, "pid long, mort int, los3 int, los7 int, readm int, dx array<int>")


def test_random_folds_exact_counts(spark):
    lab = labels(spark, {0: 37})
    f = K.random_folds(lab, seeds=(2020,)).groupBy("fold").count().collect()
    got = {r["fold"]: r["count"] for r in f}
    t = math.ceil(37 / 10)
    v = math.ceil((37 - t) / 9)
    assert got == {0: t, 2: v, 1: 37 - t - v}


def test_stratified_quota_per_class(spark):
    sizes = {0: 1, 1: 9, 2: 10, 3: 11}
    lab = labels(spark, sizes)
    f = K.stratified_folds(lab, tasks=("mort",), seeds=(2021,))
    rows = f.collect()
    assert len({r["pid"] for r in rows}) == sum(sizes.values())          # exhaustive
    assert len(rows) == sum(sizes.values())                              # disjoint: one fold per pid
    for label, n in sizes.items():
        cnt = {k: sum(1 for r in rows if r["label"] == label and r["fold"] == k) for k in (0, 1, 2)}
        t = math.ceil(n / 10)
        v = math.ceil((n - t) / 9)
        assert cnt == {0: t, 2: v, 1: n - t - v}


def test_seeds_differ_and_are_reproducible(spark):
    lab = labels(spark, {0: 50})
    a = {(r["pid"], r["seed"]): r["fold"] for r in K.random_folds(lab, seeds=(2020, 2021)).collect()}
    b = {(r["pid"], r["seed"]): r["fold"] for r in K.random_folds(lab, seeds=(2020, 2021)).collect()}
    assert a == b
    assert [a[(p, 2020)] for p in range(50)] != [a[(p, 2021)] for p in range(50)]


def test_grid_matches_individual_splits(spark):
    lab = labels(spark, {0: 20, 1: 13})
    grid = {(r["pid"], r["task"], r["seed"]): r["fold"] for r in K.fold_grid(lab, seeds=(2022,)).collect()}
    strat = {(r["pid"], r["task"], r["seed"]): r["fold"] for r in K.stratified_folds(lab, seeds=(2022,)).collect()}
    rand = {(r["pid"], "all", r["seed"]): r["fold"] for r in K.random_folds(lab, seeds=(2022,)).collect()}
    ml = {(r["pid"], "dx", r["seed"]): r["fold"] for r in K.multilabel_folds(lab, seeds=(2022,)).collect()}
    assert grid == {**strat, **rand, **ml}


def test_ratio_subset_is_deterministic(spark):
    df = spark.range(1000).withColumnRenamed("id", "pid")
    a = K.ratio_subset(df, 10).count()
    assert 50 < a < 150 and a == K.ratio_subset(df, 10).count()
    assert K.ratio_subset(df, 100).count() == 1000


def test_multilabel_shares_stay_near_the_whole(spark):
    """Every class keeps its share in every fold, within two points and four standard errors."""
    import numpy as np
    rng = np.random.default_rng(11)
    odds = [.5, .3, .2, .1, .05]
    rows = [(i, [c + 1 for c, p in enumerate(odds) if rng.random() < p]) for i in range(4000)]
    lab = spark.createDataFrame(rows, "pid long, dx array<int>")
    out = {r["pid"]: r["fold"] for r in K.multilabel_folds(lab, seeds=(2020,)).collect()}
    assert len(out) == len(rows)
    for c in range(1, 6):
        whole = sum(c in dx for _, dx in rows) / len(rows)
        for fold in (K.TEST, K.TRAIN, K.VALID):
            mine = [dx for i, dx in rows if out[i] == fold]
            share = sum(c in dx for dx in mine) / len(mine)
            assert abs(share - whole) <= .02 + 4 * math.sqrt(whole * (1 - whole) / len(mine))


def _worst(rows, folds):
    """Largest distance, in rows, of any class's test and validation rows from a tenth of the class."""
    worst = 0
    for c in {c for _, dx in rows for c in dx}:
        n = sum(c in dx for _, dx in rows)
        for fold in (K.TEST, K.VALID):
            worst = max(worst, abs(sum(c in dx and folds[p] == fold for p, dx in rows) - n / 10))
    return worst


def test_iterative_stratification_meets_every_class(spark):
    rng = random.Random(8)
    share = [0.5, 0.3, 0.2, 0.1, 0.05, 0.02, 0.01, 0.004]
    rows = [(i, sorted(c + 1 for c, s in enumerate(share) if rng.random() < s)) for i in range(6000)]
    lab = spark.createDataFrame(rows, "pid int, dx array<int>").repartition(4)
    out = K.multilabel_folds(lab, seeds=(1, 2)).collect()
    again = K.multilabel_folds(lab.repartition(2), seeds=(1, 2)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again)) and len(out) == 12000
    stand_in = {}  # stratified by the rarest class alone
    groups = {}
    for p, dx in rows:
        groups.setdefault(max(dx, default=0), []).append(p)
    for g in groups.values():
        for r, p in enumerate(g):
            stand_in[p] = K.TEST if r < -(-len(g) // 10) else K.VALID if r < 2 * -(-len(g) // 10) else K.TRAIN
    for seed in (1, 2):
        folds = {r["pid"]: r["fold"] for r in out if r["seed"] == seed}
        assert _worst(rows, folds) <= 2 < _worst(rows, stand_in)
        sizes = [sum(f == x for f in folds.values()) for x in (K.TEST, K.VALID)]
        assert all(abs(n - 600) <= 4 for n in sizes)
    assert {r["pid"] for r in out if r["seed"] == 1 and r["fold"] == K.TEST} != {r["pid"] for r in out if r["seed"] == 2 and r["fold"] == K.TEST}


def test_iterative_stratification_per_client_and_of_few_rows(spark):
    rows = [(i, "a" if i % 3 else "b", [1, 2] if i % 5 == 0 else [2] if i % 2 else []) for i in range(300)] + [(900, None, [18])]
    lab = spark.createDataFrame(rows, "pid int, client string, dx array<int>")
    out = K.multilabel_folds(lab, seeds=(7,), group=["client"]).collect()
    assert len(out) == 301
    for client in "ab":
        mine = [(p, dx) for p, c, dx in rows if c == client]
        folds = {r["pid"]: r["fold"] for r in out if r["client"] == client}
        assert _worst(mine, folds) <= 2
    assert K.multilabel_folds(lab.limit(0)).count() == 0
    many = spark.createDataFrame([(i, [i]) for i in range(30)], "pid int, dx array<int>")
    with pytest.raises(ValueError):
        K.multilabel_folds(many)


def test_grid_takes_a_digest_a_pid_and_seed(spark):
    """The digest is taken before the tasks are dealt out, and sorted as bytes."""
    rows = [(i, i % 2, i % 3 > 0, i % 5 > 0, i % 7 > 0, [i % 4 + 1]) for i in range(60)]
    lab = spark.createDataFrame([(i, a, int(b), int(c), int(d), x) for i, a, b, c, d, x in rows], "pid long, mort int, los3 int, los7 int, readm int, dx array<int>")
    grid = K.fold_grid(lab, seeds=(1, 2))
    plan = grid.where("task <> 'dx'")._jdf.queryExecution().analyzed().toString()
    assert "unhex" in plan and plan.rindex("md5") > plan.index("inline")
    got = {(r.pid, r.task, r.seed): r.fold for r in grid.collect()}
    want = {(r.pid, r.task, r.seed): r.fold for r in K.stratified_folds(lab, seeds=(1, 2)).collect()}
    want |= {(r.pid, "all", r.seed): r.fold for r in K.random_folds(lab, seeds=(1, 2)).collect()}
    assert {k: v for k, v in got.items() if k[1] != "dx"} == want
