"""Reproducible train/valid/test splits.

Contract (the reference draws membership from numpy/sklearn generators, so membership
itself is not reproducible; counts and balance are): inside each stratum, rows are ranked
by md5(pid || '_' || seed); the first ceil(n/10) are test (0), the next ceil((n - test)/9)
are valid (2), the rest train (1).

Scale: the digest is uniform, so it is cut into equal cells by an expression; ranks are taken inside
(stratum, cell) and shifted by the counts of earlier cells. Nothing is stored, and a class holding half of
all rows is still spread over every task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspark.operators.util import hash_bucket, rank_by_hash

TEST, TRAIN, VALID = 0, 1, 2
SEEDS = (2020, 2021, 2022, 2023, 2024)
BINARY_TASKS = ("mort", "los3", "los7", "readm")


def split_key(pid: Column, seed: Column) -> Column:
    return F.md5(F.concat(pid.cast("string"), F.lit("_"), seed.cast("string")))


def rank_in_strata(df: DataFrame, strata: Sequence[str], key: Column, pid: str) -> DataFrame:
    """Adds ``_r`` (1-based rank inside the stratum) and ``_n`` (stratum size)."""
    return rank_by_hash(df, list(strata), key, [F.col(pid)], "_r").withColumnRenamed("_r_n", "_n")


def fold_of(r: Column, n: Column, test_split: int = 10, val_split: int = 9) -> Column:
    t = F.ceil(n / F.lit(test_split))
    v = F.ceil((n - t) / F.lit(val_split))
    return F.when(r <= t, F.lit(TEST)).when(r <= t + v, F.lit(VALID)).otherwise(F.lit(TRAIN)).cast("int")


def assign(df: DataFrame, pid: str, strata: Sequence[str], seed: str = "seed") -> DataFrame:
    x = rank_in_strata(df, [*strata], split_key(F.col(pid), F.col(seed)), pid)
    return x.withColumn("fold", fold_of(F.col("_r"), F.col("_n"))).drop("_r", "_n")


def with_seeds(df: DataFrame, seeds: Sequence[int] = SEEDS) -> DataFrame:
    return df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))


def random_folds(labels: DataFrame, pid: str = "pid", seeds: Sequence[int] = SEEDS,
                 group: Sequence[str] = ()) -> DataFrame:
    x = with_seeds(labels.select(pid, *group), seeds)
    return assign(x, pid, [*group, "seed"])


def stratified_folds(labels: DataFrame, tasks: Sequence[str] = BINARY_TASKS, pid: str = "pid",
                     seeds: Sequence[int] = SEEDS, group: Sequence[str] = ()) -> DataFrame:
    """Long (pid, [group], task, seed, label, fold) for every binary task x seed in one pass."""
    stack = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).cast("int").alias("label"))
                                for t in tasks]))
    x = with_seeds(labels.select(pid, *group, stack.alias("_t")), seeds)
    x = x.select(pid, *group, "seed", "_t.task", "_t.label")
    return assign(x, pid, [*group, "task", "seed", "label"])


MAX_CLASSES = 18   # label sets are counted on the driver: at most 2 ** MAX_CLASSES of them a group


def label_set(col: str) -> Column:
    """A row's set of classes as text, the stratum of multi-label splits."""
    return F.array_join(F.array_sort(F.array_distinct(F.col(col))), ",")


def iterative_counts(sets: dict[str, int], parts: int) -> dict[str, int]:
    """How many rows of each label set go into one of ``parts`` equal folds.

    Iterative stratification on counts: again and again the class with the fewest rows left (ties: the smaller class)
    is dealt. Of its rows, laid out by label set, every so many-th goes into the fold, at the rate that still meets the
    class's demand, total / parts less what earlier classes have put there. Rows without a class come last and meet
    the demand in rows. Demands are kept in ``parts``-ths, so everything is integer.
    """
    labels = {s: {int(x) for x in s.split(",") if x} for s in sets}
    total: dict[int, int] = {}
    for s, n in sets.items():
        for c in labels[s]:
            total[c] = total.get(c, 0) + n
    given: dict[str, int] = {}

    def deal(mine: list[str], demand: int) -> None:
        rows = sum(sets[s] for s in mine)
        demand, before = min(max(demand, 0), parts * rows), 0
        for s in sorted(mine):
            given[s] = (before + sets[s]) * demand // (parts * rows) - before * demand // (parts * rows)
            before += sets[s]

    while True:
        left: dict[int, int] = {}
        for s in sets.keys() - given.keys():
            for c in labels[s]:
                left[c] = left.get(c, 0) + sets[s]
        if not left:
            break
        pick = min(left, key=lambda c: (left[c], c))
        deal([s for s in sets.keys() - given.keys() if pick in labels[s]], total[pick] - parts * sum(n for s, n in given.items() if pick in labels[s]))
    if rest := [s for s in sets if s not in given and sets[s]]:
        deal(rest, sum(sets.values()) - parts * sum(given.values()))
    return {s: given.get(s, 0) for s in sets}


def iterative_quotas(rows: DataFrame, group: Sequence[str] = (), test_split: int = 10, val_split: int = 9) -> DataFrame:
    """(group..., stratum) rows -> (group..., stratum, n_test, n_valid); what reaches the driver is one count for each
    label set of a group, bounded by 2 ** MAX_CLASSES."""
    spark = rows.sparkSession
    classes = rows.select(F.explode(F.split("stratum", ",")).alias("c")).where("c != ''").agg(F.count_distinct("c")).first()[0]
    if classes > MAX_CLASSES:
        raise ValueError(f"{classes} classes; label sets are counted for {MAX_CLASSES} at most")
    counts: dict[tuple, dict[str, int]] = {}
    for r in rows.groupBy(*group, "stratum").count().collect():
        counts.setdefault(tuple(r[:-2]), {})[r["stratum"]] = r["count"]
    out = []
    for g, sets in sorted(counts.items(), key=str):
        test = iterative_counts(sets, test_split)
        valid = iterative_counts({s: n - test[s] for s, n in sets.items()}, val_split)
        out += [(*g, s, test[s], valid[s]) for s in sorted(sets)]
    schema = [*[f"{c} {rows.schema[c].dataType.simpleString()}" for c in group], "stratum string", "n_test bigint", "n_valid bigint"]
    return spark.createDataFrame(out, ", ".join(schema))


def _quota_folds(x: DataFrame, quotas: DataFrame, pid: str, group: Sequence[str] = ()) -> DataFrame:
    """Folds of rows (pid, group..., stratum, seed): inside a label set the first ranks are test, the next valid."""
    x = rank_in_strata(x, [*group, "stratum", "seed"], split_key(F.col(pid), F.col("seed")), pid)
    q = quotas.select(*[F.col(c).alias(f"_q{i}") for i, c in enumerate([*group, "stratum"])], "n_test", "n_valid")
    x = x.join(q, [x[c].eqNullSafe(F.col(f"_q{i}")) for i, c in enumerate([*group, "stratum"])])
    fold = F.when(F.col("_r") <= F.col("n_test"), F.lit(TEST)).when(F.col("_r") <= F.col("n_test") + F.col("n_valid"), F.lit(VALID)).otherwise(F.lit(TRAIN))
    return x.withColumn("fold", fold.cast("int")).drop("_r", "_n", "n_test", "n_valid", *[f"_q{i}" for i in range(len(group) + 1)])


def multilabel_folds(labels: DataFrame, pid: str = "pid", col: str = "dx", seeds: Sequence[int] = SEEDS,
                     group: Sequence[str] = ()) -> DataFrame:
    """Iterative multi-label stratification: (pid, [group], stratum, seed, fold). Counts of label sets are dealt to the
    folds class by class; the seed only chooses the rows. Every class's share of a fold is within one row of its
    demand, or as near as the label sets that hold it allow."""
    x = labels.select(pid, *group, label_set(col).alias("stratum"))
    return _quota_folds(with_seeds(x, seeds), iterative_quotas(x, group), pid, group)


def fold_grid(labels: DataFrame, pid: str = "pid", seeds: Sequence[int] = SEEDS,
              group: Sequence[str] = ()) -> DataFrame:
    """Long fold table (pid, [group], task, seed, scheme, fold): stratified per binary task and random for 'all', ranked
    in one pass over the union; dx iteratively stratified."""
    # a row's digest is that of its pid and seed: taken before the tasks are dealt out, which go by number till the end
    x = with_seeds(labels.select(pid, *group, *BINARY_TASKS), seeds).withColumn("_key", split_key(F.col(pid), F.col("seed")))
    items = [F.struct(F.lit(i).alias("_task"), F.col(t).cast("int").alias("_st")) for i, t in enumerate(BINARY_TASKS)]
    items += [F.struct(F.lit(len(BINARY_TASKS)).alias("_task"), F.lit(0).alias("_st"))]
    x = x.select(pid, *group, "seed", "_key", F.inline(F.array(*items)))
    x = rank_in_strata(x, [*group, "_task", "seed", "_st"], F.col("_key"), pid)
    name = F.element_at(F.array(*[F.lit(t) for t in (*BINARY_TASKS, "all")]), F.col("_task") + 1)
    x = x.select(pid, *group, "seed", name.alias("task"), F.when(F.col("_task") < len(BINARY_TASKS), F.lit("strat")).otherwise(F.lit("rand")).alias("scheme"),
                 fold_of(F.col("_r"), F.col("_n")).alias("fold"))
    dx = multilabel_folds(labels, pid, "dx", seeds, group).drop("stratum").withColumns({"task": F.lit("dx"), "scheme": F.lit("strat")})
    return x.unionByName(dx)


def label_share(folds: DataFrame) -> DataFrame:
    """Share (%) of each (label, fold) cell within its task x seed."""
    c = folds.groupBy("task", "seed", "label", "fold").agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy("task", "seed"))
    return c.withColumn("pct", F.round(F.col("n") * 100.0 / tot, 6))


def select_fold(labels: DataFrame, folds: DataFrame, fold: int, pid: str = "pid") -> DataFrame:
    return labels.join(folds.where(F.col("fold") == fold).select(pid), pid, "left_semi")


def ratio_subset(df: DataFrame, ratio_pct: int, pid: str = "pid") -> DataFrame:
    """Deterministic ``ratio_pct`` % of the rows (training-ratio experiments)."""
    if ratio_pct >= 100:
        return df
    return df.where(hash_bucket(F.col(pid), 100) < ratio_pct)
