"""Rank and running-sum helpers on more rows than a range sample holds, against plain windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardspark.operators import util as U

ROWS = 160_000


@pytest.fixture(scope="module")
def rows(spark):
    x = spark.range(ROWS).select(
        "id", F.when(F.col("id") % 50 == 7, None).when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 900).cast("string"))).alias("key"),
        F.xxhash64("id").alias("o"), (F.col("id") % 7).alias("v"), F.repeat(F.lit("x"), 20).alias("payload"))
    return x.repartition(6)


@pytest.mark.parametrize("reuse", ["true", "false"])
@pytest.mark.parametrize("parts", [2, 16, 200])
def test_helpers_equal_windows(spark, rows, parts, reuse):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        g = U.global_rank(rows, [F.col("o")], "r").select("id", "r", "payload")
        w = rows.select("id", F.row_number().over(Window.orderBy("o")).alias("e"))
        assert g.join(w, "id").where("r = e").count() == ROWS == g.count()
        s = U.running_sums(rows, ["key"], [F.col("o")], ["v"])
        w = rows.select("id", F.sum("v").over(Window.partitionBy("key").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)).alias("e"))
        assert s.join(w, "id").where("cum_v = e").count() == ROWS == s.count()
        r = U.rank_within(rows, ["key"], [F.col("o")], "r")
        w = rows.select("id", F.row_number().over(Window.partitionBy("key").orderBy("o")).alias("e"))
        assert r.join(w, "id").where("r = e").count() == ROWS == r.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.exchange.reuse", "true")


@pytest.mark.parametrize("parts", [2, 200])
def test_one_ordered_pass_equals_windows(spark, rows, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        x = rows.withColumn("o", F.when(F.col("id") % 11 != 0, F.col("o"))).withColumn("_pid", U.range_number(rows.withColumn("o", F.when(F.col("id") % 11 != 0, F.col("o"))), ["key", "o", "id"]))
        sizes = [r["count"] for r in x.groupBy("_pid").count().collect()]
        assert len(sizes) <= parts and max(sizes) < 3 * ROWS / parts  # a hot key and its nulls are split
        order = Window.partitionBy("key").orderBy("o", "id")
        want = x.select("id", F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("e"), F.lag("v").over(order).alias("p"))
        got = U.along_ranges(x, ["key"], [F.col("o"), F.col("id")], ["v"], ["v"])
        assert got.columns == ["id", "key", "o", "v", "payload", "cum_v", "prev_v"]
        assert got.join(want, "id").where("cum_v = e AND prev_v <=> p").count() == ROWS == got.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rank_by_hash_equals_a_window(spark, rows):
    got = U.rank_by_hash(rows, ["key"], F.md5(F.col("id").cast("string")), [F.col("id")], "r")
    w = Window.partitionBy("key")
    want = rows.select("id", F.row_number().over(w.orderBy(F.md5(F.col("id").cast("string")), "id")).alias("e"), F.count("id").over(w).alias("n"))
    assert got.join(want, "id").where("r = e AND r_n = n").count() == ROWS == got.count()


def test_order_and_gap_store_nothing_and_join_no_events(spark, monkeypatch):
    from wardspark.operators import events as V
    rows = [(i % 3 and 1 or i, (i * 7919) % 97, "AB"[i % 2], i, "payload") for i in range(3000)]
    df = spark.createDataFrame(rows, "ID int, TIME bigint, TABLE_NAME string, event_id int, text string")
    monkeypatch.setattr(U, "cut", lambda df: pytest.fail("a table was stored"))
    out = V.with_order(df, ["B", "A"])
    w = Window.partitionBy("ID").orderBy("TIME", F.col("TABLE_NAME").desc(), "event_id")
    want = df.select("event_id", F.row_number().over(w).alias("e"), F.coalesce(F.col("TIME") - F.lag("TIME").over(w), F.lit(0)).alias("g"))
    assert out.join(want, "event_id").where("`ORDER` = e AND time_gap = g").count() == 3000
    assert out._jdf.queryExecution().optimizedPlan().toString().count("text#") > 0
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1 and "ORDER" not in joins[0]


def test_interval_join_meets_by_bins(spark):
    import datetime as dt
    from wardspark.operators import events as V
    t0 = dt.datetime(2020, 1, 1)
    stays = [(1, t0 + dt.timedelta(days=i)) for i in range(300)] + [(2, t0), (3, None)]
    events = [(i, 1 if i % 2 else 2, t0 + dt.timedelta(minutes=17 * i)) for i in range(20_000)] + [(-1, 3, t0), (-2, 1, None)]
    s = spark.createDataFrame(stays, "id int, intime timestamp")
    e = spark.createDataFrame(events, "event_id int, ID int, TIME timestamp")
    for minutes, width in ((720, None), (720, 7), (2000, 300)):
        got = {(r.event_id, r.TIME) for r in V.window_absolute(e, s, minutes, width).collect()}
        want = {(i, int((t - x).total_seconds() // 60)) for i, p, t in events if t for q, x in stays if x and p == q and x < t < x + dt.timedelta(minutes=minutes)}
        assert got == want
    out = V.window_absolute(e, s, 720)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_bin" in next(line for line in plan.splitlines() if "Join Inner" in line)
    met = e.withColumn("_bin", F.floor(F.unix_timestamp("TIME") / 43200)).where("ID = 1").groupBy("_bin").count()
    assert met.count() > 200  # the hot patient's events lie in as many keys as there are bins


def test_counter_counts_checks_not_rounds(spark):
    from wardspark.operators.metrics import early_stopping
    m = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 0.5), ("a", 11, 0.4)], "client string, round int, auprc double")
    got = [(r["counter"], r["stopped"]) for r in early_stopping(m, patience=2).orderBy("round").collect()]
    assert got == [(0, False), (1, False), (2, True)]


def test_proximal_term_changes_the_model(spark):
    from wardspark.operators.fed import train
    f = spark.createDataFrame([("a", [1.0, 2.0], 1), ("a", [0.5, -1.0], 0), ("b", [-1.0, 0.3], 1), ("b", [2.0, 1.0], 0)], "client string, x array<double>, y int")
    a = {(r["client"], r["idx"]): r["value"] for r in train(f, 2, 2, local_steps=3).collect()}
    b = {(r["client"], r["idx"]): r["value"] for r in train(f, 2, 2, local_steps=3, algorithm="fedprox", mu=0.5).collect()}
    assert a.keys() == b.keys() and any(abs(a[k] - b[k]) > 1e-4 for k in a)
