import os
import tempfile

import pytest
from pyspark.sql import functions as F

from wardspark.sources import io
from wardspark.sources import stage as S
from wardspark.sources.stage import config_hash


def test_stage_is_built_once_per_config(spark):
    root = tempfile.mkdtemp(prefix="wardspark-stage-")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5).withColumnRenamed("id", "pid")

    a = io.stage(spark, root, "labels", {"gap": 12}, build)
    b = io.stage(spark, root, "labels", {"gap": 12}, build)
    c = io.stage(spark, root, "labels", {"gap": 2}, build)
    assert a.count() == b.count() == c.count() == 5
    assert len(calls) == 2
    assert sorted(os.listdir(root)) == sorted([f"labels-{config_hash({'gap': 12})}", f"labels-{config_hash({'gap': 2})}"])


def test_stage_manifest(spark):
    root, src = tempfile.mkdtemp(prefix="wardspark-stage-"), tempfile.mkdtemp(prefix="wardspark-in-") + "/t"
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(src)

    def get(gap=1):
        return sorted(r["id"] for r in io.stage(spark, root, "x", {"gap": gap}, build, inputs=[src]).collect())

    spark.range(3).write.parquet(src)
    home = f"{root}/x-{config_hash({'gap': 1})}"
    os.makedirs(f"{home}/data-killed")   # a write that was killed: data without a manifest
    with open(f"{home}/data-killed/part-0.parquet", "w") as f:
        f.write("half a file")
    assert get() == get() == [0, 1, 2] and len(calls) == 1
    assert len(os.listdir(home)) == len([x for x in os.listdir(home) if "killed" not in x])
    spark.range(5).write.mode("overwrite").parquet(src)   # changed input is built anew
    assert get() == [0, 1, 2, 3, 4] and len(calls) == 2
    kept = [x for x in os.listdir(home) if x.startswith("data-")]
    assert len(kept) == 1 and S.read_manifest(spark, home)["data"] == kept[0]

    def fails():
        raise OSError("killed")

    spark.range(7).write.mode("overwrite").parquet(src)
    with pytest.raises(OSError):
        io.stage(spark, root, "x", {"gap": 1}, fails, inputs=[src])
    assert get() == list(range(7)) and len(calls) == 3 and get(2) == list(range(7)) and len(calls) == 4


def test_owner_leaves_nothing(spark):
    from wardspark.plans import catalog
    keep = S.store(spark.range(4), "outer")
    before = {*S.children(spark, S.session_dir(spark)), *S.children(spark, spark.sparkContext.getCheckpointDir() or S.ensure_checkpoint_dir(spark))}
    for name in ("fold_random", "event_order", "vocab_encode", "round_resume"):
        with S.owned(spark):
            assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
        assert {*S.children(spark, S.session_dir(spark)), *S.children(spark, spark.sparkContext.getCheckpointDir())} == before, name
    with pytest.raises(ValueError), S.owned(spark):
        S.store(spark.range(4), "inner")
        raise ValueError
    assert len(S.children(spark, S.session_dir(spark))) == len([x for x in before if "wardspark-" in x.rsplit("/", 2)[-2]])
    assert keep.count() == 4
    assert not [x for x in S.children(spark, S.shared_dir(spark)) if "fed_rounds" in x]


def test_one_sample_opens_one_row_group(spark):
    path = tempfile.mkdtemp(prefix="wardspark-sink-") + "/seq"
    df = spark.range(60_000).select(F.col("id").alias("pid"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 5)).alias("client"),
                                    F.sha2(F.col("id").cast("string"), 256).alias("code"), F.xxhash64("id").alias("v")).repartition(5)
    io.write_partitioned(df, path, "client", "pid", files=8, group_bytes=64 << 10)
    import pyarrow.parquet as pq
    files = [os.path.join(d, f) for d, _, names in os.walk(path + "/client=hot") for f in names if f.endswith(".parquet")]
    groups = [pq.ParquetFile(f).metadata.row_group(g).num_rows for f in files for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    one = io.read_sample(spark, path, "client", "hot", "pid", 31_416)
    assert [r["pid"] for r in one.collect()] == [31_416]
    scan = one._jdf.queryExecution().executedPlan().collectLeaves().head()
    read = scan.metrics().get("numOutputRows").get().value()
    assert sum(groups) == 30_000 and len(groups) > 8 and 1 <= read <= max(groups) < 8_000
    gone = io.read_sample(spark, path, "client", "hot", "pid", 31_417)
    assert gone.count() == 0


def test_csv_with_a_bad_row_fails(spark):
    d = tempfile.mkdtemp(prefix="wardspark-csv-")
    for name, body in (("good", "id,name\n1,a\n2,\n"), ("bad", "id,name\n1,a\nx,b\n")):
        with open(f"{d}/{name}.csv", "w") as f:
            f.write(body)
    good = io.read_csv(spark, f"{d}/good.csv", "id int, name string")
    assert good.schema.simpleString() == "struct<id:int,name:string>" and sorted(map(tuple, good.collect())) == [(1, "a"), (2, None)]
    assert io.read_csv(spark, f"{d}/good.csv", "id string, name string", header=False).count() == 3
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        io.read_csv(spark, f"{d}/bad.csv", "id int, name string").collect()


def test_partitioned_sink_and_sample_lookup(spark):
    path = tempfile.mkdtemp(prefix="wardspark-sink-") + "/seq"
    df = spark.createDataFrame([(i, "c%d" % (i % 3), [i, i + 1]) for i in range(30)], "pid long, client string, ids array<int>")
    io.write_partitioned(df, path, "client", "pid")
    assert sorted(x for x in os.listdir(path) if x.startswith("client=")) == ["client=c0", "client=c1", "client=c2"]
    one = io.read_sample(spark, path, "client", "c1", "pid", 7)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters" in plan
    assert [tuple(r["ids"]) for r in one.collect()] == [(7, 8)]


def test_whitespace_table_and_split_union(spark):
    d = tempfile.mkdtemp(prefix="wardspark-txt-")
    with open(f"{d}/gem.txt", "w") as f:
        f.write("A0101   0101  10000\n  B02\t0202 00000 \n")
    t = io.read_whitespace_table(spark, f"{d}/gem.txt", ["icd10", "icd9", "flags"])
    assert sorted(tuple(r) for r in t.collect()) == [("A0101", "0101", "10000"), ("B02", "0202", "00000")]
    a = spark.createDataFrame([(1, "x")], "id long, a string")
    b = spark.createDataFrame([(2, 5.0)], "id long, b double")
    u = io.read_split_table(spark, ["a", "b"], {"a": a, "b": b}.get)
    assert sorted(u.columns) == ["a", "b", "id"] and u.count() == 2


def test_json_arrays_roundtrip(spark):
    df = spark.createDataFrame([(1, [3, 1]), (2, [])], "pid long, dx array<int>")
    back = io.json_to_arrays(io.arrays_to_json(df, ["dx"]), {"dx": "array<int>"})
    assert sorted((r["pid"], tuple(r["dx"])) for r in back.collect()) == [(1, (3, 1)), (2, ())]
    small = io.to_smallint(spark.createDataFrame([([[1, 2]],)], "x array<array<int>>"), ["x"])
    assert dict(small.dtypes)["x"] == "array<array<smallint>>"


def test_hot_client_is_written_by_several_tasks(spark):
    path = tempfile.mkdtemp(prefix="wardspark-sink-") + "/hot"
    df = spark.range(4000).select(F.col("id").alias("pid"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("client"))
    io.write_partitioned(df, path, "client", "pid", files=8)
    assert len([f for f in os.listdir(path + "/client=hot") if f.endswith(".parquet")]) > 2
    assert spark.read.parquet(path).where("client = 'hot'").count() == 2000
    assert io.read_sample(spark, path, "client", "hot", "pid", 6).count() == 1


def test_upper_columns(spark):
    from wardspark.operators.events import upper_columns
    assert upper_columns(spark.range(1).selectExpr("id AS itemId", "1 AS b")).columns == ["ITEMID", "B"]
