"""Session helpers.

The library never hard-codes a machine-local folder: lineage cuts go to the folder the
cluster names in ``spark.checkpoint.dir``. Only local runs (tests, bench) fill it in when
it is unset, via ``get_session(local_checkpoint_root=...)``.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # dictionaries and per-code edge tables are small; everything that grows with the
    # data is joined by shuffle.  Explicit broadcasts are on tables bounded by the schema, the model or a parameter.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                local_checkpoint_root: str | None = None, app: str = "wardspark") -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("WARDSPARK_DRIVER_MEM", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if local_checkpoint_root and not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", local_checkpoint_root)
    cp = spark.conf.get("spark.checkpoint.dir", None)
    if cp:
        spark.sparkContext.setCheckpointDir(cp)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts; raises when the cluster names none."""
    cp = spark.conf.get("spark.checkpoint.dir", None)
    if not cp:
        raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared folder")
    spark.sparkContext.setCheckpointDir(cp)
    return cp
