"""Client (site) assignment for federated runs.

There is nothing to gather per client: the client is a column, and writers partition by
it (``sources.io.write_by_client``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.operators.util import first_nonnull_by

SOURCE_CLIENTS = {"metavision": "mimic3_mv", "carevue": "mimic3_cv"}


def clients_by_source(pids: DataFrame, stays: DataFrame, pid: str = "adm_id",
                      source: str = "dbsource", order: str = "stay_id") -> DataFrame:
    """Client per admission from the first non-null source label of its stays; other
    source labels are excluded (the reference keeps two DB-source clients)."""
    s = stays.join(pids.select(pid), pid, "left_semi")
    first = first_nonnull_by(s, [pid], order, [source])
    m = F.create_map(*[x for kv in SOURCE_CLIENTS.items() for x in map(F.lit, kv)])
    return first.select(pid, m[F.col(source)].alias("client")).where(F.col("client").isNotNull())


def top_groups(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` largest groups by row count, ties broken by the key (k rows at most)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(key)).limit(k)


def clients_top_k(df: DataFrame, key: str, k: int, prefix: str) -> DataFrame:
    """Rows of the top-k groups, tagged ``prefix || key``; the k-row side is broadcast."""
    top = F.broadcast(top_groups(df, key, k).select(key))
    return df.join(top, key).withColumn("client", F.concat(F.lit(prefix), F.col(key).cast("string")))
