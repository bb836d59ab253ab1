"""Lineage cuts, stage outputs and their owners.

``cut(df)`` writes a reliable checkpoint, ``store(df, name)`` Parquet (read back with pruned columns) into the folder
named by ``spark.checkpoint.dir`` (a shared folder on a cluster, so a lost executor never loses the cut). A cluster
session without the setting fails; only a single-machine session gets a fresh folder of its own.

What a session stores lies in a folder of its own below the shared one. ``owned(spark)`` is the owner of what is stored
inside its block and removes it at the end, however that comes; a caller keeps a result by writing it elsewhere first.

``stage`` keeps a result across runs, under a manifest: the configuration, a fingerprint of the input files
(names, lengths, times of change) and the folder of the data. Data are written to a new folder and the manifest is
put in place by a rename, so a killed write is never read and changed input or configuration is built anew.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "manifest.json"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local session (one machine, one process) may leave it unset and then gets a fresh
    folder; on a cluster an unset folder is an error, never a machine-local path.
    """
    cp = spark.conf.get("spark.checkpoint.dir", None)
    if not cp:
        if not re.match(r"local(\[|$)", spark.sparkContext.master or ""):
            raise RuntimeError("spark.checkpoint.dir is not set; name a folder that all executors share")
        cp = tempfile.mkdtemp(prefix="wardspark-cp-")
        spark.conf.set("spark.checkpoint.dir", cp)
    return cp.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """This session's own folder in the shared one."""
    return f"{shared_dir(spark)}/wardspark-{spark.sparkContext.applicationId}"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    cp = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(cp)
    return cp


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` and return it with its lineage truncated (reliable checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the session's folder and read it back: a lineage cut whose readers prune columns
    and the partitions of ``partition_by``."""
    path = f"{session_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ------------------------------------------------------------------------------- files
def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """Digest of the names, lengths and times of change of all files below ``paths``."""
    h = hashlib.sha1()
    for path in sorted(paths):
        fs, p = _fs(spark, path)
        found = []
        if fs.exists(p):
            files = fs.listFiles(p, True)
            while files.hasNext():
                f = files.next()
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        h.update(json.dumps([path, sorted(found)]).encode())
    return h.hexdigest()


def config_hash(cfg: dict) -> str:
    """Stable short hash of a stage configuration; stage folders carry it (Q21)."""
    return hashlib.sha1(json.dumps(cfg, sort_keys=True, default=str).encode()).hexdigest()[:12]


# ------------------------------------------------------------------------------- owners
@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Owner of all that this session stores inside the block; it is removed when the block ends."""
    def mine() -> set[str]:
        checkpoints = spark.sparkContext.getCheckpointDir()
        return {*children(spark, session_dir(spark)), *(children(spark, checkpoints) if checkpoints else [])}

    ensure_checkpoint_dir(spark)
    before = mine()
    try:
        yield
    finally:
        for path in mine() - before:
            remove(spark, path)
        if not children(spark, session_dir(spark)):
            remove(spark, session_dir(spark))


# ------------------------------------------------------------------------------ manifest
def read_manifest(spark: SparkSession, root: str) -> dict | None:
    """The manifest below ``root``; None where there is none."""
    fs, p = _fs(spark, f"{root}/{MANIFEST}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _commit(spark: SparkSession, root: str, manifest: dict) -> None:
    """Put the manifest in place by one rename; an older one goes first, never the data it names."""
    fs, new = _fs(spark, f"{root}/.{MANIFEST}-{uuid.uuid4().hex}")
    out = fs.create(new, False)
    out.write(bytearray(json.dumps(manifest, sort_keys=True, default=str).encode()))
    out.close()
    final = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{MANIFEST}")
    if fs.exists(final):
        fs.delete(final, False)
    if not fs.rename(new, final):
        raise RuntimeError(f"{root}: the manifest could not be put in place")


def stage(spark: SparkSession, root: str, name: str, cfg: dict, build: Callable[[], DataFrame],
          partition_by: Sequence[str] = (), inputs: Sequence[str] = ()) -> DataFrame:
    """Materialise ``build()`` once per configuration and state of ``inputs`` and return the stored table.

    Data without a manifest that names them, left by a killed write or an older input, are removed by the next build.
    """
    home = f"{root.rstrip('/')}/{name}-{config_hash(cfg)}"
    want = {"config": json.loads(json.dumps(cfg, sort_keys=True, default=str)), "inputs": fingerprint(spark, inputs)}
    have = read_manifest(spark, home)
    if have is None or {k: have.get(k) for k in want} != want:
        data = f"data-{uuid.uuid4().hex}"
        build().write.partitionBy(*partition_by).parquet(f"{home}/{data}")
        _commit(spark, home, want | {"data": data})
        for path in children(spark, home):
            if path.rsplit("/", 1)[-1] not in (data, MANIFEST):
                remove(spark, path)
        have = want | {"data": data}
    return spark.read.parquet(f"{home}/{have['data']}")
