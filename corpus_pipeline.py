"""The pipeline over ``documents``: language, near duplicates, benchmark, mix, shards.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all that the stage before kept;
``run`` writes every stage's rows as Parquet to the shared folder and reads them again.

Cases: texts that are null or hold no letter leave with the language stage; a null doc_id counts after all others and
is kept where its group has no other; rows that share a doc_id are told apart by their text, equal rows are copies of
each other until the mix repeats rows; a null source is a source of its own; an empty table passes every stage;
extra columns of any name pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardspark.llm import lang_id, mixing, ngram_join, ring, tiling
from wardspark.llm.common import read, stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some learned language; those without a letter, or that no language knows, go."""
    return lang_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return ngram_join.keep_one(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return tiling.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_corpus(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix."""
    return ring.shard_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
