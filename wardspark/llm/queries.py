"""One query for each operator, over its whole table, and DuckDB twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


from wardspark.llm import cells, collocations, licenses, manifest  # noqa: E402


@query("op6_license_scan", licenses.oracle())
def license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan(read(spark, d, "documents"))


@query("op7_source_mix", r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
             md5('mix|' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w,
        (source_size * 3)::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lv
      FROM w WINDOW o AS (ORDER BY cap / w, source COLLATE C NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN m IS NULL OR cap <= w * m THEN cap ELSE w * m END AS target
      FROM (SELECT *, max(CASE WHEN cap / w > lv THEN lv END) OVER () AS m FROM l)),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
        (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS ep FROM r)
SELECT doc_id, size, source_size, target,
  (size * ep + least(greatest(budget - ep * source_size - before, 0), size))::BIGINT AS taken FROM e""")
def source_mix(spark: SparkSession, d: str) -> DataFrame:
    from wardspark.llm.mixing import mix_documents
    return mix_documents(read(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_url_rules")
def url_rules(spark: SparkSession, d: str) -> DataFrame:
    from wardspark.llm.urlrules import judge
    return judge(read(spark, d, "pages"), read(spark, d, "labels")).drop("mined")


@query("op10_ring_shards")
def ring_shards(spark: SparkSession, d: str) -> DataFrame:
    from wardspark.llm.ring import shard_documents
    return shard_documents(read(spark, d, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op1_language_filters")
def language_filters(spark: SparkSession, d: str) -> DataFrame:
    from wardspark.llm.lang_id import identify_documents
    return identify_documents(read(spark, d, "documents"))


@query("op2_merkle_fingerprints")
def merkle_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    from wardspark.llm.merkle import fingerprint_pairs
    return fingerprint_pairs(read(spark, d, "documents"))


@query("op3_rlz_dedup", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS t FROM w WHERE len(w) >= 20),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) > 1 AS late FROM s),
c AS (SELECT p.*, coalesce(max(CASE WHEN f.late THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS cut
  FROM p LEFT JOIN f ON f.doc_id = p.doc_id AND f.i = p.i),
k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE cut) AS gone, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT cut) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""")
def rlz_dedup(spark: SparkSession, d: str) -> DataFrame:
    from wardspark.llm.rlz import dedup_substrings
    return dedup_substrings(read(spark, d, "documents")).drop("factors")


@query("op9_ngram_components", cells.oracle(4, 85))
def ngram_components(spark: SparkSession, d: str) -> DataFrame:
    from wardspark.llm.ngram_join import link_documents
    return link_documents(read(spark, d, "documents")).drop("class")


@query("op4_string_tiling")
def string_tiling(spark: SparkSession, d: str) -> DataFrame:
    from wardspark.llm.tiling import contaminated_pairs
    return contaminated_pairs(read(spark, d, "documents"), read(spark, d, "benchmark")).select(
        "doc_id", "item_id", "covered", "n_tokens", F.round("coverage", 6).alias("coverage"), F.size("tiles").alias("n_tiles"))


@query("op5_nearest_toxic")
def nearest_toxic(spark: SparkSession, d: str) -> DataFrame:
    from wardspark.llm.toxicity import score_documents
    return score_documents(read(spark, d, "documents"), read(spark, d, "labels"))


@query("op11_merkle_manifest", manifest.oracle())
def merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    return manifest.manifest(read(spark, d, "documents"))


@query("op12_phrase_collocations", collocations.ORACLE)
def phrase_collocations(spark: SparkSession, d: str) -> DataFrame:
    return collocations.collocations(read(spark, d, "documents"))


@query("op13_fast_minhash", cells.oracle(3, 85, ", w.doc_id = coalesce(c.component_id, w.doc_id) AS kept"))
def fast_minhash(spark: SparkSession, d: str) -> DataFrame:
    from wardspark.llm.fast_minhash import near_duplicates
    return near_duplicates(read(spark, d, "documents"))
