"""Mixing sources to target weights, with DataFrame operations only.

Documents get hash-random keys; each source is laid out along the key range, which is cut into
equal cells (a uniform hash needs no sampled bounds, so every branch of the plan agrees on a
row's cell). Sums per (source, cell) give the prefix sum before each cell, a window inside the
cell gives the rest, and the source is cut at its exact budget: whole epochs first, then the
front of the key order, the document at the cut counting in part.

Cases: a null or empty text has size 0 and takes 0; null sources form one source, sorted last;
repeated rows and equal keys are ordered by (key, doc_id, size), so they are interchangeable; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspark.llm.common import parallelism, stage, take_columns

WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 24


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.0, max_epochs: int = 3) -> DataFrame:
    """(source, source_size) -> the same with ``target``: ``share`` of all words dealt by weight,
    no source above ``max_epochs`` times its size, the excess dealt again by weight.

    The limit of dealing again and again is the level at which weight x level, capped, sums to the
    budget: sources are taken in order of cap / weight and the first that stays below its cap
    fixes the level. The windows run over the table of sources, one row each.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_w", weight).withColumn("_cap", (F.col("source_size") * max_epochs).cast("double"))
    every = Window.partitionBy()
    rising = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    s = s.select("*", (F.sum("source_size").over(every) * F.lit(float(share))).alias("_all"),
                 F.sum("_w").over(every).alias("_wall"),
                 F.coalesce(F.sum("_cap").over(before), F.lit(0.0)).alias("_c0"),
                 F.coalesce(F.sum("_w").over(before), F.lit(0.0)).alias("_w0"))
    s = s.withColumn("_level", (F.col("_all") - F.col("_c0")) / (F.col("_wall") - F.col("_w0")))
    s = s.withColumn("_level", F.max(F.when(F.col("_cap") / F.col("_w") > F.col("_level"), F.col("_level"))).over(every))
    return s.select("source", "source_size",
                    F.when(F.col("_level").isNull() | (F.col("_cap") <= F.col("_w") * F.col("_level")), F.col("_cap"))
                     .otherwise(F.col("_w") * F.col("_level")).alias("target"))


def mix_sources(sized: DataFrame, weights=(5, 2, 1), share: float = 1.0, max_epochs: int = 3,
                seed: str = "mix") -> DataFrame:
    """(doc_id, source, size) -> (doc_id, source, size, source_size, target, taken).

    ``sized`` is read twice; give it a stored table.
    """
    cells = max(16, parallelism(sized.sparkSession))
    key = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    cell = F.floor(F.conv(F.substring(key, 1, KEY_BITS // 4), 16, 10).cast("bigint") * cells / F.lit(1 << KEY_BITS)).cast("int")
    keyed = sized.select("doc_id", "source", "size", key.alias("_key"), cell.alias("_cell"))
    inside = Window.partitionBy("source", "_cell").orderBy("_key", "doc_id", "size") \
        .rowsBetween(Window.unboundedPreceding, 0)
    keyed = keyed.withColumn("_run", F.sum("size").over(inside) - F.col("size")).drop("_key")

    per_cell = sized.select("source", "size", cell.alias("_cell")).groupBy("source", "_cell").agg(F.sum("size").alias("_n"))
    earlier = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    per_cell = per_cell.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    g = goal.withColumnRenamed("source", "_gs")
    per_cell = per_cell.join(g, per_cell["source"].eqNullSafe(g["_gs"])) \
        .select(F.col("source").alias("_src"), F.col("_cell").alias("_c"), "_before", "source_size", "target")

    j = keyed.join(per_cell, keyed["source"].eqNullSafe(per_cell["_src"]) & (keyed["_cell"] == per_cell["_c"]))
    budget = F.floor("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rest = budget - epochs * F.col("source_size")
    cut = F.least(F.greatest(rest - F.col("_before") - F.col("_run"), F.lit(0)), F.col("size"))
    return j.select("doc_id", "source", "size", "source_size", "target",
                    (F.col("size") * epochs + cut).cast("bigint").alias("taken"))


def size_documents(docs: DataFrame) -> DataFrame:
    """The light table (doc_id, source, size); the one pass over the texts."""
    return take_columns(docs, "doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("size"))


def mix_documents(docs: DataFrame, **kw) -> DataFrame:
    return mix_sources(stage(size_documents(docs), "sizes"), **kw)


def mixed_corpus(docs: DataFrame, **kw) -> DataFrame:
    """The mix as whole documents: each row as often as the mix takes it, the row at a source's cut
    once more if at least half of it is inside; rows without a word take nothing. Rows that agree in doc_id and source share what the
    mix takes of them evenly. All columns stay as they were."""
    taken = mix_documents(docs, **kw)
    per = taken.groupBy(F.col("doc_id").alias("_d"), F.col("source").alias("_s")).agg(
        F.round(F.try_divide(F.sum("taken"), F.sum("size"))).cast("int").alias("_n")).where("_n > 0")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("`doc_id`").alias("_id"), F.col("`source`").alias("_src"))
    j = packed.join(per, F.col("_id").eqNullSafe(F.col("_d")) & F.col("_src").eqNullSafe(F.col("_s")))
    return j.withColumn("_r", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_doc.*")
