"""Scoring tables: loss, average precision, epoch loss, early stopping, record flattening
(G19, M8-M13, M15, M16).

Prediction tables are long and may be huge; every cumulative quantity uses
``running_sums`` (range partitions + offsets) instead of a window per client.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspark.operators.util import running_sums


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def bce_with_logits(z: Column, y: Column) -> Column:
    """Numerically stable binary cross-entropy from a logit."""
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def mean_bce(df: DataFrame, keys: Sequence[str], z: str = "z", y: str = "y", out: str = "loss") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(bce_with_logits(F.col(z), F.col(y).cast("double"))).alias(out))


def average_precision(df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y",
                      out: str = "auprc") -> DataFrame:
    """Step-wise average precision (sklearn semantics): thresholds are the distinct scores,
    ties form one step; AP = sum over steps of (recall gain) x precision. NULL without
    positives."""
    steps = df.groupBy(*keys, score).agg(F.sum(F.col(y).cast("long")).alias("_pos"),
                                         F.count(F.lit(1)).alias("_all"))
    c = running_sums(steps, list(keys), [F.col(score).desc()], ["_pos", "_all"])
    if keys:
        c = c.join(c.groupBy(*keys).agg(F.sum("_pos").alias("_tp_total")), list(keys))
    else:  # one pooled group: the total is a one-row scalar subquery
        c = c.withColumn("_tp_total", steps.agg(F.sum("_pos")).scalar())
    contrib = (F.col("_pos") / F.col("_tp_total")) * (F.col("cum__pos") / F.col("cum__all"))
    return (c.groupBy(*keys).agg(F.sum(F.when(F.col("_tp_total") > 0, contrib)).alias(out),
                                 F.max("_tp_total").alias("_tp"))
             .withColumn(out, F.when(F.col("_tp") > 0, F.col(out))).drop("_tp"))


def epoch_loss(df: DataFrame, keys: Sequence[str], batch: str = "batch", loss: str = "loss") -> DataFrame:
    """Sum of batch-mean losses / number of batches (the trainer's running epoch loss)."""
    b = df.groupBy(*keys, batch).agg(F.avg(loss).alias("_bl"))
    return b.groupBy(*keys).agg((F.sum("_bl") / F.count(F.lit(1))).alias("loss"))


def early_stopping(metrics: DataFrame, client: str = "client", rnd: str = "round", score: str = "auprc",
                   patience: int = 10, higher_is_better: bool = True) -> DataFrame:
    """Per (client, round): improved (ties count), counter of checks since the last improvement,
    stopped (latched once the counter reaches ``patience``). Windows run over the small
    per-client round history."""
    s = F.col(score) if higher_is_better else -F.col(score)
    w_prev = Window.partitionBy(client).orderBy(rnd).rowsBetween(Window.unboundedPreceding, -1)
    w_upto = Window.partitionBy(client).orderBy(rnd).rowsBetween(Window.unboundedPreceding, 0)
    x = metrics.withColumn("_s", s).withColumn("_best_prev", F.max("_s").over(w_prev))
    x = x.withColumn("improved", F.col("_best_prev").isNull() | (F.col("_s") >= F.col("_best_prev")))
    x = x.withColumn("_check", F.row_number().over(Window.partitionBy(client).orderBy(rnd)))
    x = x.withColumn("_last", F.max(F.when(F.col("improved"), F.col("_check"))).over(w_upto))
    x = x.withColumn("counter", (F.col("_check") - F.col("_last")).cast("int"))
    x = x.withColumn("stopped", F.max((F.col("counter") >= patience).cast("int")).over(w_upto) == 1)
    return x.drop("_s", "_best_prev", "_last", "_check")


def first_stop(es: DataFrame, client: str = "client", rnd: str = "round") -> DataFrame:
    return es.groupBy(client).agg(F.min(F.when(F.col("stopped"), F.col(rnd))).alias("stop_round"))


def global_stop(es: DataFrame, client: str = "client", rnd: str = "round") -> DataFrame:
    """Round at which every client has stopped (NULL when some client never stops)."""
    fs = first_stop(es, client, rnd)
    return fs.agg(F.when(F.count_if(F.col("stop_round").isNull()) == 0, F.max("stop_round")).alias("stop_round"))


def best_round(es: DataFrame, client: str = "client", rnd: str = "round") -> DataFrame:
    """Last tie-or-better round per client, at or before the run's global stop round."""
    g = global_stop(es, client, rnd).scalar()
    x = es.withColumn("_stop", g)
    x = x.where(F.col("_stop").isNull() | (F.col(rnd) <= F.col("_stop")))
    return x.groupBy(client).agg(F.max(F.when(F.col("improved"), F.col(rnd))).alias("best_round"))


def flatten_records(df: DataFrame, split: str, client: str, metrics: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Wide metric record -> long rows keyed 'split/client_metric'."""
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in metrics]))
    x = df.select(*keep, split, client, stack.alias("_kv"))
    key = F.concat(F.col(split), F.lit("/"), F.col(client), F.lit("_"), F.col("_kv.m"))
    return x.select(*keep, key.alias("key"), F.col("_kv.v").alias("value"))
