"""Connected components of a link table, without collecting it.

Every node carries the smallest node label met so far; a round takes the smallest label among the
neighbours (an aggregate over the links, combined map-side) and then the label of that label, which
halves the distance to the smallest node. Rounds end when none changes; each is written to the
shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.llm.common import stage


def components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(a, b) bigint links -> (node, comp), comp the smallest node reachable. Nodes without a link
    aren't listed."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = stage(both, "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        new = stage(step.join(jump, "mid", "left").select("node", F.coalesce(F.least("mid", "far"), F.col("mid")).alias("comp"), "old"), "labels")
        labels = new.select("node", "comp")
        if new.where("comp != old").isEmpty():
            return labels
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
