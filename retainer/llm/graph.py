"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainer.llm.workspace import materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (u long, v long); component is the smallest node.

    Each round takes the smallest label among a node's neighbours and then the label of
    that label, so chains shrink geometrically.  A hub's edges meet in a join (which can
    be split when skewed) and a partially aggregated minimum, never in one list.  Rounds
    stop when no label changes; an empty edge table gives an empty result.
    """
    both = materialize(
        edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        .filter("u <> v").distinct(), "cc-edges")
    labels = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l"))
                         .withColumnRenamed("u", "node"), "cc-labels")
    for _ in range(max_rounds):
        other = labels.select(F.col("node").alias("v"), F.col("l").alias("lv"))
        near = both.join(other, "v").groupBy("u").agg(F.min("lv").alias("m"))
        hooked = labels.join(near, labels.node == near.u).select("node", "l", F.least("l", "m").alias("m"))
        up = labels.select(F.col("node").alias("m"), F.col("l").alias("lm"))
        fresh = materialize(
            hooked.join(up, "m", "left").select("node", F.least("m", F.coalesce("lm", "m")).alias("l"), F.col("l").alias("old")),
            "cc-labels")
        changed = fresh.filter("l <> old").limit(1).count()
        labels = fresh.select("node", "l")
        if not changed:
            return labels.select("node", F.col("l").alias("component"))
    raise RuntimeError("components did not settle")
