"""Connected components by label propagation with pointer jumping, in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) of every node of ``edges`` (a, b: long). Loops and repeats do no harm.

    Each round takes the least label among neighbours and then the label of that label, so long chains shorten by
    powers. Labels are tables in the shared folder; joins on hot labels are plain equi-joins that can be split.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "graph-edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "graph-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("beyond"))
        new = materialise(step.join(jump, "mid", "left").select("node", F.least("mid", F.coalesce("beyond", "mid")).alias("component"), "old"), "graph-labels")
        changed = not new.where("component <> old").isEmpty()
        discard(labels)
        labels = new.select("node", "component")
        if not changed:
            discard(both)
            return labels
