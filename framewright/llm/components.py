"""Connected components of an edge table by label propagation with shortcuts, written round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node, comp): comp is the smallest node reachable. Nodes without an edge are not returned.

    Each round takes the smallest label among a node and its neighbours, then the label of that label, so long chains
    shrink by half a round. Neither edges nor labels pass through the driver; a round's result is written, so a lost
    executor costs a round at most. No edges give no rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = c.materialize(both, "edges")
    labels = c.materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels"
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("c").alias("c"))
        )
        best = labels.select("node", "comp").join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        nxt = c.materialize(best.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("top", "comp")).alias("comp")), "labels")
        changed = not nxt.filter("old <> comp").isEmpty()
        c.discard(labels)
        labels = nxt
        if not changed:
            c.discard(both)
            return labels.select("node", "comp")
