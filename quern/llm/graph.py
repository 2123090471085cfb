"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialise


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, label) for every node of an edge, the label being the smallest node of its component.

    Every round gives a node the smallest label next to it and then that label's own label, so the
    number of rounds grows with the logarithm of the longest path. Rounds are written to the
    shared folder. Nothing but the number of changed labels comes to the driver.
    """
    both = edges.select(F.col(left).alias("node"), F.col(right).alias("other"))
    both = materialise(both.union(both.select("other", "node")).distinct(), "edges")
    labels = materialise(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        better = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("before"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        stepped = better.join(jump, "next").select("node", F.least("next", "beyond").alias("label"), "before")
        stepped = materialise(stepped, "labels")
        changed = stepped.where("label <> before").limit(1).count()
        labels = stepped.select("node", "label")
        if not changed:
            return labels
