"""Connected components by minimum-label propagation with pointer jumping, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, component), component being the smallest node reachable.

    Each round takes the minimum label over the neighbours (pre-aggregated before the shuffle) and
    then jumps to the label's own label, so a chain of length d needs about log d rounds. Labels go
    to a scratch table each round. No links: no rows. Self links and repeats are harmless.
    """
    both = links.select(F.col("a").alias("s"), F.col("b").alias("d")).unionByName(links.select(F.col("b").alias("s"), F.col("a").alias("d"))).distinct()
    edges = scratch(both, "edges")
    labels = scratch(edges.groupBy(F.col("s").alias("node")).agg(F.least(F.min("d"), F.first("s")).alias("component")), "labels")
    while True:
        heard = edges.join(labels, edges.s == labels.node).groupBy(F.col("d").alias("node")).agg(F.min("component").alias("heard"))
        better = labels.join(heard, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "heard").alias("c"))
        better = scratch(better, "heard", [labels])
        up = better.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        jumped = better.join(up, "c", "left").select("node", "old", F.least("c", F.coalesce("cc", "c")).alias("component"))
        jumped = scratch(jumped, "labels", [better])
        labels = jumped.select("node", "component")
        if jumped.where("old <> component").isEmpty():
            discard(edges)
            return labels
        labels.__dict__["scratch_path"] = jumped.__dict__.pop("scratch_path")
