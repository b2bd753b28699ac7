"""Connected components of a link table, by least-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def components(links: DataFrame) -> DataFrame:
    """links (x, y) of longs -> (node, comp) with the least node reachable, for every node that has a link.

    Each round takes the least label among neighbours and then the label of that label, so long chains take a
    logarithmic number of rounds. Rounds are written to the shared folder; only sums reach the driver.
    """
    both = saved(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = saved(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("comp")), "labels")
    total = F.sum(F.col("comp").cast("decimal(38,0)"))
    before = labels.agg(total).first()[0]
    while before is not None:
        near = both.join(labels, both["x"] == labels["node"]).groupBy("y").agg(F.min("comp").alias("m"))
        stepped = labels.join(near, labels["node"] == near["y"]).select("node", F.least("comp", "m").alias("comp"))
        stepped = saved(stepped, "labels")
        discard(labels)
        jump = stepped.select(F.col("node").alias("t"), F.col("comp").alias("c"))
        labels = saved(stepped.join(jump, stepped["comp"] == jump["t"], "left").select("node", F.least("comp", F.coalesce("c", "comp")).alias("comp")), "labels")
        discard(stepped)
        now = labels.agg(total).first()[0]
        if now == before:
            break
        before = now
    discard(both)
    return labels
