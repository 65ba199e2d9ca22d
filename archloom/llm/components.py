"""Connected components by least label, with pointer jumping; nothing but counts comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archloom.llm.common import materialise_few


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id on an edge; component is the least id that it reaches.

    Each round takes the least label among the neighbours and then the label of that label, so a chain of n links
    needs about log n rounds. Each round is written to the shared folder. Groups are reduced by min, never gathered.
    """
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = materialise_few(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels = materialise_few(both.groupBy("x").agg(F.min(F.least("x", "y")).alias("l")))
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), "l"), "y").groupBy("x").agg(F.min("l").alias("m"))
        hooked = labels.join(near, "x").select("x", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        jump = labels.select(F.col("x").alias("l"), F.col("l").alias("ll"))
        new = materialise_few(hooked.join(jump, "l", "left").select("x", "was", F.least("l", F.coalesce("ll", "l")).alias("l")))
        changed = new.where(F.col("l") != F.col("was")).limit(1).count()
        labels = new.select("x", "l")
        if not changed:
            return labels.select(F.col("x").alias("id"), F.col("l").alias("component"))
