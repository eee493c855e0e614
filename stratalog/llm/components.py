"""Connected components by alternating star contractions, on narrow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.shared import Workspace


def connected_components(edges: DataFrame, space: Workspace, name: str = "stars") -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)``: the smallest node that each linked node reaches, where smaller than itself.

    Large-star and small-star rounds alternate until the edges no longer change, in O(log^2 n) rounds. A round groups by
    node with a map-side minimum and joins that minimum back, so a hub's links are never gathered into a list. Each round
    is a table in the shared folder. Nulls and self-links are ignored; nodes without links don't appear.
    """
    now = space.write(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), f"{name}0"
    )
    state, turn = None, 0
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = small.union(low.select("u", F.col("m").alias("v"))).distinct()
        turn += 1
        after = space.write(after, f"{name}{turn}")
        found = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if turn > 1:
            space.drop(f"{name}{turn - 1}")
        now = after
        if state == tuple(found):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = tuple(found)
