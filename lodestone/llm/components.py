"""Connected components by alternating large-star and small-star steps.

Every step is a join with per-node minima (no neighbour list is ever collected),
and every step's edges are written to the shared folder, so neither memory nor
lineage grows with the component or the number of steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v), u > v; returns edges of the same form."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:  # link larger neighbours to the smallest
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # link smaller neighbours, and the node itself, to the smallest
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge; component: its smallest node."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now = materialize(now, "cc")
    state = None
    while True:
        now = materialize(_star(_star(now, True), False), "cc")
        # Stars only: each node points to one smaller node, which points nowhere.
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == (found["n"], found["h"]):
            break
        state = (found["n"], found["h"])
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
