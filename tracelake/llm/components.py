"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al. 2014).

Every round is two grouped minima, each joined back without a task that gets all edges of a node (`common.join_split`);
the edges stay a distributed table, written to the shared folder after each round, and the number of rounds grows with
the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import Workspace, join_split


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")


def components(edges: DataFrame, workspace: Workspace, name: str) -> DataFrame:
    """(node, component): for every end of an edge (columns u, v) the least node that can be reached from it."""
    current = workspace.save(f"{name}-0", edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen, turn = None, 0
    while True:
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen, turn = state, turn + 1
        # large star: each node gives its least neighbour, itself included, to its greater neighbours
        both = current.union(current.select("v", "u"))
        least = workspace.save(f"{name}-{turn}-a", _least(both))
        large = join_split(both, least, ["u"], "n", 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = workspace.save(f"{name}-{turn}-large", large)
        # small star: to its lesser neighbours and itself; u is the greater end of each pair
        least = workspace.save(f"{name}-{turn}-b", _least(large))
        small = join_split(large, least, ["u"], "n", state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        after = workspace.save(f"{name}-{turn}", small)
        workspace.drop(f"{name}-{turn - 1}", f"{name}-{turn}-large", f"{name}-{turn}-a", f"{name}-{turn}-b")
        current = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
