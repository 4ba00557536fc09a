"""Connected components by local contraction, as joins and aggregates over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.shared import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``): equal roots are connected.

    Each round every node joins the neighbour (or itself) that comes first in an order drawn
    anew by hashing, and the edges are rewritten between those; the number of nodes falls by a
    constant factor in the mean, also on long paths. Stops when no edge is left. Edges, maps
    and labels stay distributed; each round is cut with a checkpoint.
    """
    left = cut(edges.select("a", "b").where("a <> b").distinct())
    maps: list[DataFrame] = []
    while not left.isEmpty():
        seed = len(maps)
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("h"), F.col(c).alias("v"))
        first = both.groupBy("a").agg(F.min(order("b")).alias("near"))
        step = cut(first.select(F.col("a").alias("node"), F.least("near", order("a"))["v"].alias("to")))
        maps.append(step)
        there = step.select(F.col("node").alias("a"), F.col("to").alias("na"))
        back = step.select(F.col("node").alias("b"), F.col("to").alias("nb"))
        moved = left.join(there, "a").join(back, "b").where("na <> nb")
        left = cut(moved.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct())
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    label = maps[0].select("node", F.col("to").alias("root"))
    for step in maps[1:]:
        onward = step.select(F.col("node").alias("root"), "to")
        label = label.join(onward, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return cut(label)
