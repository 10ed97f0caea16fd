"""Connected components of a graph of any size by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.session import stored


def _state(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node that an edge touches; the root is the smallest node of the component.

    Large-star joins every larger neighbour of a node to the node's smallest neighbour, small-star does the same
    for smaller neighbours; both keep components whole, and repeated they leave one star per component after a
    number of rounds logarithmic in the graph. Each round is a table in the shared folder, so neither lineage
    nor any group of edges grows: minima are partial aggregates, and nodes with very many edges sit on
    the side of the join that adaptive execution splits. Self loops name a node without linking it.
    """
    pairs = edges.where(f"{left} is not null and {right} is not null")
    nodes = stored(pairs.select(F.explode(F.array(left, right)).alias("node")).distinct())
    # an edge is kept once, as (larger, smaller)
    now = stored(pairs.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large)
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lower, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        after = stored(moved.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct())
        reached = _state(after)
        if reached == state:
            break
        now, state = after, reached
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
