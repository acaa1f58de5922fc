"""Connected components of a graph of any size, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the node's smallest neighbour (or itself)."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of these.  Takes ``a > b``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.crc32(F.concat_ws(",", "a", "b")))).first())


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, root`` for every end of an edge; the root is the smallest node of its component.

    ``edges`` has two integer columns.  Loops, repeated edges and NULL ends mean nothing; without
    edges there are no rows.  Grouping sums map-side and joins are left to adaptive skew splitting,
    so a node with a third of all edges is shared out.  Every round is written to the shared folder."""
    a, b = edges.columns
    now = stored(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(),
        "edges",
    )
    before = _state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        now = stored(_small_star(_large_star(now).distinct()).distinct(), "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return ends.union(now.select("b", "b").distinct())
