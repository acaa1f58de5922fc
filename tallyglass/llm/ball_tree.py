"""Exact top-k inner products: a ball tree per shard, searched best bound first.

No point of a ball with centre ``c`` and radius ``r`` has an inner product with ``q`` above ``q.c + |q| r``.  Each
query walks a shard's tree from the node with the largest bound and stops at its current kth score.  That
score is shared: a first round searches one shard for each query, and the kth score found there is the
floor with which the second round enters all other shards.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.llm.common import stored

LEAF_ROWS = 128
# Numbers (rows times dimensions) of a shard and of a block of queries; a task holds one of each.
SHARD_VALUES, QUERY_VALUES = 1 << 19, 1 << 17
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1
NO_FLOOR = LONG_MIN


class BallTree:
    """Nodes as parallel lists; a node's rows are ``order[first:last]``."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.ids, order, values = ids, np.arange(len(points)), points.astype(float)
        self.first, self.last, self.left, self.right = [], [], [], []
        centres, radii = [], []
        todo = [(0, len(points), None)]
        while todo:
            a, b, parent = todo.pop()
            node, rows = len(centres), values[order[a:b]]
            centre = rows.mean(axis=0)
            away = np.sqrt(((rows - centre) ** 2).sum(axis=1))
            centres.append(centre)
            radii.append(away.max())
            for column, value in ((self.first, a), (self.last, b), (self.left, -1), (self.right, -1)):
                column.append(value)
            if parent is not None:
                (self.left if self.left[parent] < 0 else self.right)[parent] = node
            if b - a > LEAF_ROWS and away.max() > 0:
                # Along the line between a far point and the one farthest from it, halved at the median.
                p = rows[away.argmax()]
                q = rows[((rows - p) ** 2).sum(axis=1).argmax()]
                order[a:b] = order[a:b][np.argsort(rows @ (q - p), kind="stable")]
                todo += [(a, (a + b) // 2, node), ((a + b) // 2, b, node)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        # No coordinate sum of a node's rows, centre or radius is rounded by more than a few units in its last place.
        self.reach = np.sqrt((self.centres**2).sum(axis=1)) + self.radii
        self.order, self.points, self.ids = order, points[order], ids[order]
        self.floats = self.points.astype(float)
        self.largest = np.abs(self.points.astype(object)).max() if self.points.size else 0

    def search(self, queries: np.ndarray, ids: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """``(query id, vector id, score)`` of the k best (or all that can still be among them), own id aside."""
        q = queries.astype(float)
        length = np.sqrt((q * q).sum(axis=1))[:, None]
        bounds = q @ self.centres.T + length * self.radii[None, :]
        # Rounding must not hide a node.  It goes by the terms of the sum, which may cancel, not by the sum.
        bounds += (self.points.shape[1] + 8) * 2.0**-49 * length * self.reach[None, :]
        exact = int(np.abs(queries.astype(object)).max(initial=0)) * int(self.largest) * self.points.shape[1] < 1 << 53
        out = []
        for row, (query, own, floor) in enumerate(zip(queries, ids.tolist(), floors.tolist(), strict=True)):
            best: list[tuple[int, int]] = []  # (score, -id), smallest first
            bound = bounds[row].tolist()
            todo = [(-bound[0], 0)]
            while todo:
                upper, node = heapq.heappop(todo)
                if -upper < floor:
                    break
                if self.left[node] >= 0:
                    for child in (self.left[node], self.right[node]):
                        if bound[child] >= floor:
                            heapq.heappush(todo, (-min(bound[child], -upper), child))
                    continue
                rows = slice(self.first[node], self.last[node])
                if exact:
                    scores = (self.floats[rows] @ q[row]).astype(np.int64)
                else:
                    scores = np.array([min(max(s, LONG_MIN), LONG_MAX) for s in self.points[rows].astype(object) @ query.astype(object)], np.int64)
                at = np.flatnonzero(scores >= floor)
                for score, other in zip(scores[at].tolist(), self.ids[rows][at].tolist(), strict=True):
                    if other != own:
                        if len(best) < k:
                            heapq.heappush(best, (score, -other))
                        elif (score, -other) > best[0]:
                            heapq.heapreplace(best, (score, -other))
                if len(best) == k:
                    floor = max(floor, best[0][0])
            out += [(own, -other, score) for score, other in best]
        return out


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of equal length; shorter vectors are filled with zeros."""
    lists = column.combine_chunks()
    sizes, values = np.diff(np.asarray(lists.offsets)), np.asarray(lists.flatten())
    out = np.zeros((len(lists), dims), np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def whole_numbers(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """``id, v``: components as ``floor(scale * x)``, at most what a long holds.  Rows without an id or a vector, or with
    a component that is NULL or not finite, are left out."""
    v = F.transform(vector_column, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    scaled = lambda x: F.greatest(F.lit(-9.2e18), F.least(F.lit(9.2e18), F.lit(float(scale)) * x))
    return rows.select("id", F.transform("v", lambda x: F.floor(scaled(x)).cast("long")).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its ``k`` largest inner products among the other vectors.

    Vectors are rounded down to whole numbers first (see ``whole_numbers`` for what takes no part), so scores are exact;
    scores beyond a long are held at its ends.  Ties go to the smaller id.  A query meets every row
    but those of its own id; a repeated row is met as often as it occurs, a repeated query id counts once
    (its smallest vector).  Vectors of unequal length are compared as if filled with zeros.  Fewer than
    ``k`` others give fewer rows; empty tables give none."""
    base = stored(whole_numbers(vectors, id_column, vector_column, scale), "vectors")
    asked = whole_numbers(queries, id_column, vector_column, scale).groupBy("id").agg(F.min("v").alias("v"))
    facts = base.agg(F.count("*"), F.max(F.size("v"))).first()
    wanted = stored(asked, "queries")
    count, widest = wanted.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = max(facts[1] or 0, widest or 0, 1)
    shards = max(1, -(-facts[0] * dims // SHARD_VALUES))
    blocks = max(1, -(-count * dims // QUERY_VALUES))

    def work(key, rows: pa.Table, asking: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and asking.num_rows:
            tree = BallTree(_matrix(rows.column("v"), dims), rows.column("id").to_numpy())
            found = tree.search(_matrix(asking.column("v"), dims), asking.column("id").to_numpy(), asking.column("floor").to_numpy(), k)
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    placed = base.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(shards)).cast("int"))
    asking = wanted.withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)).cast("int"))
    asking = asking.withColumn("home", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(shards)).cast("int"))
    spread = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def searched(by_shard: DataFrame) -> DataFrame:
        pairs = spread.groupBy("shard", "block").cogroup(by_shard.groupBy("shard", "block"))
        return pairs.applyInArrow(work, "query_id long, vec_id long, score long")

    first = stored(searched(asking.select("id", "v", "block", F.col("home").alias("shard"), F.lit(NO_FLOOR).alias("floor"))), "first")
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(NO_FLOOR)).alias("floor"))
    rest = asking.join(floors, F.col("id") == F.col("query_id"), "left").select(
        "id", "v", "block", "home", F.coalesce("floor", F.lit(NO_FLOOR)).alias("floor"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    )
    found = first.union(searched(rest.where("shard <> home").drop("home")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
