import math
import random

import numpy as np

from tallyglass.llm import ball_tree


def plain(rows, asked, k):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(1024 * x) for x in v]

    base = [(i, whole(v)) for i, v in rows if i is not None]
    out = []
    for q, v in asked:
        if q is None or whole(v) is None:
            continue
        scored = [(-sum(a * b for a, b in zip(whole(v), w)), i) for i, w in base if w is not None and i != q]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def run(spark, rows, asked, k=10):
    schema = "vec_id long, embedding array<float>, id string, v int"
    frame = lambda x: spark.createDataFrame([(i, v, "", 0) for i, v in x], schema)
    return sorted(map(tuple, ball_tree.top_k(frame(rows), frame(asked), k).collect()))


def test_against_all_pairs_with_many_shards(spark, monkeypatch):
    monkeypatch.setattr(ball_tree, "SHARD_VALUES", 900)
    monkeypatch.setattr(ball_tree, "QUERY_VALUES", 60)
    monkeypatch.setattr(ball_tree, "LEAF_ROWS", 8)
    rng = np.random.default_rng(2)
    # A few coarse values make ties; a third of the vectors are equal.
    rows = [(i, [0.25, 0.5, 0.25, 0.0, 0.75, 0.5] if i % 3 == 0 else (rng.integers(-4, 5, 6) / 4).tolist()) for i in range(700)]
    asked = [r for r in rows if r[0] % 20 == 0]
    assert run(spark, rows, asked) == plain(rows, asked, 10)


def test_vectors_that_take_no_part(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (None, [1.0, 1.0]), (6, [-0.3, 0.7]), (7, []), (8, [3.0]), (6, [-0.3, 0.7])]
    asked = [r for r in rows if r[0] != 6] + [(6, [-0.3, 0.7])] * 2
    assert run(spark, rows, asked) == plain(rows, dict(asked).items(), 10)


def test_scores_beyond_exact_floats(spark):
    rows = [(i, [1e6 + 3 * i, -1e6]) for i in range(40)]
    big = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(spark, rows, rows[:3]) == plain(big, big[:3], 10)


def test_empty_tables(spark):
    rows = [(1, [1.0]), (2, [2.0])]
    assert run(spark, [], []) == run(spark, rows, []) == run(spark, [], rows) == []


def test_search_stops_early():
    pick = random.Random(0)
    points = np.array([[pick.randrange(1000) + 5000 * (c % 9), 3 * c] for c in range(900)], np.int64)
    tree = ball_tree.BallTree(points, np.arange(900))
    assert len(tree.centres) > 8 and (tree.radii >= 0).all()
    found = tree.search(points[:1], np.array([0]), np.array([ball_tree.NO_FLOOR]), 5)
    want = sorted(((-int(points[0] @ p), i) for i, p in enumerate(points) if i))[:5]
    assert sorted((-s, i) for _, i, s in found) == want


def test_bounds_hold_where_large_terms_cancel():
    rng = np.random.default_rng(9)
    for _ in range(100):
        groups = rng.integers(-9e8, 9e8, (8, 2))
        groups[1::2] = groups[::2] + rng.integers(-2, 3, (4, 2))  # close to each other, far from the origin
        query = np.array([-groups[0, 1], groups[0, 0]])  # nearly at right angles: what is left is small
        points = np.repeat(groups, 200, axis=0)
        ids = rng.permutation(len(points))
        found = ball_tree.BallTree(points, ids).search(query[None, :], np.array([-1]), np.array([ball_tree.NO_FLOOR]), 10)
        scores = points.astype(object) @ query.astype(object)
        want = sorted(zip((-scores).tolist(), ids.tolist()))[:10]
        assert sorted((-s, i) for _, i, s in found) == want
