import random
import zlib
from collections import defaultdict

import pytest

from tallyglass.llm import kd_shards


def shards(spark, rows, **named):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int, size string, h int, node int")
    return kd_shards.kd_shards(docs, **named).collect()


def check(rows, out, n):
    by_id = defaultdict(list)
    for r in rows:
        by_id[r[0]].append((r[1] or "").encode())
    for r in out:
        assert any(r.size == len(t) + 1 and r.text_crc32 == zlib.crc32(t) for t in by_id[r.doc_id])
    assert sorted((r.doc_id is not None, r.doc_id) for r in out) == sorted((r[0] is not None, r[0]) for r in rows)
    slots = defaultdict(list)
    for r in out:
        assert 0 <= r.shard < n and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, 0, "", 0, 0)


@pytest.mark.parametrize("n", [1, 3, 8])
def test_near_equal_bytes_and_whole_groups(spark, n):
    rows = [doc(i, f"text {i // 2} " * (1 + i * 7 % 40), ("en", "de", None)[i % 3], f"s{i % 7}") for i in range(1600)]
    out = shards(spark, rows, shards=n)
    check(rows, out, n)
    size = defaultdict(int)
    texts = defaultdict(set)
    for r in out:
        size[r.shard] += r.size
        texts[r.text_crc32].add(r.shard)
    assert len(size) == n and max(size.values()) < 1.05 * min(size.values())
    assert all(len(s) == 1 for s in texts.values())


def test_a_third_of_all_rows_is_one_text(spark):
    rows = [doc(i, "the same text again" if i % 3 == 0 else f"text {i} " * (1 + i % 9)) for i in range(3000)]
    out = shards(spark, rows, shards=8)
    check(rows, out, 8)
    size = defaultdict(int)
    for r in out:
        size[r.shard] += r.size
    assert len(size) == 8 and max(size.values()) < 1.1 * min(size.values())


@pytest.mark.parametrize("repeated", [9, None])
def test_a_third_of_all_rows_is_one_row(spark, monkeypatch, repeated):
    monkeypatch.setattr(kd_shards, "RUN_ROWS", 16)
    rows = [doc(repeated, "the same row over and again", ("en", "de")[i % 2]) if i % 3 == 0 else doc(i, f"text number {i} " * 2) for i in range(6000)]
    out = shards(spark, rows, shards=8)
    check(rows, out, 8)
    size, held = defaultdict(int), defaultdict(int)
    for r in out:
        size[r.shard] += r.size
        held[r.shard] += r.doc_id == repeated
    assert len(size) == 8 and max(size.values()) < 1.1 * min(size.values())
    assert sum(held.values()) == 2000 and max(held.values()) < 1000


def test_equal_rows_are_numbered_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(kd_shards, "SLOT_ROWS", 200)
    monkeypatch.setattr(kd_shards, "RUN_ROWS", 10)
    rows = spark.createDataFrame([(1, 5, 9, 2000, 0), (2, 6, 8, 1, 0), (2, 6, 8, 3, 1)], "id long, size long, crc long, n long, shard int")
    out = kd_shards._slots(rows).collect()
    assert sorted(r.slot for r in out if r.shard == 0) == list(range(2001))
    assert sorted(r.slot for r in out if r.shard == 1) == [0, 1, 2]
    held = defaultdict(int)
    for r in out:
        held[r.part] += 1
    assert len(held) > 10 and max(held.values()) <= 400


def test_nulls_ties_and_small_tables(spark):
    rows = [doc(1, None, None, None), doc(1, None, None, None), doc(None, ""), doc(2, "x" * 300_000), doc(3, "é")]
    out = shards(spark, rows, shards=8)
    check(rows, out, 8)
    assert shards(spark, [], shards=8) == []


def test_target_bytes(spark):
    rows = [doc(i, "abcdefghi" + str(i)) for i in range(1000)]
    total = sum(len(r[1]) + 1 for r in rows)
    out = shards(spark, rows, target_bytes=total // 4 + 1)
    check(rows, out, 4)
    assert {r.shard for r in out} == {0, 1, 2, 3}


def test_thousands_of_leaves_within_their_bytes_and_a_plan_as_for_eight(spark):
    pick = random.Random(5)
    rows = [doc(i, f"w{i} " * pick.randint(1, 30), pick.choice(["en", "de"]), pick.choice("abc")) for i in range(7000)] + [doc(9000, "long " * 3000)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int, size string, h int, node int")
    many, few = kd_shards.kd_shards(docs, max_bytes=130), kd_shards.kd_shards(docs, max_bytes=100_000)
    plans = [len(d._jdf.queryExecution().optimizedPlan().toString()) for d in (many, few)]
    assert plans[0] < 1.1 * plans[1]
    held, texts = defaultdict(int), defaultdict(set)
    out = many.collect()
    check(rows, out, len({r.shard for r in out}))
    for r in out:
        held[r.shard] += r.size
        texts[r.shard].add(r.text_crc32)
    assert len(held) > 4000 and all(n <= 130 or len(texts[s]) == 1 for s, n in held.items())


def test_texts_with_most_rows_but_few_bytes_stay_whole(spark):
    rows = [doc(i, "", ("en", "de")[i % 2]) if i % 3 == 0 else doc(i, f"text {i} " * 30) for i in range(3000)]
    out = shards(spark, rows, shards=8)
    check(rows, out, 8)
    assert len({r.shard for r in out if r.size == 1}) == 1


def plain_tree(points, shards):
    """Leaf of every point, by sorting each node and walking its weights."""
    out, todo = {}, [(1, shards, points)]
    while todo:
        node, leaves, mine = todo.pop()
        if leaves == 1 or not mine:
            out |= {p["key"]: node for p in mine}
            continue
        width = [max(p["x"][i] for p in mine) - min(p["x"][i] for p in mine) for i in range(3)]
        axis = width.index(max(width))
        mine.sort(key=lambda p: (p["x"][axis], p["tie"]))
        goal = sum(p["w"] for p in mine) * (leaves // 2) / leaves
        below = cut = 0
        for at, p in enumerate(mine):
            if below <= goal:
                cut = at
            below += p["w"]
        todo += [(2 * node, leaves // 2, mine[:cut]), (2 * node + 1, leaves - leaves // 2, mine[cut:])]
    return out


def test_no_join_is_without_keys(spark, monkeypatch):
    plans = []
    keep = kd_shards.stored
    monkeypatch.setattr(kd_shards, "stored", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, label))
    out = shards(spark, [doc(i, f"text {i}", ("en", "de")[i % 2]) for i in range(60)], shards=4)
    assert len(out) == 60 and sum("Join" in p for p in plans) > 8
    assert not any("NestedLoop" in p or "Cartesian" in p for p in plans)


@pytest.mark.parametrize("n", [2, 5, 8, 13])
def test_cuts_are_those_of_a_plain_tree(spark, n):
    pick = random.Random(n)
    points = [
        {"key": k, "x": [pick.choice([pick.randrange(1 << 20), 7]), pick.randrange(4) * 1000, pick.choice([0, 1 << 19])], "w": pick.randint(1, 500), "tie": pick.randrange(1 << 43)}
        for k in range(700)
    ]
    frame = spark.createDataFrame([(p["key"], 0, p["w"], *p["x"], p["tie"]) for p in points], "h long, piece int, w long, x0 long, x1 long, x2 long, tie long")
    got, _ = kd_shards._tree(frame, n, 3)
    assert {r.h: r.node for r in got.collect()} == plain_tree(points, n)
