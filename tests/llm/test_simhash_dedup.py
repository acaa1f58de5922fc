import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyglass.llm import simhash_dedup
from tallyglass.llm.components import connected_components


def plain_fingerprint(text, size=4):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, bits=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= bits:
            root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {(ids[i], fps[i]): min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))}


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "fp", 0) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = simhash_dedup.near_duplicates(docs).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    want = plain_components([i for i, _ in rows], fps)
    key = lambda r: tuple((x is not None, x) for x in r)
    expected = [(i, f"{f:016x}", want[i, f]) for (i, _), f in zip(rows, fps, strict=True)]
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_against_all_pairs(spark):
    pick = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"w{pick.randrange(5000)}" for _ in range(pick.choice([3, 30, 200]))]
        for _ in range(pick.choice([1, 2, 25])):
            copy = list(base)
            for _ in range(pick.randrange(4)):
                copy[pick.randrange(len(copy))] = f"x{pick.randrange(9)}"
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    check(spark, rows)


def test_nulls_blank_short_and_repeated_texts(spark):
    check(spark, [
        (5, None), (3, ""), (9, " \t\n"), (8, "One"), (1, "one"), (2, "one two three four"), (2, "ONE two\x0bthree four"),
        (None, "alone here"), (None, None), (4, "É é"), (6, "é é"), (7, "x" * 200_000), (7, "x" * 200_000),
    ])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = simhash_dedup.near_duplicates(docs)
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0


def test_keys_find_every_pair_within_four_bits():
    rng = np.random.default_rng(1)
    for bits in range(5):
        for _ in range(300):
            a = int(rng.integers(0, 2**63))
            b = a
            for at in rng.choice(64, bits, replace=False):
                b ^= 1 << int(at)
            where, keys = simhash_dedup.fuzzy_keys(np.array([a, b], np.uint64).view(np.int64))
            assert set(keys[where == 0]) & set(keys[where == 1])


def test_every_word_is_within_three_bits_of_its_codeword():
    table = simhash_dedup.golay_indices()
    assert table.min() == 0 and (np.bincount(table) == 2048).all()


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BLOCK_ROWS", 40)
    pick = random.Random(5)
    fps = {0}
    while len(fps) < 300:
        x = pick.choice(sorted(fps))
        fps.add(x ^ (1 << pick.randrange(20)))
    rows = spark.createDataFrame([(1, x) for x in fps], "key long, fp long")
    got = connected_components(simhash_dedup._late_links(rows, 4)).collect()
    want = plain_components(sorted(fps), sorted(fps))
    roots = {}
    for r in got:
        roots.setdefault(r.root, set()).add(r.node)
    classes = {}
    for (i, _), c in want.items():
        classes.setdefault(c, set()).add(i)
    assert sorted(map(sorted, roots.values())) == sorted(sorted(c) for c in classes.values() if len(c) > 1)


def test_buckets_beyond_what_a_task_holds(monkeypatch, spark):
    # Fingerprints that differ in one segment only share whole keys, so buckets outgrow these limits.
    for name, value in (("HELD_ROWS", 256), ("BUCKET_ROWS", 64), ("BLOCK_ROWS", 32)):
        monkeypatch.setattr(simhash_dedup, name, value)
    pick = random.Random(8)
    fps = {0, *(1 << 50 | pick.randrange(1 << 22) for _ in range(20))}
    while len(fps) < 500:
        fps.add(pick.choice(sorted(fps)) ^ (1 << pick.randrange(22)) ^ (1 << pick.randrange(22)))
    rows = spark.createDataFrame([(x,) for x in fps], "fp long").coalesce(1)
    got = {}
    for r in connected_components(simhash_dedup.links(rows)).collect():
        got.setdefault(r.root, set()).add(r.node)
    want = {}
    for (i, _), c in plain_components(sorted(fps), sorted(fps)).items():
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(c) for c in want.values() if len(c) > 1)


def test_keys_are_written_by_many_tasks(monkeypatch, spark):
    # One file holds far more fingerprints than the keys of which one task should sort.
    monkeypatch.setattr(simhash_dedup, "KEYED_ROWS", 64)
    rows = spark.range(0, 500, 1, 1).select(F.xxhash64("id").alias("fp"))
    plans = []

    def kept(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    monkeypatch.setattr(simhash_dedup, "stored", kept)
    simhash_dedup.links(rows)
    assert "RepartitionByExpression [fp#" in plans[0] and "], 8" in plans[0]
    sizes = [r["count"] for r in simhash_dedup._dealt(rows).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and sum(sizes) == 500 and max(sizes) < 2 * 64
    assert simhash_dedup._dealt(rows.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 12])
def test_components_of_a_path(spark, n):
    order = list(range(n + 1))
    random.Random(n).shuffle(order)
    edges = spark.createDataFrame([*zip(order, order[1:]), (3, 3), (None, 1)], "a long, b long")
    out = {r.node: r.root for r in connected_components(edges).collect()}
    assert out == {i: 0 for i in range(n + 1)}


def test_bits_out_of_range(spark):
    with pytest.raises(ValueError):
        simhash_dedup.links(spark.range(3).withColumnRenamed("id", "fp"), 5)
