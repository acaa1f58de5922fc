import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.llm import quality
from tallyglass.llm.queries import op6_quality

SF_DIR = "/root/testdata/sf0.01"


def area(labels, scores):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    good = np.array(labels) == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = op6_quality(spark, SF_DIR).collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    asked = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert area([labels[r.doc_id] for r in asked], [r.score for r in asked]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_labels_of_the_held_out_fold_are_never_learned(spark):
    docs = spark.createDataFrame([(i, f"word{i % 2} text") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    flipped = spark.createDataFrame([(i, i % 2 ^ int(quality_fold(i))) for i in range(300)], "doc_id long, quality int")
    assert (quality.fit(docs, labels) == quality.fit(docs, flipped)).all()


def quality_fold(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 3 == 1


def test_scores_do_not_depend_on_other_columns_and_cover_every_text(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "good words", "z"), (5, "!!! ???", "z"), (6, "long " * 200_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    weights = np.zeros(1 << quality.BUCKET_BITS)
    weights[0] = 0.7
    out = quality.score(docs, weights).collect()
    assert len(out) == 6 and {round(r.score, 6) for r in out} == {round(1 / (1 + np.exp(-0.7)), 6)}
    assert quality.score(docs.limit(0), weights).count() == 0


def test_no_labels_and_conflicting_labels(spark):
    docs = spark.createDataFrame([(0, "a b"), (2, "c d")], "doc_id long, text string")
    none = spark.createDataFrame([(0, None), (None, 1)], "doc_id long, quality int")
    assert not quality.fit(docs, none).any()
    mixed = spark.createDataFrame([(0, 1), (0, 0), (0, 0), (2, 1), (2, 0)], "doc_id long, quality int")
    got = {bytes(r.t): r.y for r in quality.labelled_rows(docs, mixed).collect()}
    assert got == {k: v for i, (k, v) in {0: (b"a b", 0), 2: (b"c d", 1)}.items() if not quality_fold(i)}


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(3000)] + [(0, "u")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(3000)], "doc_id long, quality int")
    assert 150 < quality.labelled_rows(docs, labels, limit=200).count() < 260


def test_training_separates():
    rows = [(*quality.features(f"{'good' if i % 2 else 'bad'} word{i}".encode()), i % 2) for i in range(200)]
    w = quality.train(rows)
    for text, sign in ((b"good stuff", 1), (b"BAD stuff", -1)):
        at, x = quality.features(text)
        assert np.sign(w[at] @ x) == sign


def plain_ftrl(rows, epochs=4, alpha=0.5, beta=1.0, l1=1e-4, l2=1e-6):
    """FTRL-proximal feature by feature, on dictionaries."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * l1) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for x, y in rows:
            p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
            w = {i: weight(i) for i in x}
            for i, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_updates_are_those_of_a_plain_loop():
    pick = random.Random(3)
    texts = [" ".join(pick.choice(["fine", "prose", "here", "win", "cash", "!!!"]) for _ in range(pick.randint(0, 12))) for _ in range(60)]
    rows = [(*quality.features(t.encode()), int("cash" not in t)) for t in texts]
    got = quality.train(rows)
    want = plain_ftrl([(dict(zip(at.tolist(), x.tolist(), strict=True)), y) for at, x, y in rows])
    assert {i for i, w in want.items() if w} == set(np.flatnonzero(got).tolist())
    assert all(got[i] == pytest.approx(w, rel=1e-9, abs=1e-12) for i, w in want.items())


def test_a_fit_averages_the_plain_loops_of_its_parts(spark):
    pick = random.Random(4)
    docs = [(i, " ".join(pick.choice(["fine", "prose", "win", "cash"]) for _ in range(6))) for i in range(90)]
    labels = [(i, int(t.count("cash") < 2)) for i, t in docs]
    frames = (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    # A part is what one task gets of the rows dealt by their hash.
    dealt = quality.labelled_rows(*frames).repartition(quality.PARTS, F.pmod("h", F.lit(quality.PARTS)))
    rows = sorted((r.h, bytes(r.t), r.y, r.part) for r in dealt.withColumn("part", F.spark_partition_id()).collect())
    assert sorted(t for _, t, *_ in rows) == sorted(t.encode() for i, t in docs if not quality_fold(i))
    total = {}
    for part in {r[3] for r in rows}:
        mine = [(dict(zip(*(a.tolist() for a in quality.features(t)), strict=True)), y) for _, t, y, at in rows if at == part]
        for i, w in plain_ftrl(mine).items():
            total[i] = total.get(i, 0.0) + w * len(mine) / len(rows)
    got = quality.fit(*frames)
    assert all(got[i] == pytest.approx(w, rel=1e-9, abs=1e-12) for i, w in total.items()) and np.count_nonzero(got) <= len(total)
