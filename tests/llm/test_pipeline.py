"""The stages, each held against plain Python on its own input."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from tallyglass.llm.queries import SOURCE_WEIGHTS
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_simhash_dedup import plain_components, plain_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, shard int"
SYLLABLES = {"en": "the and of house tree water stone light".split(), "de": "der und von haus baum wasser stein licht".split()}


def make(seed=1, n=160):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        lang = pick.choice(["en", "en", "de"])
        text = " ".join(pick.choice(SYLLABLES[lang]) + str(pick.randrange(40)) + pick.choice(SYLLABLES[lang]) for _ in range(pick.choice([6, 40, 120])))
        rows.append([i, text, lang, f"src{pick.randrange(4)}", len(text), 0, 0])
    for i in range(0, 30):
        copy = rows[pick.randrange(n)]
        words = copy[1].split()
        if i % 2:
            words[pick.randrange(len(words))] = "edited"
        rows.append([n + i, " ".join(words), copy[2], copy[3], 0, 0, 0])
    rows += [[900, None, None, None, None, 0, 0], [901, "", "en", "src1", 0, 0, 0], [902, "12 34 !", "en", "src1", 7, 0, 0], [903, rows[0][1].upper(), "en", None, 1, 0, 0]]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = make()
    spark.createDataFrame([(i, rows[i * 11][1]) for i in range(6)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_one_by_one(spark, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_dedup", "decontaminate", "mix_sources", "kd_shards"]
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    before = texts(docs)

    kept = stages["language_id"](spark, docs, folder).cache()
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    assert set(before) - set(texts(kept)) == {900, 901, 902}

    one = stages["simhash_dedup"](spark, kept, folder).cache()
    ids, fps = zip(*[(i, plain_fingerprint(t)) for i, t in texts(kept).items()], strict=True)
    want = {i for (i, _), c in plain_components(ids, fps).items() if i == c}
    assert set(texts(one)) == want and 0 < len(want) < len(ids)

    clean = stages["decontaminate"](spark, one, folder).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    dirty = {d for d, *_ in plain_hits(texts(one).items(), items)}
    assert dirty and set(texts(clean)) == set(texts(one)) - dirty

    mixed = stages["mix_sources"](spark, clean, folder).cache()
    assert mixed.columns == list(corpus_pipeline.COLUMNS)
    assert all(texts(clean)[r.doc_id] == r.text for r in mixed.collect()) and SOURCE_WEIGHTS

    out = stages["kd_shards"](spark, mixed, folder).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mixed.collect())
    slots = Counter((r.shard, r.slot) for r in out)
    assert max(slots.values()) == 1 and all((s, k) in slots for s, n in Counter(r.shard for r in out).items() for k in range(n))

    again = corpus_pipeline.run(spark, folder)
    assert Counter((r.doc_id, r.size, r.shard) for r in again.collect()) == Counter((r.doc_id, r.size, r.shard) for r in out)


def test_stages_on_empty_and_repeated_rows(spark, folder):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
    row = (5, "the house and the tree " * 9, "en", "src0", 1, 0, 0)
    twice = spark.createDataFrame([row, row, (6, *row[1:]), (None, *row[1:])], SCHEMA)
    kept = corpus_pipeline.dedup(spark, twice, folder).collect()
    assert [r.doc_id for r in kept] == [5]


def test_dedup_keeps_one_row_of_each_group(spark, folder):
    def row(i, text):
        return (i, text, "en", "src0", 1, 0, 0)

    a, b, c = ("one house by the water " * 9, "nobody saw seven grey stones fall " * 9, "it was a light too far away to be of use " * 9)
    # One id under two texts, one of which has a smaller id elsewhere; a group without an id; repeated rows.
    docs = spark.createDataFrame([row(7, a), row(7, b), row(3, b), row(3, b), row(None, a), row(None, c), row(None, c)], SCHEMA)
    kept = corpus_pipeline.dedup(spark, docs, folder).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("7", a), ("3", b), ("None", c)])
