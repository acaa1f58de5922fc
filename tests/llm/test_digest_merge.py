import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from tallyglass.llm import digest_merge

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(BLANK.sub(" ", text or "").encode()).hexdigest()


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[sha(t)].append(i)
    keep = {h: min((i for i in ids if i is not None), default=None) for h, ids in groups.items()}
    return Counter((i, keep[sha(t)], len(groups[sha(t)]), sha(t)) for i, t in rows), {h: keep[h] for h in groups}


def check(spark, rows, fanout=8, parts=5):
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, sha string, `row` int").repartition(parts)
    got = digest_merge.classes(docs, fanout=fanout).collect()
    want, keep = expected(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted(keep)  # one of each group
    assert all(r.doc_id == keep[r.text_sha256] for r in kept)
    return docs


@pytest.mark.parametrize(("fanout", "parts"), [(2, 13), (8, 13), (3, 1)])
def test_against_groups_in_a_dictionary(spark, fanout, parts):
    pick = random.Random(4)
    texts = ["", None, " ", "\n \t", " a", "a", "a b", "a\x0b\r\nb", "a b", "a  b "] + [f"t {pick.randrange(40)}" for _ in range(60)]
    rows = [(n, pick.choice(texts)) for n in range(300)] + [(1000 + n, "hot\ttext" if n % 2 else "hot text") for n in range(150)]
    pick.shuffle(rows)
    check(spark, rows, fanout, parts)


def test_repeated_and_missing_ids(spark):
    rows = [(5, "x"), (5, "x"), (None, "x"), (None, "y"), (None, "y"), (7, "y z"), (7, "z"), (3, "z"), (3, "z")]
    docs = check(spark, rows)
    left = digest_merge.distinct_documents(docs)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), r.text, r.sha, r.row) for r in left.collect()) == [
        ("3", "z", "n", 1), ("5", "x", "n", 1), ("7", "y z", "n", 1), ("None", "y", "n", 1),
    ]


def test_empty_table_and_long_text(spark):
    assert digest_merge.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    check(spark, [(1, "ab  " * 500_000), (2, "ab \n" * 500_000), (3, "ab " * 500_001)])


def test_entries_of_a_heavy_text_are_one_a_run(spark):
    docs = spark.range(0, 4000, 1, 40).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot', CAST(id AS STRING)) AS text")
    rows = digest_merge.digests(digest_merge._numbered(docs, "doc_id", "text"))
    first, last = digest_merge.merge_runs(rows)
    hot = hashlib.sha256(b"hot").hexdigest()
    assert first.where(f"sha = '{hot}'").count() == 40
    assert [(r.n, r.least.id) for r in last.where(f"sha = '{hot}'").collect()] == [(1334, 0)]
    assert last.select("run").distinct().count() == 1
    with pytest.raises(ValueError):
        digest_merge.merge_runs(rows, fanout=1)
