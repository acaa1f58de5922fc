import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tallyglass.llm import lyndon_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_lyndon(ranks):
    n = len(ranks)

    def is_lyndon(w):
        return all(w < w[k:] for k in range(1, len(w)))

    return [max(k for k in range(1, n - i + 1) if is_lyndon(ranks[i : i + k])) for i in range(n)]


def plain_runs(words, least):
    """Every period by itself, word by word."""
    n, found = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            end = i + p
            smaller = any(all(words[x] == words[x + q] for x in range(start, end - q)) for q in range(1, p))
            if end - start >= max(least, 2 * p) and not smaller:
                found.append((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_result(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words, 12)
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{k},{p}\n" for s, k, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def sequences():
    pick = random.Random(5)
    for _ in range(400):
        yield [pick.randrange(pick.randint(1, 4)) for _ in range(pick.randint(1, 26))]
    for _ in range(300):
        made = []
        while len(made) < pick.randint(20, 110):
            period = [pick.randrange(pick.choice([2, 3, 60])) for _ in range(pick.randint(1, 15))]
            made += (period * pick.randint(1, 4))[: pick.randint(1, 40)]
        yield made


def test_lyndon_array():
    for ranks in sequences():
        if len(ranks) < 30:
            assert lyndon_runs.lyndon_array(ranks) == plain_lyndon(ranks)


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_words(least):
    for ids in sequences():
        words = [b"%d" % i for i in ids]
        assert lyndon_runs.runs_of(np.array(ids), least) == plain_runs(ids, least)
        assert lyndon_runs.document_runs(words, least) == plain_runs(ids, least)


def test_wrong_hashes_change_nothing(monkeypatch):
    monkeypatch.setattr(lyndon_runs, "MODULI", ((7, 3),))
    for ids in sequences():
        assert lyndon_runs.runs_of(np.array(ids), 4) == plain_runs(ids, 4)


def test_long_sequences_take_linear_time():
    fibonacci, more = [0], [0, 1]
    while len(more) < 60_000:
        fibonacci, more = more, more + fibonacci
    assert lyndon_runs.runs_of(np.array([3] * 50_000)) == [(0, 50_000, 1)]
    assert lyndon_runs.runs_of(np.arange(50_000)) == []
    period = list(range(700)) * 60
    assert lyndon_runs.runs_of(np.array(period)) == [(0, 42_000, 700)]
    assert len(lyndon_runs.runs_of(np.array(more[:60_000]))) > 10_000


def test_query_against_every_period(spark, tmp_path):
    pick = random.Random(8)
    texts = [None, "", " \n\t", "a", "a " * 11, "a " * 12, "x " + "b c " * 9 + "\x0b b c", "w w " * 13]
    for n in [3, 12, 40, 90] * 20:
        line = " ".join(f"w{pick.randrange(30)}" for _ in range(n))
        texts.append(line + pick.choice(["", "\n" + line, " tail " + " ".join(["again and"] * 8)]))
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "q " * 20), (6, "a b " * 20), (6, "a b " * 20)]
    frame = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id long, text string, runs string, collapsed int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted((plain_result(*r) for r in rows), key=key)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) >= 5


def test_tables_without_rows_and_other_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lyndon_runs.find_runs(empty).collect() == []
    named = spark.createDataFrame([("k", "on and " * 10, "x")], "name string, `text` string, n_words string")
    row = lyndon_runs.find_runs(named.drop("n_words"), keep=["name"]).first()
    assert (row.name, row.n_words, row.runs[0].asDict(), row.collapsed) == ("k", 20, {"start": 0, "length": 20, "period": 2}, "on and")
