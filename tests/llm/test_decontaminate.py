import random
import re

import numpy as np

from tallyglass.llm import decontaminate as D
from tallyglass.llm.common import words


def plain(docs, items, similarity=0.8, size=5):
    """Every window against every item of its size."""
    def cut(t):
        return [w.lower().encode() for w in re.findall(r"[^\W_]+", t or "")]

    out = {}
    for d, text in docs:
        found = cut(text)
        for i, item in items:
            want = cut(item)
            if i is None or not want or not found:
                continue
            span = min(len(want), len(found))
            for at in range(len(found) - span + 1):
                value = D.weighted_similarity(D._shingles(found[at : at + span], size), D._shingles(want, size))
                if value >= similarity and value > out.get((d, i), (0, 0))[1]:
                    out[d, i] = (at, value)
    return {(d, i, at, round(v, 9)) for (d, i), (at, v) in out.items()}


def found(spark, docs, items, **named):
    d = spark.createDataFrame([(i, t, "", 0) for i, t in docs], "doc_id long, text string, item_id string, bits int")
    b = spark.createDataFrame([(i, t, "") for i, t in items], "item_id long, text string, doc_id string")
    return D.find(d, b, **named), D.clean(d, b, **named)


def test_against_every_window(spark):
    pick = random.Random(8)
    word = lambda: f"w{pick.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(pick.choice([2, 5, 12, 30, 30, 45])))) for i in range(25)] + [(40, "w1 w1 w1 w1 w1 w1 w1 w1 w1"), (41, "W3, w4!"), (42, "w3 w4")]
    docs = []
    for d in range(120):
        body = [word() for _ in range(pick.choice([0, 3, 40, 150]))]
        for _ in range(pick.randrange(3)):
            text = pick.choice(items)[1].split()
            kind = pick.randrange(4)
            if kind == 1:
                text[pick.randrange(len(text))] = "changed"
            if kind == 2:
                text = text[: max(1, len(text) - 2)]
            if kind == 3:
                text = [t.upper() + "," for t in text]
            at = pick.randrange(len(body) + 1)
            body[at:at] = text
        docs.append((d, " ".join(body)))
    hits, rest = found(spark, docs, items)
    want = plain(docs, items)
    assert {(r.doc_id, r.item_id, r.word_start, round(r.similarity, 9)) for r in hits.collect()} == want and len(want) > 60
    assert {r.doc_id for r in rest.collect()} == {d for d, _ in docs} - {d for d, *_ in want}


def test_nulls_empty_tables_and_repeated_rows(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = [(1, None), (2, ""), (None, "x " + passage), (3, passage), (3, passage), (4, "... !!!"), (5, passage * 3000), (6, " ".join(f"p{i}" for i in range(18)))]
    items = [(7, passage), (8, passage), (None, passage), (9, None), (10, "")]
    hits, rest = found(spark, docs, items)
    got = sorted((r.doc_id or 0, r.item_id, round(r.similarity, 3)) for r in hits.collect())
    # Document 5 runs the passages together, which spoils one word in twenty.
    assert [(d, i) for d, i, _ in got] == [(0, 7), (0, 8), (3, 7), (3, 7), (3, 8), (3, 8), (5, 7), (5, 8), (6, 7), (6, 8)]
    assert {s for d, _, s in got if d == 5} == {round(15 / 17, 3)}
    assert {r.doc_id for r in rest.collect()} >= {1, 2, 4}
    for d, b in (([], items), (docs, [])):
        hits, rest = found(spark, d, b)
        assert hits.count() == 0 and rest.count() == len(d) and hits.columns[:2] == ["doc_id", "item_id"]


def test_words_are_letters_and_digits_of_every_script():
    cases = {
        "\u201cCaf\u00e9\u201d \u2014 it\u2019s\u2026": ["caf\u00e9", "it", "s"],
        "a\u00a0b\u3000c\u2014d_e": ["a", "b", "c", "d", "e"],
        "\u00abSTRA\u00dfE\u00bb 12\u00a0000\u20ac": ["stra\u00dfe", "12", "000"],
        "\u4f60\u597d\uff0c\u4e16\u754c\u3002": ["\u4f60\u597d", "\u4e16\u754c"],
        "\u0130zmir \u041c\u0418\u0420": ["i\u0307zmir", "\u043c\u0438\u0440"],
        "\u2026\u2014\u201d": [],
        "ASCII only_2": ["ascii", "only", "2"],
    }
    for text, want in cases.items():
        assert words(text.encode()) == [w.encode() for w in want]
    assert words(b"cut \xe2\x80 off") == [b"cut", b"off"]


def test_passages_in_typographic_quotes_and_with_other_spaces(spark):
    passage = "What is the largest lake in the world by surface area and by volume"  # 14 words
    short = "name three rivers of Europe"
    docs = [
        (1, f"as asked \u201c{passage}\u201d by many"),
        (2, "before " + passage.replace(" ", "\u00a0") + " after"),
        (3, f"list\u2014{short}\u2026"),
        (4, f"\u00ab\u00a0{passage}\u00a0\u00bb\u3000{short}"),
        (5, "\u201cnothing of the kind\u201d \u2014 a clean text\u2026"),
    ]
    hits, rest = found(spark, docs, [(1, passage), (2, short)])
    got = {(r.doc_id, r.item_id, r.word_start, r.window_words, r.similarity) for r in hits.collect()}
    assert got == {(1, 1, 2, 14, 1.0), (2, 1, 1, 14, 1.0), (3, 2, 1, 5, 1.0), (4, 1, 0, 14, 1.0), (4, 2, 14, 5, 1.0)}
    assert [r.doc_id for r in rest.collect()] == [5]


def test_blocks_of_items_are_all_searched(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 300)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(8))) for i in range(20)]
    docs = [(i, f"before {t} after") for i, t in items]
    hits, rest = found(spark, docs, items)
    assert {(r.doc_id, r.item_id) for r in hits.collect()} == {(i, i) for i in range(20)} and rest.count() == 0


def test_repeated_items_count_once(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 300)
    same, other = " ".join(f"s{k}" for k in range(8)), " ".join(f"o{k}" for k in range(8))
    items = [(1, same)] * 200 + [(2, other), (3, same)]
    b = spark.createDataFrame(items, "item_id long, text string")
    blocks = [block.value for block in D._blocks(b, "item_id", "text")]
    assert sorted(row for block in blocks for row in block) == [(1, same.encode()), (2, other.encode()), (3, same.encode())]
    hits, rest = found(spark, [(1, f"x {same}"), (2, other), (3, "clean")], items)
    assert sorted((r.doc_id, r.item_id) for r in hits.collect()) == [(1, 1), (1, 3), (2, 2)] and [r.doc_id for r in rest.collect()] == [3]


def test_blocks_of_bits_miss_no_fingerprint_within_the_radius():
    rng = np.random.default_rng(4)
    items = [(i, [f"a{i}b{k}".encode() for k in range(30)]) for i in range(50)]
    size = D._Size(30, items, 5, D.MAX_BITS)
    fps = size.fps[rng.integers(0, 50, 3000)].copy()
    for row in fps:
        for bit in rng.choice(64, rng.integers(0, 30), replace=False):
            row[bit // 8] ^= 1 << (bit % 8)
    apart = np.bitwise_count(fps[:, None] ^ size.fps[None]).sum(axis=2)
    window, item, bits = size.candidates(fps)
    assert set(zip(window.tolist(), item.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(apart <= D.MAX_BITS)), strict=True))
    assert (bits == apart[window, item]).all()


def test_similar_passages_lie_within_the_radius():
    """A similarity of 0.8 differs by far fewer bits than the radius, for long and short items."""
    pick = random.Random(6)
    worst = 0
    for _ in range(400):
        item = [f"t{pick.randrange(10**6)}" for _ in range(pick.choice([12, 20, 40, 60]))]
        cut = item[pick.randrange(2) :] + [f"z{pick.randrange(99)}"]
        text = " ".join(cut[: len(item)]).encode()
        a, b = (D.window_fingerprints(D.shingle_hashes(D.word_hashes(w), 5), len(w) - 4) for w in (item_bytes(item), words(text)))
        if D.weighted_similarity(D._shingles(item_bytes(item), 5), D._shingles(words(text), 5)) >= 0.8:
            worst = max(worst, int(np.bitwise_count(a ^ b).sum()))
    assert 0 < worst <= D.MAX_BITS


def item_bytes(item):
    return [w.encode() for w in item]
