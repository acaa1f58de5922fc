import math
import os
import random
import re

import pytest

from tallyglass.llm import language_id as L
from tallyglass.llm.queries import op9_language_id
from tests.llm.test_quality import quality_fold as held_out_fold

SF_DIR = "/root/testdata/sf0.01"
ENTRIES = [(0, "house", "en", 30), (0, "haus", "de", 30), (0, "die", "de", 50), (0, "die", "en", 5)]
ENTRIES += [(n, g, lang, 10) for lang, w in (("en", "house"), ("de", "haus")) for n in range(1, 6) for g in L.grams_of(w, n)]


@pytest.fixture(scope="module")
def model():
    return L.Model(["de", "en"], ENTRIES)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_held_out_accuracy(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = op9_language_id(spark, SF_DIR).collect()
    assert len(rows) == len(langs) and {r.lang_pred for r in rows} <= {*langs.values(), "und"}
    asked = [r for r in rows if r.held_out]
    assert all(r.held_out == held_out_fold(r.doc_id) for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in asked) / len(asked) > 0.97


def test_words_first_then_shorter_and_shorter_grams(model):
    assert model.predict("House!")[0] == "en" and model.predict("HAUS die")[0] == "de"
    rows = {i: g for g, i in model.grams.items()}
    longest = lambda w: {rows[i] for i in model.fallback(w)}
    assert longest("houses") == {"_hous", "house"}
    assert longest("xhou") == {"hou"}
    assert longest("zsz") == {"_", "s"}
    assert model.fallback("qq") == {model.grams["_"]: 2}
    assert model.predict("houses")[0] == "en"


@pytest.mark.parametrize("text", [None, "", " 12 3.4 _ !", "１２", "½ ²³", "Ⅷ ①", "\u0301 \u093f"])
def test_no_letter_is_undetermined(model, text):
    assert model.predict(text) == ("und", 0.0)


def test_words_without_evidence_tie_to_the_first_language():
    bare = L.Model(["de", "en"], [(0, "a", "de", 1), (0, "b", "en", 1)])
    assert bare.predict("zzz") == ("de", 0.5)
    assert L.Model([], []).predict("text") == ("und", 0.0)


def test_fit_on_small_and_odd_tables(spark):
    schema = "doc_id long, text string, lang string, lang_pred int, score string"
    rows = [(i, "the house is here and there" if i % 2 else "das haus ist hier und dort", "en" if i % 2 else "de", 0, "") for i in range(60)]
    rows += [(100, None, "fr", 0, ""), (None, "das haus", None, 0, ""), (None, "x" * 300_000, "en", 0, ""), (7, "the", "en", 0, ""), (7, "the", "en", 0, "")]
    docs = spark.createDataFrame(rows, schema)
    found = L.identify(docs, L.fit(docs), keep=["doc_id"])
    assert found.columns == ["doc_id", "lang_pred", "score"] and found.count() == len(rows)
    by_id = {r.doc_id: r for r in found.collect()}
    assert by_id[1].lang_pred == "en" and by_id[2].lang_pred == "de" and by_id[100].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in by_id.values())
    empty = docs.limit(0)
    assert L.identify(empty, L.fit(empty), keep=["doc_id"]).count() == 0
    assert {r.lang_pred for r in L.identify(docs, L.fit(empty), keep=["doc_id"]).collect()} == {"und"}


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, "alpha beta" if held_out_fold(i) else "gamma delta", "xx" if held_out_fold(i) else "yy") for i in range(60)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["yy"] and "alpha" not in model.words and "gamma" in model.words


def test_marks_stay_in_their_words():
    assert L.words_of("हिन्दी भाषा") == {"हिन्दी": 1, "भाषा": 1}
    assert L.words_of("Étude e\u0301tude x²y") == {"étude": 1, "e\u0301tude": 1, "x": 1, "y": 1}


class Plain:
    """Counting and backing off with dictionaries alone, without any bound."""

    def __init__(self, rows):
        self.langs = sorted({lang for _, lang in rows})
        self.counts = {}
        for text, lang in rows:
            for word in re.findall(r"[^\W\d_]+", text.lower()):
                marked = f"_{word}_"
                for n in range(6):
                    for t in [word] if n == 0 else [marked[i : i + n] for i in range(len(marked) - n + 1)]:
                        self.counts.setdefault(n, {}).setdefault(t, dict.fromkeys(self.langs, 0))[lang] += 1

    def log(self, n, t):
        table = self.counts[n]
        return [math.log((table[t][x] + 0.5) / (sum(v[x] for v in table.values()) + 0.5 * len(table))) for x in self.langs]

    def predict(self, text):
        total = [0.0] * len(self.langs)
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            found = [(0, word)] if word in self.counts[0] else []
            for n in range(5, 0, -1):
                marked = f"_{word}_"
                if not found:
                    found = [(n, g) for g in (marked[i : i + n] for i in range(len(marked) - n + 1)) if g in self.counts[n]]
            for n, t in found:
                total = [a + b / len(found) for a, b in zip(total, self.log(n, t))]
        odds = [math.exp(x - max(total)) for x in total]
        best = odds.index(max(odds))
        return self.langs[best], odds[best] / sum(odds)


def test_against_a_plain_model(spark):
    pick = random.Random(6)
    parts = {"aa": ["the", "ing", "house", "zz"], "bb": ["das", "ung", "haus", "zz"], "cc": ["le", "tion", "maison", "é"]}
    rows = []
    for i in range(90):
        lang = pick.choice(list(parts))
        rows.append((i, " ".join("".join(pick.choices(parts[lang], k=pick.randint(1, 3))) for _ in range(8)), lang))
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    plain = Plain([(t, lang) for i, t, lang in rows if not held_out_fold(i)])
    asked = [t for _, t, _ in rows] + ["thehaus xyz", "houseung", "qqq", "maisons dasing 1"]
    for text in asked:
        lang, score = model.predict(text)
        want = plain.predict(text)
        assert lang == want[0] and score == pytest.approx(want[1], rel=1e-4)


def test_a_small_language_keeps_its_entries_among_large_ones(spark):
    pick = random.Random(7)
    word = lambda letters: "".join(pick.choices(letters, k=6))
    rows = [(i, " ".join(word("abcdefgh") for _ in range(30)), "big") for i in range(400)] + [(1000 + i, " ".join(word("abklmno") for _ in range(30)), "small") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs, words_per_language=50, grams_per_length=200)
    own = [g for g, entry in model.grams.items() if set(g) & set("klmno") and len(g) == 5]
    assert 100 <= len(own) <= 260
    assert len(model.words) <= 2 * 60  # about as many as asked for, of each language
    assert all(model.predict(" ".join(word("abklmno") for _ in range(5)))[0] == "small" for _ in range(50))
    assert model.predict(word("abcdefgh") + " " + word("cdefgh"))[0] == "big"


def test_a_word_as_long_as_a_text(spark):
    rows = [(i, "abcde" * 40_000, "aa") for i in range(4)] + [(10 + i, "vwxyz" * 10, "bb") for i in range(4)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {"abcde", "eabcd"} <= set(model.grams)
    assert model.predict("vw" + "abcde" * 100_000)[0] == "aa" and model.predict("xvwxyzv")[0] == "bb"
