"""Language identification: known words first, then ever shorter character n-grams.

A word of the vocabulary counts with its log frequency in each language.  An unseen word falls back to
the longest n-grams of it that are known (five characters, then four, down to one), and counts with
their mean log frequency.  The scores of all words add up; the result is the most probable language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.llm.common import held_out, stored

UNKNOWN = "und"
LONGEST = 5
# Bounds of the fitted model, each for one language: documents learned from, words, and n-grams of each length.  A language
# keeps its share whatever the others are; about 45,000 entries, a few MB, are added by each.
DOCS_PER_LANGUAGE = 5_000
WORDS_PER_LANGUAGE = 20_000
GRAMS_PER_LENGTH = 5_000

# Words whose evidence a task keeps at hand, and letters beyond which a word is taken n-gram by n-gram.
WORDS_REMEMBERED, LONG_WORD = 50_000, 40

# A word is a run of letters with the marks that combine with them.
_ASCII_LETTERS = re.compile(r"[a-z]+")
# The same among the first 256 characters, which have no such marks.
_LATIN_LETTERS = re.compile("[" + "".join(filter(str.isalpha, map(chr, range(256)))) + "]+")
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}\u200c\u200d]*")


def words_of(text: str | None) -> Counter:
    if not text:
        return Counter()
    lower = text.lower()
    if lower.isascii():
        return Counter(_ASCII_LETTERS.findall(lower))
    try:
        lower.encode("latin-1")
    except UnicodeEncodeError:
        return Counter(_LETTERS.findall(lower))
    return Counter(_LATIN_LETTERS.findall(lower))


def grams_of(word: str, n: int) -> Iterator[str]:
    """Character n-grams of a marked word, one at a time: a word may be as long as a text."""
    marked = f"_{word}_"
    return (marked[i : i + n] for i in range(len(marked) - n + 1))


class Model:
    """``words`` and ``grams`` map to entries; an entry lists the languages that have it (``at``, from ``starts`` on) and how
    far its log frequency there is above that of an entry never seen (``above``); ``floors`` are those, by length and language."""

    def __init__(self, languages: list[str], entries: pa.Table | list[tuple[int, str, str, int]]):
        """``entries``: length (0: a word), text, language and count; sorted by length and text."""
        self.languages = languages
        if not isinstance(entries, pa.Table):
            kinds = [("n", pa.int32()), ("t", pa.string()), ("lang", pa.string()), ("c", pa.int64())]
            entries = pa.Table.from_pylist([dict(zip("n t lang c".split(), e, strict=True)) for e in sorted(entries)], pa.schema(kinds))
        code = {lang: i for i, lang in enumerate(languages)}
        lengths = entries.column("n").to_numpy()
        self.at = np.array([code[x] for x in entries.column("lang").to_pylist()], np.int32)
        counts = entries.column("c").to_numpy().astype(float) + 0.5
        texts = entries.column("t").to_pylist()
        fresh = [i for i in range(len(texts)) if not i or texts[i] != texts[i - 1] or lengths[i] != lengths[i - 1]]
        self.starts = np.array([*fresh, len(texts)], np.int64)
        self.floors = np.zeros((LONGEST + 1, len(languages)))
        kinds = np.array([lengths[i] for i in fresh], np.int64)
        above = np.zeros(len(texts))
        for n in range(LONGEST + 1):
            mine = lengths == n
            total = np.bincount(self.at[mine], counts[mine] - 0.5, len(languages)) + 0.5 * (kinds == n).sum()
            if mine.any():
                self.floors[n] = np.log(0.5 / total)
                above[mine] = np.log(counts[mine] / 0.5)
        self.above = above.astype(np.float32)
        self.kinds = kinds.astype(np.int8)
        self.words = {texts[i]: k for k, i in enumerate(fresh) if not lengths[i]}
        self.grams = {texts[i]: k for k, i in enumerate(fresh) if lengths[i]}

    def fallback(self, word: str) -> Counter:
        """The longest n-grams of a word that are known, and how often it has them."""
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            if found := Counter(i for g in grams_of(word, n) if (i := self.grams.get(g)) is not None):
                return found
        return Counter()

    def evidence(self, word: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
        """The entries a word counts with, and their shares of it."""
        if (entry := self.words.get(word)) is not None:
            return (entry,), (1.0,)
        if len(word) > LONG_WORD:
            found = self.fallback(word)
            each = 1 / max(found.total(), 1)
            return tuple(found), tuple(each * times for times in found.values())
        # The same without counting: a short word has few n-grams.
        marked, known = f"_{word}_", self.grams.get
        for n in range(min(LONGEST, len(marked)), 0, -1):
            if entries := [i for k in range(len(marked) - n + 1) if (i := known(marked[k : k + n])) is not None]:
                return tuple(entries), (1 / len(entries),) * len(entries)
        return (), ()

    def predict(self, text: str | None, evidence=None) -> tuple[str, float]:
        """``evidence``: the method of that name, or one that remembers."""
        counts = words_of(text)
        if not counts or not self.languages:
            return UNKNOWN, 0.0
        evidence = evidence or self.evidence
        found_at, parts = [], []
        for word, count in counts.items():
            of, shares = evidence(word)
            found_at += of
            parts += shares if count == 1 else [count * s for s in shares]
        entries, weights = np.array(found_at, np.int64), np.array(parts)
        total = np.bincount(self.kinds[entries], weights, LONGEST + 1) @ self.floors if len(entries) else np.zeros(len(self.languages))
        first, sizes = self.starts[entries], self.starts[entries + 1] - self.starts[entries]
        places = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        total = total + np.bincount(self.at[places], self.above[places] * np.repeat(weights, sizes), len(self.languages))
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.languages[best], float(odds[best] / odds.sum())


def _counted(sample: DataFrame) -> DataFrame:
    """``lang, word, count`` of the sample, summed within each batch before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, w, c) for lang, counter in sums.items() for w, c in counter.items()]
            lang, word, count = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.record_batch([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(count, pa.int64())], names=["lang", "word", "c"])

    return sample.mapInArrow(work, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))


def _grams(counts: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = Counter()
            for lang, word, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                for n in range(1, LONGEST + 1):
                    for g in grams_of(word, n):
                        sums[n, g, lang] += c
            n, gram, lang = zip(*sums, strict=True) if sums else ([], [], [])
            yield pa.record_batch([pa.array(n, pa.int32()), pa.array(gram, pa.string()), pa.array(lang, pa.string()), pa.array(list(sums.values()), pa.int64())], names=["n", "t", "lang", "c"])

    return counts.select("lang", "t", "c").mapInArrow(work, "n int, t string, lang string, c long").groupBy("n", "t", "lang").agg(F.sum("c").alias("c"))


def _most(counts: DataFrame, limit: int) -> DataFrame:
    """``n, t`` of the texts that are among the ``limit`` most frequent of their length in some language.

    Counts are counted first, so that the least frequency that is kept is known without sorting any text; of those
    with just this frequency a hash takes the share that still fits."""
    levels = counts.groupBy("lang", "n", "c").agg(F.count("*").alias("m"))
    down = Window.partitionBy("lang", "n").orderBy(F.desc("c"))
    filled = levels.withColumn("before", F.coalesce(F.sum("m").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = filled.where(F.col("before") < limit).select("lang", "n", "c", F.least(F.lit(1.0), (limit - F.col("before")) / F.col("m")).alias("share"))
    fits = F.pmod(F.xxhash64("t", F.lit(4)), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    return counts.join(F.broadcast(stored(kept, "levels")), ["lang", "n", "c"]).where(fits).select("n", "t").distinct()


def fit(
    docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, words_per_language: int = WORDS_PER_LANGUAGE, grams_per_length: int = GRAMS_PER_LENGTH,
    id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
) -> Model:
    """Learns from rows outside the held-out fold with a language, about ``docs_per_language`` of each
    (all, if fewer), chosen by a hash of the id.  Of each language about ``words_per_language`` words and, for each
    length, ``grams_per_length`` n-grams are kept, the most frequent; with them their counts in the other languages.  Only
    these tables come to the driver."""
    rows = docs.where(~held_out(id_column) & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    rows = rows.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"), F.xxhash64(F.col(id_column), F.lit(9)).alias("h"))
    # Written first: Spark then knows how small it is, and the texts need not move to be joined.
    sizes = stored(rows.groupBy("lang").count().withColumnRenamed("count", "n"), "languages")
    bound = F.lit(1 << 40) * docs_per_language / F.col("n")
    sample = rows.join(sizes, "lang").where(F.pmod("h", F.lit(1 << 40)) < bound).select("lang", "text")
    words = stored(_counted(sample).select(F.lit(0).alias("n"), F.col("word").alias("t"), "lang", "c"), "words")
    grams = stored(_grams(words), "grams")
    languages = [r.lang for r in sizes.select("lang").orderBy("lang").collect()]
    kept = [counts.join(_most(counts, limit), ["n", "t"]).select("n", "t", "lang", "c") for counts, limit in ((words, words_per_language), (grams, grams_per_length))]
    return Model(languages, kept[0].union(kept[1]).orderBy("n", "t", "lang").toArrow())


def identify(docs: DataFrame, model: Model, keep: list[str], text_column: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with ``lang_pred`` and ``score`` (its probability).

    NULL texts and those without a letter are ``und`` with score 0, as is everything for a model
    that has seen no language.  Ties go to the language that sorts first."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in keep]).add("lang_pred", "string").add("score", "double")
    spare = "_text"
    columns = [F.col(c) for c in keep] + ([] if text_column in keep else [F.col(text_column).alias(spare)])
    at = keep.index(text_column) if text_column in keep else len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        remembered = lru_cache(WORDS_REMEMBERED)(known.evidence)
        # What a long word counts with is long too.
        evidence = lambda word: remembered(word) if len(word) <= LONG_WORD else known.evidence(word)
        for batch in batches:
            found = [known.predict(t, evidence) for t in batch.column(at).to_pylist()]
            arrays = [*batch.columns[: len(keep)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.record_batch(arrays, names=schema.names)

    return docs.select(*columns).mapInArrow(work, schema)
