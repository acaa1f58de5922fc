"""Runs (maximal periodic stretches) of words, by Lyndon roots.

The first phase of Baier's suffix sorter groups the positions of a sequence until all positions of a group start the
same longest Lyndon word; the lengths of these words are the Lyndon array.  It is taken under the order of the words and
under the reversed order: the root of every run is a Lyndon word under one of the two, so extending each root by the
longest common extensions of its two ends finds every run.  A document is worked off in one piece, in memory that
grows with its words; documents are independent of each other and nothing is shuffled.

The sorter runs on those stretches of a document alone that may hold a run: in a run of at least ``2 m`` words and two
periods every word lies in ``m`` words that occur again in the document, so stretches without such repeats hold no run
and none crosses their ends."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.llm.common import prepare

MIN_LENGTH = 12
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
# Two prime moduli below 2^31: products of two residues fit 64 bits.
MODULI = ((2147483647, 1000003), (2147483629, 998244353))


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each position: phase one of Baier's sorter.

    Groups are named by their first place in ``places``, so a higher name is a higher group.  The highest group not yet
    worked off is taken; each of its positions points to the nearest earlier position of a lower group; positions with
    the same number of pointers leave their group upwards, and their word grows by so many copies of the taken one."""
    n = len(ranks)
    places = sorted(range(n), key=ranks.__getitem__)
    place = [0] * n
    group, size, word = [0] * n, [0] * n, [1] * n
    first = 0
    for at, i in enumerate(places):
        if ranks[i] != ranks[places[first]]:
            first = at
        place[i], group[i] = at, first
        size[first] += 1
    before = [-1] * n
    end = n
    while end > 0:
        taken = group[places[end - 1]]
        members = places[taken:end]
        members.sort()
        length, end = word[taken], taken
        pointers: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= taken:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, count in pointers.items():
            moves.setdefault((-count, group[j]), []).append(j)
        for count, old in sorted(moves):
            moved = moves[count, old]
            top = old + size[old]
            for j in moved:
                top -= 1
                other, hole = places[top], place[j]
                places[top], places[hole] = j, other
                place[j], place[other] = top, hole
            size[old] -= len(moved)
            # When a whole group moves, it keeps its name; its word is read before it is written.
            grown = word[old] - count * length
            for j in moved:
                group[j] = top
            size[top] = len(moved)
            word[top] = grown
    return [word[g] for g in group]


class _Prefixes:
    """Hashes of all prefixes, for comparing any two pieces of one sequence at once."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.tables = []
        for modulus, base in MODULI:
            powers = np.ones(self.n + 1, np.int64)
            step, done = base, 1
            while done <= self.n:  # doubling: powers[done:2 done] = powers[:done] * base^done
                more = min(done, self.n + 1 - done)
                powers[done : done + more] = powers[:more] * step % modulus
                step, done = step * step % modulus, done * 2
            sums = np.zeros(self.n + 1, np.int64)
            # Partial sums are taken modulo in blocks, so that none passes 64 bits.
            terms = (ids.astype(np.int64) + 1) % modulus * powers[:-1] % modulus
            carry = 0
            for lo in range(0, self.n, 1 << 30):
                block = (np.cumsum(terms[lo : lo + (1 << 30)]) + carry) % modulus
                sums[lo + 1 : lo + 1 + len(block)] = block
                carry = int(block[-1])
            self.tables.append((modulus, powers, sums))

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` words from ``i`` equal those from ``j`` (``i < j``)."""
        same = np.ones(len(i), bool)
        for modulus, powers, sums in self.tables:
            left = (sums[i + length] - sums[i]) % modulus * powers[j - i] % modulus
            same &= left == (sums[j + length] - sums[j]) % modulus
        return same

    def extension(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """Words that agree from ``i`` and ``j`` (``i < j``) on; or up to and without them, if ``back``."""
        low = np.zeros(len(i), np.int64)
        high = (i if back else self.n - j).astype(np.int64)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) // 2
            same = self.equal(i - middle, j - middle, middle) if back else self.equal(i, j, middle)
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)


def _holds(ids: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether the words from ``start`` to ``end`` have the period and no neighbour extends it."""
    if not np.array_equal(ids[start : end - period], ids[start + period : end]):
        return False
    if start > 0 and ids[start - 1] == ids[start - 1 + period]:
        return False
    return end == len(ids) or ids[end] != ids[end - period]


def _directly(ids: np.ndarray, i: int, period: int) -> tuple[int, int]:
    """The run around a root, word by word."""
    end, start = i + period, i
    while end < len(ids) and ids[end] == ids[end - period]:
        end += 1
    while start > 0 and ids[start - 1] == ids[start - 1 + period]:
        start -= 1
    return start, end


def runs_of(ids: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of at least ``min_length`` and two periods, by start, then period.

    Extensions are found on hashes and every run is checked on the words themselves, so the result is exact."""
    n = len(ids)
    if n < max(min_length, 2):
        return []
    _, ranks = np.unique(ids, return_inverse=True)
    up = np.array(lyndon_array(ranks.tolist()), np.int64)
    down = np.array(lyndon_array((ranks.max() - ranks).tolist()), np.int64)
    starts = np.concatenate([np.arange(n), np.arange(n)])
    periods = np.concatenate([up, down])
    fit = 2 * periods <= n
    starts, periods = starts[fit], periods[fit]
    prefixes = _Prefixes(ranks)
    right = np.zeros(len(starts), np.int64)
    inner = starts + periods < n
    right[inner] = prefixes.extension(starts[inner], starts[inner] + periods[inner])
    left = prefixes.extension(starts, starts + periods, back=True)
    begin, length = starts - left, left + periods + right
    fit = length >= np.maximum(min_length, 2 * periods)
    roots, triples = starts[fit], np.stack([begin[fit], periods[fit], length[fit]], 1)
    found, which = np.unique(triples, axis=0, return_inverse=True) if len(triples) else (triples, roots)
    out = set()
    for k, (s, p, size) in enumerate(found.tolist()):
        if _holds(ranks, s, s + size, p):
            out.add((s, size, p))
            continue
        # Unequal pieces of one hash make an extension too long, never too short; then the words decide.
        for root in roots[which == k].tolist():
            at, end = _directly(ranks, root, p)
            if end - at >= max(min_length, 2 * p):
                out.add((at, end - at, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeated_stretches(ids: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Stretches of positions that lie in ``size`` consecutive words which occur twice or more; every run of at least
    ``2 size`` words and two periods lies whole in one."""
    n = len(ids)
    if n < 2 * size:
        return []
    grams = np.zeros(n - size + 1, np.uint64)
    wide = ids.astype(np.uint64)
    for k in range(size):
        grams = (grams ^ wide[k : n - size + 1 + k]) * np.uint64(0x9FB21C651E98DF25)
        grams ^= grams >> np.uint64(29)
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    twin = np.zeros(len(grams), bool)
    same = ranked[1:] == ranked[:-1]
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    if not twin.any():
        return []
    edges = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(twin)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + size, -1)
    inside = np.concatenate([[0], (np.cumsum(edges[:-1]) > 0).astype(np.int8), [0]])
    turns = np.flatnonzero(np.diff(inside))
    return [(int(a), int(b)) for a, b in zip(turns[::2], turns[1::2]) if b - a >= 2 * size]


def document_runs(words: list[bytes], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """The runs of a document, by start, then period."""
    if len(words) < min_length:
        return []
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return []
    found = []
    for a, b in repeated_stretches(ids, max(min_length // 2, 1)):
        found += [(a + s, k, p) for s, k, p in runs_of(ids[a:b], min_length)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that lie in a run behind its first period, joined by single spaces."""
    if not found:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for s, k, p in found:
        edges[s + p] += 1
        edges[s + k] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)])


def _batch(texts: Iterable[bytes | None], min_length: int) -> tuple[list, list]:
    runs, rest = [], []
    for text in texts:
        # bytes.split() cuts at the six white-space characters of ASCII and no other.
        words = (text or b"").split()
        found = document_runs(words, min_length)
        runs.append([{"start": s, "length": k, "period": p} for s, k, p in found])
        rest.append(collapsed(words, found).decode("utf-8", "replace"))
    return runs, rest


def find_runs(docs: DataFrame, text_column: str = "text", keep: list[str] | None = None, min_length: int = MIN_LENGTH) -> DataFrame:
    """The columns ``keep`` (``doc_id``, unless given), ``n_words``, ``runs`` (start, length, period; by start, then
    period) and ``collapsed``, the words outside of what repeats a run's first period.

    Words are what ASCII white space separates.  A run is a longest stretch with a smallest period of at most half its
    length, and has ``min_length`` words at least.  NULL, empty and blank texts have no word and no run.  Rows repeated
    give repeated results, an empty table none; texts of any length are taken whole; columns not in ``keep`` play no
    part."""
    prepare(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    if min_length < 2:
        raise ValueError("a run has two words at least")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{text_column}`").cast("binary").alias("text"))
    kept_type = rows.schema["kept"]
    schema = T.StructType(
        [kept_type, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    )
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, texts = batch.column(0), batch.column(1)
            # A text at a time becomes Python's; results leave in slices of a few hundred rows.
            for lo in range(0, batch.num_rows, 256):
                part = texts.slice(lo, 256)
                values = [v.as_py() for v in part]
                runs, rest = _batch(values, min_length)
                counts = [len((v or b"").split()) for v in values]
                yield pa.RecordBatch.from_arrays(
                    [kept.slice(lo, 256), pa.array(counts, pa.int64()), pa.array(runs, run_type), pa.array(rest, pa.string())],
                    names=["kept", "n_words", "runs", "collapsed"],
                )

    out = rows.mapInArrow(scan, schema)
    return out.select("kept.*", "n_words", "runs", "collapsed")


def longest(runs: str = "runs") -> F.Column:
    """The longest run of an array; of equal ones the first, then that of the smallest period.  NULL without runs."""
    ranked = F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("k"), r["start"].alias("start"), r["period"].alias("period"))))
    best = F.get(ranked, F.lit(0))
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (-best["k"]).alias("length"), best["period"].alias("period")))
