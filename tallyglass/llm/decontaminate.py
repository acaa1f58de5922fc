"""Benchmark passages in documents, found by SimHash of item-sized windows.

A window of as many words as a benchmark item is compared with the items of that size: SimHash
fingerprints of both, looked up over eight blocks of eight bits.  Fingerprints at most 23 bits apart
agree in some block but for two bits, so probing every block within two bits misses none of them
(items of similarity 0.8 differ by about 10 bits of 64, hardly ever by 20).  Candidates are then
held against the item itself: weighted Jaccard similarity of the shingles, weights being their counts.
Only windows that share at least one shingle with an item of their size are fingerprinted: without one
the similarity is zero.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.llm.common import shingle_hashes, stored, utf8, word_hashes, words

SHINGLE_WORDS = 5
SIMILARITY = 0.8
MAX_BITS = 23
# Items are sent to the tasks in blocks of about this many bytes of text; each block is one pass.
BLOCK_BYTES = 8 << 20
# Windows times items that are looked up at once.
PROBED_AT_ONCE = 1 << 20

_NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


def _shingles(found: list[bytes], size: int) -> Counter:
    size = min(size, len(found))
    return Counter(tuple(found[i : i + size]) for i in range(len(found) - size + 1))


def weighted_similarity(a: Counter, b: Counter) -> float:
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def window_fingerprints(hashes: np.ndarray, length: int) -> np.ndarray:
    """SimHash of every ``length`` consecutive shingle hashes, as rows of eight bytes."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(bits) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    return np.packbits(2 * (sums[length:] - sums[:-length]) > length, axis=1)


class _Size:
    """The items of one word count."""

    def __init__(self, count: int, items: list[tuple[int, list[bytes]]], shingle_words: int, max_bits: int):
        self.words, self.k, self.max_bits = count, min(shingle_words, count), max_bits
        self.ids = [i for i, _ in items]
        self.found = [found for _, found in items]
        self.hashes = [shingle_hashes(word_hashes(found), shingle_words) for _, found in items]
        self.sorted = [np.unique(h) for h in self.hashes]
        self.all = np.unique(np.concatenate(self.hashes))
        self.fps = np.concatenate([window_fingerprints(h, len(h)) for h in self.hashes])
        # [block, value of the block]: the items whose block is close enough
        reach = max_bits // 8
        self.probe = np.stack([_NEAR[:, self.fps[:, b]] <= reach for b in range(8)])

    def candidates(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, item and distance of all fingerprints at most ``max_bits`` apart."""
        step = max(1, PROBED_AT_ONCE // len(self.ids))
        parts = []
        for first in range(0, len(fps), step):
            some = fps[first : first + step]
            hit = np.zeros((len(some), len(self.ids)), bool)
            for b in range(8):
                hit |= self.probe[b, some[:, b]]
            window, item = np.nonzero(hit)
            apart = np.bitwise_count(some[window] ^ self.fps[item]).sum(axis=1, dtype=np.int64)
            near = apart <= self.max_bits
            parts.append((window[near] + first, item[near], apart[near]))
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


class Benchmark:
    """Items ready for lookup; built once in every task."""

    def __init__(self, items: list[tuple[int, bytes]], shingle_words: int, similarity: float, max_bits: int):
        self.shingle_words, self.similarity = shingle_words, similarity
        by_size: dict[int, list] = {}
        for item_id, text in items:
            if found := words(text):
                by_size.setdefault(len(found), []).append((item_id, found))
        self.sizes = [_Size(n, group, shingle_words, max_bits) for n, group in sorted(by_size.items())]
        self.by_k = {}
        for size in self.sizes:
            self.by_k.setdefault(size.k, []).append(size)
        # A bit for each shingle hash: nearly all shingles of a clean text stop here.
        self.flags, self.known = {}, {}
        for k, sizes in self.by_k.items():
            self.known[k] = np.unique(np.concatenate([s.all for s in sizes]))
            self.flags[k] = np.zeros(1 << 20, bool)
            self.flags[k][self.known[k] >> np.uint64(44)] = True

    def hits(self, data: bytes) -> list[tuple[int, int, int, float, int]]:
        """``(item_id, first word, words, similarity, bits)`` of the best window of each item found."""
        found = words(data)
        hashed = word_hashes(found)
        best: dict[int, tuple] = {}
        for k, sizes in self.by_k.items():
            if len(found) < k:
                continue
            shingles = shingle_hashes(hashed, k)
            at = np.flatnonzero(self.flags[k][shingles >> np.uint64(44)])
            at = at[_among(shingles[at], self.known[k])]
            if len(at):
                for size in sizes:
                    self._search(size, found, shingles, at, best)
        return [(item, *row) for item, row in best.items()]

    def _search(self, size: _Size, found: list[bytes], shingles: np.ndarray, at: np.ndarray, best: dict) -> None:
        at = at[_among(shingles[at], size.all)]
        span = min(size.words, len(found))
        length = span - min(size.k, span) + 1
        # Stretches of windows with at least one shared shingle.
        for first, last in _stretches(at, length, len(shingles)):
            part = shingles[first:last]
            window, item, apart = size.candidates(window_fingerprints(part, length))
            need = math.ceil(self.similarity * len(size.hashes[0]) - 1e-9) if len(window) else 0
            for i in np.unique(item):
                mine = item == i
                shared = np.r_[0, np.cumsum(_among(part, size.sorted[i]))]
                starts, bits = window[mine], apart[mine]
                # A similarity of s needs more than s times the item's shingles in common.
                enough = shared[starts + length] - shared[starts] >= need
                exact = _shingles(size.found[i], self.shingle_words) if enough.any() else None
                for start, distance in zip((starts[enough] + first).tolist(), bits[enough].tolist(), strict=True):
                    value = weighted_similarity(_shingles(found[start : start + span], self.shingle_words), exact)
                    row = (start, span, value, distance)
                    if value >= self.similarity and (size.ids[i] not in best or value > best[size.ids[i]][2]):
                        best[size.ids[i]] = row


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def _stretches(at: np.ndarray, length: int, n: int) -> list[tuple[int, int]]:
    """Ranges of shingles whose windows of ``length`` contain a position of ``at``."""
    out: list[list[int]] = []
    for p in at.tolist():
        first, last = max(0, p - length + 1), min(n, p + length)
        if last - first < length:
            continue
        if out and first <= out[-1][1] - length + 1:
            out[-1][1] = last
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, id_column: str, text_column: str):
    """Broadcasts of at most about ``BLOCK_BYTES`` of item text each."""
    items = benchmark.select(F.col(id_column).alias("i"), utf8(text_column).alias("t")).where("i IS NOT NULL")
    # An item counts once: copies of its row would share a block.
    items = stored(items.distinct(), "items")
    total = items.agg(F.sum(F.length("t") + 16)).first()[0] or 0
    count = -(-total // BLOCK_BYTES)
    for block in range(count):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == block).collect()
        yield benchmark.sparkSession.sparkContext.broadcast([(r.i, bytes(r.t)) for r in rows])


def find(
    docs: DataFrame, benchmark: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, max_bits: int = MAX_BITS,
    id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``doc_id, item_id, word_start, window_words, similarity, bits``: for every document row and item
    with a window of similarity ``similarity`` or more, the most similar window (the first of equals).

    Words are runs of letters and digits, in lower case; everything else separates them.  Items and
    documents shorter than a shingle are one shingle; a document shorter than the item is one window.
    NULL, empty and wordless texts match nothing, nor do items without an id.  Repeated rows are found
    as often as they occur; items with equal text are found each.  Empty tables give an empty result."""
    kind = docs.schema[id_column].dataType
    item_kind = benchmark.schema[item_column].dataType
    schema = T.StructType().add(id_column, kind).add(item_column, item_kind).add("word_start", "integer").add("window_words", "integer").add("similarity", "double").add("bits", "integer")
    columns = docs.select(F.col(id_column), utf8(text_column).alias("t"))
    settings = (shingle_words, similarity, max_bits)
    out = None
    for shared in _blocks(benchmark, item_column, item_text):

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = Benchmark(shared.value, *settings)
            types = None
            for batch in batches:
                rows = [(n, *hit) for n, text in enumerate(batch.column(1).to_pylist()) for hit in known.hits(text)]
                at, *rest = zip(*rows, strict=True) if rows else ([],) * 6
                types = types or [pa.from_numpy_dtype(np.dtype(t)) for t in ("i4", "i4", "f8", "i4")]
                ids = batch.column(0).take(pa.array(at, pa.int64()))
                yield pa.record_batch([ids, pa.array(rest[0], pa.int64()), *(pa.array(c, t) for c, t in zip(rest[1:], types, strict=True))], names=schema.names)

        hits = columns.mapInArrow(work, schema)
        out = hits if out is None else out.union(hits)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(
    docs: DataFrame, benchmark: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, max_bits: int = MAX_BITS,
    text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` in which ``find`` finds no item, unchanged and without a join."""
    settings = (shingle_words, similarity, max_bits)
    out = docs
    for shared in _blocks(benchmark, item_column, item_text):

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = Benchmark(shared.value, *settings)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_column)).to_pylist()
                yield batch.filter(pa.array([not known.hits((t or "").encode()) for t in texts], pa.bool_()))

        out = out.mapInArrow(work, docs.schema)
    return out
