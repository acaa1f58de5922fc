"""Near-duplicate groups by SimHash, with fuzzy keys from the perfect Golay code.

A 64-bit fingerprint is cut into three segments.  Every 23-bit word lies within 3 bits of exactly one
codeword of the binary Golay code, so a segment decodes to a 12-bit index; decoding it and all its
one-bit neighbours gives at most six indices, and segments up to two bits apart always share one
(the word between them is a neighbour of both).  Four differing bits over three segments leave
either one segment equal and another at most two bits apart, or all three at most two bits apart.
Keys are therefore (equal segment, index of another) and (index, index, index); no link is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import stored, utf8
from tallyglass.llm.components import connected_components

# Start and width of the segments; generator polynomial of the (23, 12) Golay code.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GOLAY_POLYNOMIAL = 0xC75

MAX_BITS = 4
SEED = 42
# A bucket of more fingerprints than this is compared in blocks by many tasks.
BUCKET_ROWS = 4096
BLOCK_ROWS = 2048
# Fingerprints whose keys (about 180 each) one task writes.
KEYED_ROWS = 1 << 14
# Rows of sorted keys that a task gathers before it works on their buckets.
HELD_ROWS = 1 << 17


# ---------------------------------------------------------------- fingerprints


def fingerprint(data: bytes, size: int) -> int:
    """SimHash of the ``size``-word shingles; words end at ASCII space, A-Z count as a-z."""
    found = data.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    n = len(found) - size + 1
    if n <= 1:
        shingles = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = [0, *ends[: n - 1].tolist()]
        shingles = [joined[a:b] for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join(map(digest, shingles, repeat(SEED))), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[i : i + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, fp`` (the 64 bits as a signed long) of whole texts.  NULL and wordless texts have 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text, size) for text in batch.column(1).to_pylist()]
            fp = np.array(found, np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fp)], names=["id", "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), utf8(text_column).alias("t")).mapInArrow(work, f"id {kind}, fp long")


# ---------------------------------------------------------------- keys


@cache
def golay_indices() -> np.ndarray:
    """For each 23-bit word the index of the only codeword within three bits."""
    checks = np.arange(4096, dtype=np.int64) << 11
    for shift in range(11, -1, -1):
        checks = np.where(checks >> (shift + 11) & 1, checks ^ (GOLAY_POLYNOMIAL << shift), checks)
    codewords = np.arange(4096, dtype=np.int64) << 11 | checks
    bit = 1 << np.arange(23, dtype=np.int64)
    table = np.empty(1 << 23, np.int16)
    index = np.arange(4096, dtype=np.int16)
    for error in {0} | {int(bit[i] | bit[j] | bit[k]) for i in range(23) for j in range(23) for k in range(23)}:
        table[codewords ^ error] = index
    return table


def segment_keys(words: np.ndarray, width: int) -> np.ndarray:
    """Up to six indices for each word, -1 in the places left over."""
    ball = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(width, dtype=np.int64))], axis=1)
    found = np.sort(golay_indices()[ball], axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    keys = np.full((len(words), 6), -1, np.int64)
    row, col = np.nonzero(new)
    keys[row, (np.cumsum(new, axis=1) - 1)[row, col]] = found[row, col]
    return keys


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a position in ``fps`` and a key."""
    bits = fps.view(np.uint64)
    parts = [(bits >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    near = [segment_keys(p, width) for p, (_, width) in zip(parts, SEGMENTS, strict=True)]
    where, keys = [], []
    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                row, col = np.nonzero(near[j] >= 0)
                where.append(row)
                keys.append(tag << 36 | parts[i][row] << 12 | near[j][row, col])
                tag += 1
    a, b, c = near[0][:, :, None, None], near[1][:, None, :, None], near[2][:, None, None, :]
    row, x, y, z = np.nonzero((a >= 0) & (b >= 0) & (c >= 0))
    where.append(row)
    keys.append(tag << 36 | near[0][row, x] << 24 | near[1][row, y] << 12 | near[2][row, z])
    return np.concatenate(where), np.concatenate(keys)


# ---------------------------------------------------------------- links


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _trees(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the smallest fingerprint of each component of one bucket to the others."""
    fps = np.unique(fps)
    left = np.ones(len(fps), bool)
    ends, roots = [], []
    for start in range(len(fps)):
        if not left[start]:
            continue
        left[start] = False
        front = np.array([start])
        while len(front):
            rest = np.nonzero(left)[0]
            hit = np.zeros(len(rest), bool)
            for i in range(0, len(front), 256):
                hit |= (_apart(fps[front[i : i + 256], None], fps[rest][None, :]) <= bits).any(axis=0)
            front = rest[hit]
            left[front] = False
            ends.append(fps[front])
            roots.append(np.full(len(front), fps[start]))
    return np.concatenate(ends), np.concatenate(roots)


def _links_of(keys: np.ndarray, fps: np.ndarray, bits: int):
    """Edges within the buckets of sorted keys, and the rows of buckets that are too large."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    a, b, late = [], [], []
    small = np.repeat((sizes > 1) & (sizes <= 16), sizes)
    k, f = keys[small], fps[small]
    for step in range(1, 16):
        if step >= len(k):
            break
        at = np.flatnonzero(k[step:] == k[:-step])
        if not len(at):
            break
        x, y = f[at], f[at + step]
        near = _apart(x, y) <= bits
        a.append(np.maximum(x, y)[near])
        b.append(np.minimum(x, y)[near])
    for i in np.flatnonzero(sizes > 16):
        rows = slice(starts[i], starts[i] + sizes[i])
        if sizes[i] > BUCKET_ROWS:
            late.append(rows)
        else:
            x, y = _trees(fps[rows], bits)
            a.append(x)
            b.append(y)
    return a, b, late


def _pairs(a: list, b: list) -> np.ndarray:
    if not a:
        return np.empty((0, 2), np.int64)
    return np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)


def _edge_batch(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())], names=["a", "b", "key"])


def _dealt(fps: DataFrame) -> DataFrame:
    """Fingerprints over as many tasks as their keys need: a file of 16 MB may hold a million of them,
    and the sort buffers of a task grow with the keys it writes."""
    tasks = -(-fps.count() // KEYED_ROWS)
    return fps.select("fp").repartition(max(1, tasks), "fp")


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``a, b`` that join all fingerprints (column ``fp``, no repeats) at most ``max_bits`` apart
    into their components: a spanning tree of each bucket, not its pairs.  ``fps`` is read twice, first to be counted."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0))
            for i in range(0, len(fp), 1024):
                where, keys = fuzzy_keys(fp[i : i + 1024])
                yield pa.record_batch([pa.array(keys), pa.array(fp[i : i + 1024][where])], names=["key", "fp"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f, held, a, b = [], [], 0, [], []
        large = None  # key of a bucket that is passed on as it comes

        def late_batch(keys, fp):
            return pa.record_batch([pa.array(fp), pa.nulls(len(fp), pa.int64()), pa.array(keys)], names=["a", "b", "key"])

        def work(last: bool):
            nonlocal held_k, held_f, held, a, b, large
            keys, fp = np.concatenate(held_k), np.concatenate(held_f)
            if large is not None and (more := int(np.searchsorted(keys, large, "right"))):
                yield late_batch(keys[:more], fp[:more])
                keys, fp = keys[more:], fp[more:]
            end = len(keys) if last or not len(keys) else int(np.searchsorted(keys, keys[-1]))
            if end:
                more_a, more_b, late = _links_of(keys[:end], fp[:end], max_bits)
                a, b = [*a, *more_a], [*b, *more_b]
                for rows in late:
                    yield late_batch(keys[rows], fp[rows])
            keys, fp = keys[end:], fp[end:]
            if len(keys) > BUCKET_ROWS:  # one bucket that goes on: no task holds it whole
                large = keys[-1]
                yield late_batch(keys, fp)
                keys, fp = keys[:0], fp[:0]
            held_k, held_f, held = [keys], [fp], len(keys)
            if sum(map(len, a)) > 500_000:
                pairs = _pairs(a, b)
                a, b = [pairs[:, 0]], [pairs[:, 1]]
                if len(pairs) > 250_000:
                    yield _edge_batch(pairs)
                    a, b = [], []

        for batch in batches:
            held_k.append(np.asarray(batch.column(0)))
            held_f.append(np.asarray(batch.column(1)))
            held += batch.num_rows
            if held >= HELD_ROWS:
                yield from work(False)
        if held:
            yield from work(True)
        yield _edge_batch(_pairs(a, b))

    key_rows = _dealt(fps).mapInArrow(keyed, "key long, fp long").repartition("key").sortWithinPartitions("key")
    found = stored(key_rows.mapInArrow(linked, "a long, b long, key long"), "links")
    late = found.where("key IS NOT NULL").select("key", F.col("a").alias("fp"))
    return found.where("key IS NULL").select("a", "b").union(_late_links(late, max_bits))


def _late_links(rows: DataFrame, max_bits: int) -> DataFrame:
    """Large buckets, block against block: no task holds more than two blocks."""
    blocks = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("n"))
    mine = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    dealt = (
        rows.join(blocks, "key").withColumn("i", mine)
        .select("key", "fp", F.col("i"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
        .select("key", "fp", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    )

    def work(group: pa.Table) -> pa.Table:
        a, b = _trees(group.column("fp").to_numpy(), max_bits)
        return pa.table({"a": a, "b": b})

    return dealt.groupBy("key", "i", "j").applyInArrow(work, "a long, b long").distinct()


# ---------------------------------------------------------------- groups


def near_duplicates(
    docs: DataFrame, shingle_words: int = 4, max_bits: int = MAX_BITS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    A component is everything reachable over fingerprints at most ``max_bits`` apart; its id is the
    smallest document id in it.  NULL, empty and blank texts have fingerprint zero and link like any
    other.  A shorter text is one shingle.  Repeated rows come back as often as they came; a row
    without an id is linked but never gives the component its id, unless none has one (then NULL).  Other
    columns are ignored, an empty table gives an empty result."""
    marked = stored(fingerprints(docs, shingle_words, id_column, text_column), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    roots = connected_components(links(classes, max_bits))
    # Fingerprints with links, and the smallest id of all that are linked to them.
    linked = roots.join(classes, F.col("fp") == F.col("node")).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("component"))
    moved = linked.join(least, "root").select("fp", "component")
    named = stored(
        classes.join(moved, "fp", "left").select("fp", F.when(F.col("component").isNotNull(), F.col("component")).otherwise(F.col("first")).alias("component_id")),
        "named",
    )
    return marked.join(named, "fp").select(
        F.col("id").alias(id_column), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
