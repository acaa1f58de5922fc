"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import held_out, stored, tokens, utf8, word_hashes

BUCKET_BITS = 18
NGRAMS = 2
# Labelled documents that the fit takes at most (about), chosen by a hash of the id, and into how many
# parts they are dealt.  Each part is trained on its own; the weights are averaged.
TRAINING_ROWS = 20_000
PARTS = 4
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-6


def features(data: bytes, bits: int = BUCKET_BITS, ngrams: int = NGRAMS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text: dampened counts of its n-grams, scaled to unit length.  Words, and runs of
    other visible characters, are the units; a unit said again at once is an n-gram of one kind, whichever it
    is.  Bucket 0 is the constant term."""
    h = word_hashes(tokens(data))
    grams = [h]
    for n in range(2, ngrams + 1):
        last = grams[-1]
        joined = (last[: max(len(last) - 1, 0)] * np.uint64(0x9E3779B97F4A7C15)) ^ h[n - 1 :]
        grams.append(np.where(h[n - 2 : len(h) - 1] == h[n - 1 :], np.uint64(n), joined))
    slots = np.concatenate([((g * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64) for g in grams])
    slots, counts = np.unique(np.maximum(slots, 1), return_counts=True)
    values = np.log1p(counts)
    norm = np.sqrt(values @ values)
    return np.r_[0, slots], np.r_[1.0, values / norm if norm else values]


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BUCKET_BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal updates over the rows in their order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, y in rows:
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -40, 40))) - y) * x
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    return weights(slice(None))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAINING_ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``h, t, y``: at most about ``limit`` documents with a label, none of the held-out fold.  Of several
    labels the majority counts (1 when even), of several rows of one id the smallest text."""
    marked = labels.where(F.col(label).isNotNull() & ~held_out(id_column)).groupBy(F.col(id_column).alias("_id"))
    marked = marked.agg((F.avg(label) >= 0.5).cast("int").alias("y")).withColumn("h", F.pmod(F.xxhash64("_id", F.lit(6)), F.lit(1 << 40)))
    count = marked.count()
    chosen = marked.where(F.col("h") < (limit / max(count, 1)) * (1 << 40))
    # The bound above is what makes this broadcast safe.
    rows = docs.select(F.col(id_column).alias("_id"), utf8(text_column).alias("t")).join(F.broadcast(chosen), "_id")
    return rows.groupBy("_id", "h", "y").agg(F.min("t").alias("t")).select("h", "t", "y")


def fit(docs: DataFrame, labels: DataFrame, **named) -> np.ndarray:
    """Weights by bucket.  Without labels all are zero, and every score 0.5."""
    rows = stored(labelled_rows(docs, labels, **named), "labelled")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = []
        for batch in batches:
            for h, t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine.append((h, *features(t), y))
        if mine:
            mine.sort(key=lambda r: r[0])
            w = train([r[1:] for r in mine])
            at = np.flatnonzero(w)
            yield pa.record_batch([pa.array(at), pa.array(w[at] * len(mine)), pa.array(np.full(len(at), len(mine)))], names=["slot", "w", "n"])

    parts = rows.repartition(PARTS, F.pmod("h", F.lit(PARTS))).mapInArrow(work, "slot long, w double, n long")
    total = max(rows.count(), 1)
    weights = np.zeros(1 << BUCKET_BITS)
    for r in parts.groupBy("slot").agg(F.sum("w").alias("w")).toLocalIterator():
        weights[r.slot] = r.w / total
    return weights


def score(docs: DataFrame, weights: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.  NULL, empty and blank texts get the score of
    the constant term; repeated rows come back as often as they came."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema[id_column].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            found = []
            for text in batch.column(2).to_pylist():
                at, x = features(text)
                found.append(w[at] @ x)
            s = 1 / (1 + np.exp(-np.clip(np.array(found, float), -40, 40)))
            arrays = [*batch.columns[:2], pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.record_batch(arrays, names=[id_column, "held_out", "score", "predicted"])

    columns = docs.select(F.col(id_column), held_out(id_column).alias("held_out"), utf8(text_column).alias("_text"))
    return columns.mapInArrow(work, f"`{id_column}` {kind}, held_out boolean, score double, predicted int")
