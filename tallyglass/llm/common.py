"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.session import fresh_path

# Rows handed to Python at once.  Texts may be long, so a batch stays a few MB.
ARROW_ROWS = "2048"

# A word: letters and digits, of every script; in ASCII texts as bytes.
_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(rb"[0-9a-z]+")
# Letters and digits of ASCII and every character beyond it (as UTF-8), or a run of other visible characters.
_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^\s0-9a-z\x80-\xff]+")


def prepare(spark: SparkSession) -> SparkSession:
    """Settings of the session that the operators rely on."""
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS),
        ("spark.sql.adaptive.enabled", "true"),
        ("spark.sql.adaptive.skewJoin.enabled", "true"),
    ):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and a lost executor
    costs a reread instead of the lineage."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: str | Column) -> Column:
    """Whether a row belongs to the fold that no model may learn labels from."""
    key = F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit(""))
    return F.crc32(key) % 3 == 1


def utf8(column: str) -> Column:
    """The bytes of a text; nothing for NULL."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def lowered(data: bytes) -> bytes:
    """Lower case in every script."""
    return data.lower() if data.isascii() else data.decode("utf-8", "replace").lower().encode()


def words(data: bytes) -> list[bytes]:
    """Runs of letters and digits, in lower case."""
    if data.isascii():
        return _ASCII_WORD.findall(data.lower())
    # Cut before the case changes: a dotted capital I becomes a letter and a mark.
    found = _WORD.findall(data.decode("utf-8", "replace"))
    return "\n".join(found).lower().encode().split(b"\n") if found else []


def tokens(data: bytes) -> list[bytes]:
    return _TOKEN.findall(lowered(data))


def word_hashes(found: list[bytes]) -> np.ndarray:
    """32-bit hashes of words, spread over 64 bits."""
    h = np.fromiter(map(zlib.crc32, found), np.uint64, len(found))
    h = (h + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash for every ``size`` consecutive words, or one for a shorter sequence."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        out = (out ^ hashes[i : n - size + 1 + i]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return out
