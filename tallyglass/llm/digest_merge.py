"""Exact duplicates by a tree of merges over sorted runs of digests.

Every partition of the digests is a run: sorted by digest, one entry for each digest, holding the smallest identifier
and the number of rows.  In every round groups of ``fanout`` runs are merged into one, smallest identifier first, until
one run is left: the partitions are the leaves of a binomial tree whose inner nodes take ``fanout`` runs at once.  What
crosses the network is one entry a run and digest, so a digest with a third of all rows is as light as any other, and
each run lies cut by the digest's hash over all tasks, so the last one is in no single task either.

Texts are compared by their whole SHA-256, their length and a second hash of their own, never by a part of the digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import prepare, stored

# ASCII white space: a run of it counts as one space.
BLANKS = "[\\x20\\x09-\\x0D]+"
# Runs merged at once.
FANOUT = 8

# What makes two texts the same.
_SAME = ["sha", "size", "check"]


def normalised(text: str) -> Column:
    """The text with each run of white space as one space; an empty text for NULL."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, " ")


def _numbered(docs: DataFrame, id_column: str, text_column: str, *more: Column) -> DataFrame:
    """Identifier and text with the run a row belongs to and a number of its own (``row``), which tells rows of one
    identifier apart."""
    return docs.select(
        F.col(f"`{id_column}`").alias("id"),
        F.col(f"`{text_column}`").alias("text"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
        *more,
    )


def digests(numbered: DataFrame) -> DataFrame:
    """The narrow rows that are merged: no text, but what tells texts apart."""
    bare = numbered.select("id", "run", "row", normalised("text").alias("text"))
    return bare.select(
        "id",
        "run",
        "row",
        F.sha2("text", 256).alias("sha"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.xxhash64("text").alias("check"),
    )


def _merged(entries: DataFrame) -> DataFrame:
    """Entries of the same run and text as one: the smallest identifier and all rows.  The least is a struct, so
    Spark merges sorted input and the result of a task is sorted by run and digest."""
    return entries.groupBy("run", *_SAME).agg(F.min("least").alias("least"), F.sum("n").alias("n"))


def merge_runs(rows: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """The first runs, and the one run that all rounds end in."""
    if fanout < 2:
        raise ValueError("a merge takes at least two runs")
    # NULL identifiers come last: a row without one stays only if its text has no other.
    least = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    first = stored(_merged(rows.select("run", *_SAME, least.alias("least"), F.lit(1).cast("bigint").alias("n"))), "run-0")
    last = first.agg(F.max("run")).first()[0] or 0
    merged, level = first, 0
    while last > 0:
        level, last = level + 1, last // fanout
        siblings = merged.withColumn("run", F.floor(F.col("run") / fanout).cast("int"))
        merged = stored(_merged(siblings), f"run-{level}")
    return first, merged


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", fanout: int = FANOUT) -> DataFrame:
    """One row for each document: ``id_column``, ``keep_id`` (identifier of the row that stays), ``group_size``,
    ``kept`` and ``text_sha256``.

    Equal are texts that are identical after each run of ASCII white space has become one space; NULL is an empty text.
    Exactly one row of a group stays: the one with the smallest identifier, of rows repeated under one identifier any
    one; a row without an identifier only if no row of its group has one, and then ``keep_id`` is NULL.  An empty
    table gives no rows.  Other columns of ``docs`` play no part, whatever their names."""
    prepare(docs.sparkSession)
    rows = stored(digests(_numbered(docs, id_column, text_column)), "digests")
    return _classes(rows, fanout).select(
        F.col("id").alias(id_column), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


def _classes(rows: DataFrame, fanout: int) -> DataFrame:
    first, last = merge_runs(rows, fanout)
    # The way back: an entry of a first run takes its group, then a row takes its entry.  A text of many rows is
    # many entries' text but only its own run's, so neither join meets a heavy key.
    entries = first.select("run", *_SAME).join(last.select(*_SAME, "least", "n"), _SAME)
    return rows.join(entries, ["run", *_SAME]).select(
        "id",
        "row",
        "sha",
        F.col("least.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("least.row")).alias("kept"),
    )


def distinct_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", fanout: int = FANOUT) -> DataFrame:
    """The rows of ``docs`` that stay, whole and under their own names."""
    prepare(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    held = stored(_numbered(docs, id_column, text_column, whole), "documents")
    kept = _classes(stored(digests(held), "digests"), fanout).where("kept").select("row")
    return held.select("row", "whole").join(kept, "row", "left_semi").select("whole.*")
