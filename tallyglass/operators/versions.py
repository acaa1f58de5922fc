"""Which copy of a row counts: within one batch, and across the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.schema import ROW_KEY, VERSION_COLUMNS

# Bits of a map of keys: 32 MiB at most, however many rows and days there are.
MAP_BITS = 1 << 28
# Fixed value: bits of one bitmap_construct_agg.
BUCKET_BITS = 32_768


def _keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    # max_by merges inside every map task first, so a key that holds a third of all rows
    # reaches its reducer as one row per task.
    payload = ", ".join(c for c in rows.columns if c not in keys)
    kept = rows.groupBy(*keys).agg(
        F.expr(f"max_by(struct({payload}), struct({', '.join(order)}))").alias("_row")
    )
    return kept.selectExpr(*[c if c in keys else f"_row.{c} AS {c}" for c in rows.columns])


def dedupe_batch(rows: DataFrame, arrival: list[str]) -> DataFrame:
    """One row per ``query_id`` in a batch: the last to arrive."""
    return _keep_last(rows, ["query_id"], arrival)


def dedupe_flush(rows: DataFrame, arrival: list[str]) -> DataFrame:
    """One row per key of the table: the last to arrive.  Keys, not ids, so that the table does not depend on
    how the input was cut into flushes."""
    return _keep_last(rows, ROW_KEY, arrival)


def latest_version(rows: DataFrame) -> DataFrame:
    """One row per ``(create_time, query_id)``: the last ingested.  The day is part of the key,
    so versions never merge across partitions and a day filter reaches the scan."""
    return _keep_last(rows, ROW_KEY, VERSION_COLUMNS)


# --- wide rows: only keys with several versions are merged ----------------------------------


def repeated_keys(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Hashes of the keys with more than one row, with the columns ``by`` (of the key).  A plain count over eight
    bytes a row: no payload is read, and a key with many rows leaves a task as one."""
    counted = rows.select(*by, F.xxhash64(*ROW_KEY).alias("h")).groupBy(*by, "h").agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n > 1").select(*by, "h")


def key_map(hashes: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """A column of hashes (``h``) as a map of ``bits`` bits in buckets of 4 KiB: ``bucket, bitmap``.  Buckets without a
    key are left out, so the map never takes more than ``bits / 8`` bytes, and none if there are no keys."""
    place = hashes.select(F.expr(f"pmod(h, {bits}L)").alias("p"))
    split = place.selectExpr(f"p div {BUCKET_BITS} AS bucket", f"p % {BUCKET_BITS} AS bit")
    return split.groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))


def marked(rows: DataFrame, hashed: str, keys: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """Rows with ``_marked``: whether the map of ``keys`` (as ``key_map`` takes them) has their bit set.  All rows of
    a key are marked, and by chance a few others.  The map is sent to the rows, whose number it does not depend on."""
    byte = f"conv(hex(substring(bitmap, CAST((_p % {BUCKET_BITS}) div 8 AS INT) + 1, 1)), 16, 10)"
    is_set = f"coalesce(getbit(CAST({byte} AS BIGINT), CAST(_p % 8 AS INT)) = 1, false)"
    met = rows.withColumn("_p", F.expr(f"pmod({hashed}, {bits}L)")).join(
        F.broadcast(key_map(keys, bits)), F.expr(f"_p div {BUCKET_BITS} = bucket"), "left"
    )
    return met.select(*rows.columns, F.expr(is_set).alias("_marked"))


def split_by_versions(rows: DataFrame, bits: int = MAP_BITS) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is theirs alone, and all others (with rows that share a bit by chance).

    The map is sent to the scan, whose rows go on without an exchange.  Its size is fixed; the more keys have several
    versions, the more of the rest share a bit with them, up to all rows, which is the plain merge."""
    met = marked(rows, f"xxhash64({', '.join(ROW_KEY)})", repeated_keys(rows), bits)
    return met.where("NOT _marked").drop("_marked"), met.where("_marked").drop("_marked")


def latest_of_few(rows: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """The rows of ``latest_version``, of which only keys with several versions are shuffled: for wide rows, which
    cost more to move than their keys cost to count."""
    alone, several = split_by_versions(rows, bits)
    return alone.unionByName(latest_version(several))
