"""The query-log table: definition, append, retention, compaction.

The table is a day-partitioned Parquet table in the session catalog.  Rows are added by appends, and removed by dropping
or rewriting whole days.  Times are UTC, whatever zone a bound is given in."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.functions.times import partition_id, utc
from tallyglass.operators.versions import latest_of_few, repeated_keys
from tallyglass.schema import PARTITION_COLUMN, ROW_KEY, TABLE_SCHEMA
from tallyglass.session import fresh_path

# Fixed value: files below this size are worth rewriting.
SMALL_FILE_BYTES = 64 << 20

_FILE_OPTIONS = {
    "compression": "zstd",
    # Point lookups skip row groups; sorted files already skip on create_time.
    "parquet.bloom.filter.enabled#query_id": "true",
}


def table_ddl(name: str, columns: list[str] | None = None, buckets: int | None = None) -> str:
    fields = [f for f in TABLE_SCHEMA if columns is None or f.name in (*columns, PARTITION_COLUMN)]
    body = ",\n  ".join(f"{f.name} {f.dataType.simpleString().upper()}" for f in fields)
    options = ", ".join(f"'{k}' = '{v}'" for k, v in _FILE_OPTIONS.items())
    return (
        f"CREATE TABLE IF NOT EXISTS {name} (\n  {body}\n)\nUSING parquet\n"
        f"OPTIONS ({options})\nPARTITIONED BY ({PARTITION_COLUMN})"
        + (f"\nCLUSTERED BY (query_id) SORTED BY (query_id, create_time) INTO {buckets} BUCKETS" if buckets else "")
    )


def create_log_table(spark: SparkSession, name: str, columns: list[str] | None = None, buckets: int | None = None) -> str:
    """Create the table unless it exists.  ``columns`` narrows it (for derived logs).

    With ``buckets`` the rows of a day lie in so many files by ``query_id``, and merges of versions and joins by id
    read them without an exchange of the log.  A scan then has a task for each bucket, over all days it reads, so there
    should be as many as tasks are wanted."""
    spark.sql(table_ddl(name, columns, buckets))
    return name


def bucket_count(spark: SparkSession, table: str) -> int:
    """Buckets of a table; 0 if it has none."""
    found = spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Num Buckets'").first()
    return int(found["data_type"]) if found else 0


def clustered(rows: DataFrame) -> DataFrame:
    """Rows laid out for the write: near each other by day, sorted inside each file.

    REBALANCE keeps a small day in one file and splits a day that holds most of the rows."""
    return rows.hint("rebalance", PARTITION_COLUMN).sortWithinPartitions(*ROW_KEY)


def _shaped(rows: DataFrame, table: str) -> DataFrame:
    """The columns of a table in its order; NULL where the rows lack one."""
    target = rows.sparkSession.table(table).schema
    return rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target])


def laid_out(rows: DataFrame, table: str) -> DataFrame:
    """Rows as a write of the table wants them: ``clustered``, or dealt by bucket so that every task writes its own."""
    buckets = bucket_count(rows.sparkSession, table)
    if not buckets:
        return clustered(rows)
    return rows.repartition(buckets, "query_id").sortWithinPartitions(PARTITION_COLUMN, "query_id", "create_time")


def append_log(rows: DataFrame, table: str) -> None:
    laid_out(_shaped(rows, table), table).write.insertInto(table)


# --- rewriting days ------------------------------------------------------------------------


def _day_files(spark: SparkSession, table: str, days: Column) -> DataFrame:
    """File and size of every file of the days: (create_date, path, size).  Reads no column."""
    spark.catalog.refreshTable(table)
    log = spark.table(table).where(days)
    found = log.select(PARTITION_COLUMN, F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    return found.distinct()


def _state(spark: SparkSession, table: str, days: list[date]) -> dict[date, tuple]:
    """What tells whether a day has other files than before: one row a day."""
    files = _day_files(spark, table, F.col(PARTITION_COLUMN).isin(days))
    summed = files.groupBy(PARTITION_COLUMN).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("path")).alias("h"))
    return {r[0]: tuple(r[1:]) for r in summed.collect()}


def rewrite_days(spark: SparkSession, table: str, days: list[date], change: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> list[date]:
    """Replace the rows of whole days by what ``change`` makes of them; no other day is touched.  Returns the days done.

    The new rows are written to the shared folder first, then put in place of the days by a dynamic partition overwrite, one
    job over all of them.  A day that got rows in between is left as it is for another run.  While the second job
    commits nobody else may write to these days; should it be broken off, the rows are in the shared folder."""
    if not days:
        return []
    before = _state(spark, table, days)
    log = spark.table(table)
    staged = fresh_path(spark, "rewritten")
    change(log.where(F.col(PARTITION_COLUMN).isin(days))).select(*log.columns).write.parquet(staged)
    after = _state(spark, table, days)
    same = [day for day in days if before.get(day) == after.get(day)]
    rows = spark.read.schema(log.schema).parquet(staged).where(F.col(PARTITION_COLUMN).isin(same))
    left = {r[0] for r in rows.select(PARTITION_COLUMN).distinct().collect()}
    if left:
        overwrite_partitions(laid_out(rows, table), table)
    drop_days(spark, table, [day for day in same if day not in left])
    spark.catalog.refreshTable(table)
    return same


def overwrite_partitions(rows: DataFrame, table: str) -> None:
    """Put rows in place of just those partitions they belong to.  (The mode is a setting of the session: an insert by
    name takes no options.)"""
    conf, key = rows.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
    before = conf.get(key)
    conf.set(key, "dynamic")
    try:
        rows.write.insertInto(table, overwrite=True)
    finally:
        conf.set(key, before)


def drop_days(spark: SparkSession, table: str, days: list[date]) -> None:
    if days:
        specs = ", ".join(f"PARTITION ({PARTITION_COLUMN} = DATE '{d}')" for d in days)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {specs}")


# --- retention -----------------------------------------------------------------------------


def _utc_midnight(now: datetime) -> datetime:
    return utc(now).replace(hour=0, minute=0, second=0, microsecond=0)


def retention_cutoff(now: datetime, days: int) -> datetime:
    """UTC midnight of ``now`` minus the retention."""
    if days < 0:
        raise ValueError("retention days must not be negative")
    return _utc_midnight(now) - timedelta(days=days)


def retained_rows(log: DataFrame, cutoff: datetime) -> DataFrame:
    """What row-wise retention keeps; the implied day bound prunes the rest."""
    return log.where(
        (F.col(PARTITION_COLUMN) >= F.lit(utc(cutoff).date())) & (F.col("create_time") >= F.lit(utc(cutoff)))
    )


def list_partitions(spark: SparkSession, table: str, before: date | None = None) -> DataFrame:
    """Day partitions as (create_date, partition_id), oldest first, optionally those before a day.
    Answered by the catalog, no file is opened; a name of another form is an error."""
    names = spark.sql(f"SHOW PARTITIONS {table}")
    day = F.regexp_extract("partition", rf"^{PARTITION_COLUMN}=(\d{{4}}-\d\d-\d\d)$", 1)
    days = names.select(
        F.when(day == "", F.raise_error(F.concat(F.lit("unexpected partition "), "partition")))
        .otherwise(F.to_date(day))
        .cast("date")
        .alias(PARTITION_COLUMN)
    )
    if before is not None:
        days = days.where(F.col(PARTITION_COLUMN) < F.lit(before))
    return days.withColumn("partition_id", partition_id(F.col(PARTITION_COLUMN))).orderBy("partition_id")


def partition_days(spark: SparkSession, table: str, before: date | None = None) -> list[date]:
    """The same as a list: one value per day, so the driver holds no data."""
    return [row[0] for row in list_partitions(spark, table, before).collect()]


def prune(spark: SparkSession, table: str, cutoff: datetime, exact: bool = False) -> list[date]:
    """Drop every day before the cutoff's day.  A cutoff inside a day keeps that day whole, unless ``exact``: then its
    rows before the cutoff go too, by rewriting that one day.  Returns the days that lost rows."""
    day = utc(cutoff).date()
    old = partition_days(spark, table, before=day)
    drop_days(spark, table, old)
    if exact:
        early = spark.table(table).where((F.col(PARTITION_COLUMN) == F.lit(day)) & (F.col("create_time") < F.lit(utc(cutoff))))
        if not early.isEmpty():
            old += rewrite_days(spark, table, [day], lambda rows: retained_rows(rows, cutoff))
    return old


# --- compaction ----------------------------------------------------------------------------


def compaction_window(now: datetime, days: int) -> datetime:
    """First midnight of a window of ``days`` days that includes today."""
    return _utc_midnight(now) - timedelta(days=max(days, 1) - 1)


def fragmented_days(spark: SparkSession, table: str, since: datetime, small_bytes: int = SMALL_FILE_BYTES) -> list[date]:
    """Days from ``since`` on with at least two files below ``small_bytes``."""
    files = _day_files(spark, table, F.col(PARTITION_COLUMN) >= F.lit(utc(since).date()))
    small = files.groupBy(PARTITION_COLUMN).agg(F.count_if(F.col("size") < small_bytes).alias("n")).where("n > 1")
    return sorted(r[0] for r in small.collect())


def compact(
    spark: SparkSession, table: str, since: datetime, small_bytes: int = SMALL_FILE_BYTES, resolve_versions: bool = False
) -> list[date]:
    """Rewrite the days from ``since`` on that have small files, each into few files sorted by time.  The rows stay as they
    were, unless ``resolve_versions`` drops superseded versions."""
    days = fragmented_days(spark, table, since, small_bytes)
    return rewrite_days(spark, table, days, latest_of_few if resolve_versions else lambda rows: rows)


def resolve_days(spark: SparkSession, table: str, since: datetime, before: datetime) -> list[date]:
    """Drop superseded versions from the days from ``since`` on and before the day of ``before``.  Only days with a key
    of several versions are rewritten; reads of such a day then find no key to merge."""
    log = spark.table(table).where(
        (F.col(PARTITION_COLUMN) >= F.lit(utc(since).date())) & (F.col(PARTITION_COLUMN) < F.lit(utc(before).date()))
    )
    days = sorted(r[0] for r in repeated_keys(log, [PARTITION_COLUMN]).select(PARTITION_COLUMN).distinct().collect())
    return rewrite_days(spark, table, days, latest_of_few)
