"""Reading the query-log table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.operators.versions import latest_of_few, latest_version
from tallyglass.schema import (
    LARGE_COLUMNS,
    LOG_COLUMNS,
    LOG_SCHEMA,
    PARTITION_COLUMN,
    ROW_KEY,
    SUMMARY_COLUMNS,
    TABLE_SCHEMA,
    VERSION_COLUMNS,
)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Every stored version with its version columns; the schema is declared, never inferred,
    so files written before a column existed read it as NULL."""
    return spark.read.schema(TABLE_SCHEMA).parquet(path)


def scan_log(log: DataFrame) -> DataFrame:
    return log.select(*LOG_COLUMNS)


def scan_summary(log: DataFrame) -> DataFrame:
    return log.select(*SUMMARY_COLUMNS)


def coalesced(name: str) -> Column:
    """NULL text as '', NULL count as 0; times stay NULL."""
    kind = LOG_SCHEMA[name].dataType.simpleString()
    default = {"string": F.lit(""), "bigint": F.lit(0).cast("bigint")}.get(kind)
    return F.col(name) if default is None else F.coalesce(F.col(name), default).alias(name)


def scan_coalesced(log: DataFrame) -> DataFrame:
    return log.select(*[coalesced(c) for c in LOG_COLUMNS])


def shown(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(PARTITION_COLUMN, *[coalesced(c) for c in columns])


def scan_latest(log: DataFrame, columns: list[str] = LOG_COLUMNS) -> DataFrame:
    """The current version of every row.  Only the wanted columns enter the merge; if texts without a bound are among
    them, only rows whose key has several versions do."""
    needed = list(dict.fromkeys([*columns, *ROW_KEY, *VERSION_COLUMNS]))
    merge = latest_of_few if set(columns) & set(LARGE_COLUMNS) else latest_version
    return shown(merge(log.select(*needed)), columns)
