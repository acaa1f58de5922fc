"""Query detail by id: single, many, and the parsed detail row."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.times import query_id_day
from tallyglass.operators.versions import marked
from tallyglass.schema import INPUTS_TYPE, LOG_COLUMNS, PARTITION_COLUMN
from tallyglass.sources.querylog import scan_latest

# (day, id) pairs that are sent to every task: a few MB.
FEW_IDS = 50_000


def id_day(query_id: str):
    """The day an id starts with, or None."""
    head = query_id[:8]
    if len(head) < 8 or not (head.isascii() and head.isdigit()):
        return None
    try:
        return datetime.strptime(head, "%Y%m%d").date()
    except ValueError:
        return None


def get_query(log: DataFrame, query_id: str, columns: list[str] = LOG_COLUMNS) -> DataFrame:
    """The newest current row of one id, read from three day partitions at most.  An id that does
    not start with a day matches nothing and reads nothing."""
    day = id_day(query_id)
    if day is None:
        return scan_latest(log.where(F.lit(False)), columns).select(*columns)
    near = F.col(PARTITION_COLUMN).between(
        F.lit(day - timedelta(days=1)), F.lit(day + timedelta(days=1))
    )
    hits = log.where(near & (F.col("query_id") == F.lit(query_id)))
    needed = list(dict.fromkeys([*columns, "create_time"]))
    return scan_latest(hits, needed).orderBy(F.col("create_time").desc()).limit(1).select(*columns)


def lookup_many(log: DataFrame, ids: DataFrame, columns: list[str] = LOG_COLUMNS) -> DataFrame:
    """Current rows of many ids in one job, after a first one over the ids alone.

    Each id stands for three (day, id) pairs.  Their days (one value a day) prune the partitions.  Up to ``FEW_IDS`` pairs
    are sent to the scan and nothing of the log is shuffled but what they hit; more are met by a join, behind a bit
    map of the ids that keeps most other rows out of its exchange.  A skewed id is split by adaptive execution."""
    day = query_id_day(F.col("query_id"))
    wanted = (
        ids.select("query_id")
        .distinct()
        .select(
            "query_id",
            F.explode(
                F.when(day.isNotNull(), F.array(F.date_sub(day, 1), day, F.date_add(day, 1)))
            ).alias(PARTITION_COLUMN),
        )
    )
    n, days = wanted.agg(F.count("*"), F.collect_set(PARTITION_COLUMN)).first()
    log = log.where(F.col(PARTITION_COLUMN).isin(days)) if days else log.where(F.lit(False))
    if n <= FEW_IDS:
        wanted = F.broadcast(wanted)
    else:
        log = marked(log, "xxhash64(query_id)", wanted.select(F.xxhash64("query_id").alias("h"))).where("_marked").drop("_marked")
    hits = log.join(wanted, [PARTITION_COLUMN, "query_id"], "left_semi")
    return scan_latest(hits, columns).select(*columns)


def parse_inputs(inputs_json: Column) -> Column:
    """The input list of a row; empty or broken text is NULL."""
    return F.from_json(F.when(inputs_json != "", inputs_json), INPUTS_TYPE)


def with_inputs(rows: DataFrame) -> DataFrame:
    """Detail rows: the stored row plus its parsed inputs."""
    return rows.withColumn("inputs", parse_inputs(F.col("inputs_json")))


def without_plans(rows: DataFrame) -> DataFrame:
    """Detail with the plan bodies blanked."""
    return rows.withColumns({"plan": F.lit(""), "json_plan": F.lit("")})
