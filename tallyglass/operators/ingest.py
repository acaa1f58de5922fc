"""From decoded events to query-log rows: one projection, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.text import query_preview, query_preview_steps, truncate_bytes
from tallyglass.functions.times import duration_ms_sql, partition_day, rfc3339_sql
from tallyglass.schema import (
    LARGE_COLUMNS,
    LOG_COLUMNS,
    PARTITION_COLUMN,
    SMALL_COLUMNS,
)
from tallyglass.sources.events import decode_events

# Fixed value: the cap of names, tags and identifiers.
MAX_SMALL_FIELD_BYTES = 16_384

PLAN_CAPTURE_MODES = ("all", "none", "slow_or_failed")


@dataclass(frozen=True)
class IngestOptions:
    own_source: str = "query-log-loader"
    plan_capture: str = "slow_or_failed"
    plan_min_wall_ms: int = 10_000
    preview_bytes: int = 200
    max_field_bytes: int = 300_000
    # Whether an event may say when it was ingested (keys ingestedAt, ingestSeq).  Off, the writer alone decides
    # which version is newer; on, whoever sends a future time keeps a row as it is.
    event_versions: bool = False

    def __post_init__(self):
        if self.plan_capture not in PLAN_CAPTURE_MODES:
            raise ValueError(f"plan_capture must be one of {PLAN_CAPTURE_MODES}")


def _text(value: str) -> str:
    return f"coalesce({value}, '')"


def _count(value: str) -> str:
    return f"coalesce({value}, 0L)"


def with_status(decoded: DataFrame, own_source: str) -> DataFrame:
    """``status``: malformed, invalid, suppressed or accepted, tested in that order."""
    invalid = F.expr(f"{_text('event.metadata.queryId')} = '' OR event.createTime IS NULL")
    own = F.expr(_text("event.context.source")) == F.lit(own_source)
    return decoded.withColumn(
        "status",
        F.when(F.col("malformed"), "malformed")
        .when(invalid, "invalid")
        .when(own, "suppressed")
        .otherwise("accepted"),
    )


def accepted(events: DataFrame) -> DataFrame:
    return events.where(F.col("status") == "accepted")


def quarantine(events: DataFrame) -> DataFrame:
    """Rejected documents, kept whole for inspection."""
    return events.where(F.col("status").isin("malformed", "invalid")).select("value", "status")


# The projection of an event is SQL over the names of its fields, so that a micro-batch is planned
# from one statement instead of hundreds of driver calls.


def join_tags(tags: str) -> str:
    return _text(f"array_join({tags}, ',', '')")


def join_resource_group(path: str) -> str:
    return _text(f"array_join({path}, '.', '')")


def failure_fields(failure: str) -> dict[str, str]:
    error_type = _text(f"{failure}.errorCode.type")
    return {
        "error_code": _text(f"{failure}.errorCode.name"),
        "error_type": f"CASE WHEN {error_type} = '' THEN {_text(f'{failure}.failureType')} ELSE {error_type} END",
        "error_message": _text(f"{failure}.failureMessage"),
    }


def inputs_to_json(inputs: str) -> str:
    """Only the modelled keys; absent names and types are '', absent figures and column lists NULL; no inputs is
    an empty text."""
    column = "named_struct('name', coalesce(c.name, ''), 'type', coalesce(c.type, ''))"
    names = ", ".join(f"'{n}', coalesce(x.`{n}`, '')" for n in ("catalogName", "schema", "table"))
    item = (
        f"named_struct({names}, 'columns', transform(x.columns, c -> {column}), "
        "'physicalInputBytes', x.physicalInputBytes, 'physicalInputRows', x.physicalInputRows)"
    )
    as_text = f"to_json(transform({inputs}, x -> {item}), map('ignoreNullFields', 'false'))"
    return f"CASE WHEN size({inputs}) > 0 THEN {as_text} ELSE '' END"


# Counter column to event key.
_COUNTERS = {
    "peak_user_memory_bytes": "peakUserMemoryBytes",
    "peak_total_memory_bytes": "peakTaskTotalMemory",
    "physical_input_bytes": "physicalInputBytes",
    "physical_input_rows": "physicalInputRows",
    "processed_input_bytes": "processedInputBytes",
    "processed_input_rows": "processedInputRows",
    "output_bytes": "outputBytes",
    "output_rows": "outputRows",
    "written_bytes": "writtenBytes",
    "written_rows": "writtenRows",
    "completed_splits": "completedSplits",
}


def flatten_event(event: str = "event") -> dict[str, str]:
    """The query-log columns of an event struct, absent optionals as '' or 0."""
    meta, stats, ctx = f"{event}.metadata", f"{event}.statistics", f"{event}.context"
    columns = {
        "query_id": _text(f"{meta}.queryId"),
        "query_state": _text(f"{meta}.queryState"),
        "query_type": _text(f"{ctx}.queryType"),
        "user_name": _text(f"{ctx}.user"),
        "source": _text(f"{ctx}.source"),
        "principal": _text(f"{ctx}.principal"),
        "client_tags": join_tags(f"{ctx}.clientTags"),
        "catalog": _text(f"{ctx}.catalog"),
        "schema_name": _text(f"{ctx}.schema"),
        "query_text": _text(f"{meta}.query"),
        "query_preview": "''",
        "update_type": _text(f"{meta}.updateType"),
        "create_time": rfc3339_sql(f"{event}.createTime"),
        "execution_start_time": rfc3339_sql(f"{event}.executionStartTime"),
        "end_time": rfc3339_sql(f"{event}.endTime"),
        "plan": _text(f"{meta}.plan"),
        "json_plan": _text(f"{meta}.jsonPlan"),
        "inputs_json": inputs_to_json(f"{event}.ioMetadata.inputs"),
        "resource_group": join_resource_group(f"{ctx}.resourceGroupId"),
        "server_version": _text(f"{ctx}.serverVersion"),
        "environment": _text(f"{ctx}.environment"),
    }
    for phase in ("queued", "analysis", "planning", "execution", "wall", "cpu"):
        columns[f"{phase}_ms"] = duration_ms_sql(f"{stats}.{phase}Time")
    columns |= {column: _count(f"{stats}.{key}") for column, key in _COUNTERS.items()}
    columns |= failure_fields(f"{event}.failureInfo")
    return {column: columns[column] for column in LOG_COLUMNS}


# The version an event carries, whatever kind of value its keys hold.
EVENT_TIME = rfc3339_sql("try_variant_get(event.ingestedAt, '$', 'string')")
EVENT_SEQ = "try_variant_get(event.ingestSeq, '$', 'bigint')"


def to_log_rows(events: DataFrame, event_versions: bool = False) -> DataFrame:
    """Flatten, keeping the arrival columns and adding the version the event carries, or none."""
    carried = [c for c in events.columns if c not in ("value", "event", "malformed", "status")]
    return events.selectExpr(
        *[f"{sql} AS {column}" for column, sql in flatten_event().items()],
        f"{EVENT_TIME if event_versions else 'CAST(NULL AS TIMESTAMP)'} AS ingested_at",
        f"{EVENT_SEQ if event_versions else 'CAST(NULL AS BIGINT)'} AS ingest_seq",
        *carried,
    )


def keeps_plans(capture: str, min_wall_ms: int) -> Column:
    """Failed means an error code is set, whatever the state says."""
    if capture == "all":
        return F.lit(True)
    if capture == "none":
        return F.lit(False)
    return (F.col("error_code") != "") | (F.col("wall_ms") >= min_wall_ms)


def apply_plan_policy(rows: DataFrame, capture: str, min_wall_ms: int) -> DataFrame:
    keep = keeps_plans(capture, min_wall_ms)
    return rows.withColumns({c: F.when(keep, F.col(c)).otherwise("") for c in ("plan", "json_plan")})


def with_preview(rows: DataFrame, n_bytes: int) -> DataFrame:
    """The preview in steps of one projection each, so that no text is flattened twice and all is generated code."""
    if n_bytes <= 0:
        return rows.withColumn("query_preview", query_preview("query_text", n_bytes))
    steps = query_preview_steps("query_text", n_bytes)
    for name, sql in steps.items():
        rows = rows.withColumn(name, F.expr(sql))
    return rows.drop(*list(steps)[:-1])


def truncate_fields(rows: DataFrame, max_bytes: int) -> DataFrame:
    if max_bytes <= 0:
        return rows
    small = min(max_bytes, MAX_SMALL_FIELD_BYTES)
    capped = {c: truncate_bytes(c, max_bytes) for c in LARGE_COLUMNS if c in rows.columns}
    capped |= {c: truncate_bytes(c, small) for c in SMALL_COLUMNS if c in rows.columns}
    return rows.withColumns(capped)


def ingest_rows(events: DataFrame, options: IngestOptions = IngestOptions()) -> DataFrame:
    """Accepted events to finished rows.  The plan policy and the preview see whole texts; fields
    are capped last."""
    rows = to_log_rows(accepted(events), options.event_versions)
    rows = apply_plan_policy(rows, options.plan_capture, options.plan_min_wall_ms)
    rows = with_preview(rows, options.preview_bytes)
    rows = truncate_fields(rows, options.max_field_bytes)
    return rows.withColumn(PARTITION_COLUMN, partition_day(F.col("create_time")))


def decode_and_rate(lines: DataFrame, options: IngestOptions = IngestOptions()) -> DataFrame:
    return with_status(decode_events(lines), options.own_source)


def ingest_lines(lines: DataFrame, options: IngestOptions = IngestOptions()) -> DataFrame:
    """The whole batch path for raw lines."""
    return ingest_rows(decode_and_rate(lines, options), options)


def counter_columns() -> list[Column]:
    """Ingest counters as aggregates over rated events; fit for ``agg`` and for ``observe``."""

    def count(*states: str) -> Column:
        return F.count(F.when(F.col("status").isin(*states), F.lit(1)))

    return [
        F.count(F.lit(1)).alias("events_received"),
        count("malformed", "invalid").alias("events_invalid"),
        count("suppressed").alias("events_suppressed"),
        count("accepted").alias("rows_enqueued"),
    ]


def ingest_counters(events: DataFrame) -> DataFrame:
    """One row of counters; counts combine inside every task before the single merge."""
    return events.agg(*counter_columns())

