"""Explicit schemas: event document, query-log table, input list."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of the query log, in order, by storage type.
_LOG_COLUMNS = """
query_id string, query_state string, query_type string, user_name string, source string,
principal string, client_tags string, catalog string, schema_name string, query_text string,
query_preview string, update_type string,
create_time timestamp, execution_start_time timestamp, end_time timestamp,
queued_ms bigint, analysis_ms bigint, planning_ms bigint, execution_ms bigint, wall_ms bigint,
cpu_ms bigint, peak_user_memory_bytes bigint, peak_total_memory_bytes bigint,
physical_input_bytes bigint, physical_input_rows bigint, processed_input_bytes bigint,
processed_input_rows bigint, output_bytes bigint, output_rows bigint, written_bytes bigint,
written_rows bigint, completed_splits bigint,
error_code string, error_type string, error_message string,
plan string, json_plan string, inputs_json string,
resource_group string, server_version string, environment string
"""

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "timestamp": T.TimestampType()}
LOG_SCHEMA = T.StructType(
    [T.StructField(name, _TYPES[kind]) for name, kind in map(str.split, _LOG_COLUMNS.split(","))]
)
LOG_COLUMNS = LOG_SCHEMA.names
STRING_COLUMNS = [f.name for f in LOG_SCHEMA if isinstance(f.dataType, T.StringType)]
BIGINT_COLUMNS = [f.name for f in LOG_SCHEMA if isinstance(f.dataType, T.LongType)]
TIME_COLUMNS = [f.name for f in LOG_SCHEMA if isinstance(f.dataType, T.TimestampType)]

# Version columns decide which copy of a row is current; the day partitions the table.  A row also says which try of
# which batch stored it (``flush``), so that a try that was broken off can be taken back.
VERSION_COLUMNS = ["ingested_at", "ingest_seq"]
PARTITION_COLUMN = "create_date"
ROW_KEY = ["create_date", "create_time", "query_id"]

TABLE_SCHEMA = (
    T.StructType(list(LOG_SCHEMA.fields))
    .add("ingested_at", T.TimestampType())
    .add("ingest_seq", T.LongType())
    .add("flush", T.StringType())
    .add(PARTITION_COLUMN, T.DateType())
)

# The projection a list shows (no statement text, no plans).
SUMMARY_COLUMNS = [
    "query_id", "create_time", "execution_start_time", "user_name", "source", "catalog",
    "query_state", "query_type", "query_preview", "wall_ms", "cpu_ms", "physical_input_bytes",
    "peak_user_memory_bytes", "output_rows", "processed_input_rows", "error_code",
]

# Payload columns that may be large; every other string is a name, tag or identifier.
LARGE_COLUMNS = ["plan", "json_plan", "query_text", "error_message", "inputs_json"]
SMALL_COLUMNS = [c for c in STRING_COLUMNS if c not in LARGE_COLUMNS]

# Keys and types of an input table.
INPUTS_TYPE = (
    "array<struct<catalogName: string, `schema`: string, `table`: string, "
    "columns: array<struct<name: string, type: string>>, "
    "physicalInputBytes: bigint, physicalInputRows: bigint>>"
)

# Keys and types of an event.  Durations are VARIANT because a JSON string and a JSON number
# mean different things; so are the keys of our own, which must never make an event malformed.
EVENT_SCHEMA = """
    metadata struct<queryId: string, transactionId: string, query: string, updateType: string,
                    preparedQuery: string, queryState: string, uri: string, plan: string,
                    jsonPlan: string>,
    statistics struct<cpuTime: variant, wallTime: variant, queuedTime: variant,
                      analysisTime: variant, planningTime: variant, executionTime: variant,
                      peakUserMemoryBytes: bigint, peakTaskTotalMemory: bigint,
                      physicalInputBytes: bigint, physicalInputRows: bigint,
                      processedInputBytes: bigint, processedInputRows: bigint,
                      outputBytes: bigint, outputRows: bigint,
                      writtenBytes: bigint, writtenRows: bigint, completedSplits: bigint>,
    context struct<user: string, principal: string, source: string, catalog: string,
                   `schema`: string, clientTags: array<string>, resourceGroupId: array<string>,
                   queryType: string, serverVersion: string, environment: string>,
    ioMetadata struct<inputs: array<struct<catalogName: string, `schema`: string, `table`: string,
                      columns: array<struct<name: string, type: string>>,
                      physicalInputBytes: bigint, physicalInputRows: bigint>>>,
    failureInfo struct<errorCode: struct<code: bigint, name: string, type: string>,
                       failureType: string, failureMessage: string>,
    createTime string, executionStartTime string, endTime string,
    ingestedAt variant, ingestSeq variant,
    _corrupt_record string
"""
