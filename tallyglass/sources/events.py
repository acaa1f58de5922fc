"""Event documents: text lines in, typed event structs out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.functions.times import bad_rfc3339_sql
from tallyglass.schema import EVENT_SCHEMA

# Fixed value: the largest accepted event document (32 MiB).
MAX_EVENT_BYTES = 32 << 20

ARRIVAL_COLUMNS = ["file_time", "file_path", "file_offset"]


def _with_arrival(lines: DataFrame) -> DataFrame:
    return lines.select(
        "value",
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("file_offset"),
    )


def read_events(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """One JSON document per line, with the arrival order the files give; or one per file, however it is laid
    out in lines."""
    return _with_arrival(spark.read.option("recursiveFileLookup", "true").text(path, wholetext=whole_files))


def stream_events(
    spark: SparkSession, path: str, max_files: int | None = None, whole_files: bool = False, max_bytes: int | None = None
) -> DataFrame:
    """The same documents as a stream; new files are picked up as they land, at most ``max_files`` or, if that is given,
    about ``max_bytes`` at once."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    elif max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _with_arrival(reader.text(path, wholetext=whole_files))


def decode_events(lines: DataFrame) -> DataFrame:
    """Adds ``event`` and ``malformed``.  Unknown keys are ignored, absent keys are NULL; a wrong
    type, a bad time or an oversized document makes the whole event malformed."""
    fits = F.octet_length("value") <= MAX_EVENT_BYTES
    event = F.from_json(
        F.when(fits, F.col("value")),
        EVENT_SCHEMA,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )
    # As a generator output the event is parsed once per document; as a plain column the optimizer
    # would repeat the parse inside every filter it pushes down.
    parsed = lines.select("*", F.explode(F.array(event)).alias("event"))
    bad_times = " OR ".join(
        bad_rfc3339_sql(f"event.{name}") for name in ("createTime", "executionStartTime", "endTime")
    )
    malformed = f"event IS NULL OR event._corrupt_record IS NOT NULL OR {bad_times}"
    return parsed.withColumn("malformed", F.expr(f"coalesce({malformed}, true)"))
