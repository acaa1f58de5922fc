"""Ingest of landed documents into the query-log table, in batches or as a stream.

A batch is worked off in one flush, or cut into flushes of so many events.  Every flush gets a number from the table's
ledger, and its rows that number and the flush time as their version: of two rows of one key the one flushed later is
current, and within a flush the one that arrived last.  So the table does not depend on how the input was cut, and
neither a new checkpoint nor a second stream starts again below what is stored.  (Two streams that flush at the same
time may take the same number; then the time of the flush, to the microsecond, decides.)

A batch whose documents were flushed before is recognised by its fingerprint and skipped.  A batch is entered in the
ledger before its first row is stored and closed after its last; one that was broken off in between is taken back, by
the mark its rows carry, before it is tried again, however the new try is cut.

The stream is stateless: every event is accepted however late and lands in its own day, so there is no
watermark.  Rejected documents go to a table of their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyglass.functions.times import rfc3339
from tallyglass.operators.fingerprint import sealed, word_sums
from tallyglass.operators.ingest import IngestOptions, decode_and_rate, ingest_rows
from tallyglass.operators.table import append_log, overwrite_partitions, rewrite_days
from tallyglass.operators.versions import dedupe_flush
from tallyglass.schema import PARTITION_COLUMN, ROW_KEY, VERSION_COLUMNS
from tallyglass.session import fresh_path
from tallyglass.sources.events import ARRIVAL_COLUMNS, stream_events

# Fixed value: how many past batches an identical resend is recognised in.
REPEAT_WINDOW = 1000
# Files of one micro-batch, unless told otherwise: a backlog is worked off in bounded flushes.
MAX_FILES = 256

ARRIVAL_ORDER = [*VERSION_COLUMNS, *ARRIVAL_COLUMNS, "line_order"]
COUNTERS = ("events_received", "events_invalid", "events_suppressed", "rows_enqueued", "rows_flushed", "batches_flushed", "events_repeated")


def check_lines(lines: DataFrame, options: IngestOptions = IngestOptions()) -> DataFrame:
    """What a flush has to know before it writes, in one pass over the documents: (status, id, at, value, n, sums of
    hash words), one row for each key of an accepted event and for each rejected document, kept whole.  Written to the shared
    folder, as counters, fingerprint, repeated keys and rejects are all taken from it."""
    rated = decode_and_rate(lines, options).select("*", F.expr("sha2(value, 256)").alias("_h"))
    ok = F.col("status") == "accepted"
    keyed = rated.select(
        "status",
        F.when(ok, F.col("event.metadata.queryId")).alias("id"),
        F.when(ok, rfc3339("event.createTime")).alias("at"),
        F.when(F.col("status").isin("malformed", "invalid"), F.col("value")).alias("value"),
        "_h",
    )
    sums = word_sums("_h")
    grouped = keyed.groupBy("status", "id", "at", "value").agg(
        F.count(F.lit(1)).alias("n"), *[F.expr(sql).alias(name) for name, sql in sums.items()]
    )
    path = fresh_path(lines.sparkSession, "checked")
    grouped.write.parquet(path)
    return lines.sparkSession.read.schema(grouped.schema).parquet(path)


def batch_facts(checked: DataFrame) -> dict:
    """Counters of a batch, its fingerprint (as ``line_fingerprint`` gives it) and whether a key occurs twice."""

    def count(*states: str):
        inside = F.col("status").isin(*states)
        return F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).cast("bigint")

    row = checked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("events_received"),
        count("malformed", "invalid").alias("events_invalid"),
        count("suppressed").alias("events_suppressed"),
        count("accepted").alias("rows_enqueued"),
        F.count_if(F.col("status") == "accepted").alias("keys"),
        sealed("coalesce(sum(n), 0)", [f"sum({name})" for name in word_sums("_h")]).alias("fingerprint"),
    ).first()
    return row.asDict() | {"repeats": row["keys"] < row["rows_enqueued"]}


def batch_rows(
    lines: DataFrame, options: IngestOptions = IngestOptions(), repeats: bool = True, columns: list[str] | None = None
) -> DataFrame:
    """The rows one flush writes: decoded, shaped, one per key, of those ``columns`` that the table has.  Their version is
    what the event carries, if the options allow that, else NULL until the flush stamps it.  A batch known to be without
    ``repeats`` needs no shuffle here."""
    rows = ingest_rows(decode_and_rate(lines, options), options)
    if columns is not None:
        needed = {*columns, *ROW_KEY, *VERSION_COLUMNS, *ARRIVAL_COLUMNS}
        rows = rows.select(*[c for c in rows.columns if c in needed])
    if not repeats:
        return rows.drop(*ARRIVAL_COLUMNS)
    rows = rows.withColumn("line_order", F.monotonically_increasing_id())
    return dedupe_flush(rows, ARRIVAL_ORDER).drop(*ARRIVAL_COLUMNS, "line_order")


def stamped(rows: DataFrame, at: datetime, number: int, flush: str) -> DataFrame:
    """The version of a flush, where rows carry none of their own, and the mark of the try that stores them."""
    return rows.withColumns(
        {
            "ingested_at": F.coalesce("ingested_at", F.lit(at)),
            "ingest_seq": F.coalesce("ingest_seq", F.lit(number).cast("bigint")),
            "flush": F.lit(flush),
        }
    )


def cut_lines(lines: DataFrame, max_events: int | None) -> list[DataFrame]:
    """A batch as parts of ``max_events`` documents in the order they arrived; the last may have fewer.

    The documents are written once, sorted; a part is a range of their row numbers, which the scan skips to.  The driver
    sees a count for each partition."""
    if max_events is None:
        return [lines]
    if max_events < 1:
        raise ValueError("a flush takes at least one event")
    spark, order = lines.sparkSession, [*ARRIVAL_COLUMNS, "line_order"]
    laid = lines.withColumn("line_order", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = laid.select("value", *ARRIVAL_COLUMNS, F.monotonically_increasing_id().alias("at"))
    path = fresh_path(spark, "cut")
    numbered.write.parquet(path)
    held = spark.read.schema(numbered.schema).parquet(path)
    counts = {r.part: r["count"] for r in held.groupBy(F.shiftright("at", 33).alias("part")).count().collect()}
    starts, before = [], 0  # the number of the first row of each part
    for part in sorted(counts):
        while len(starts) * max_events < before + counts[part]:
            starts.append((part << 33) + len(starts) * max_events - before)
        before += counts[part]
    ends = [*starts[1:], None]
    at = F.col("at")
    return [held.where((at >= a) & (at < b) if b is not None else at >= a).drop("at") for a, b in zip(starts, ends)]


# --- ledger and rejects --------------------------------------------------------------------


def ledger_name(table: str) -> str:
    return f"{table}_batches"


def rejects_name(table: str) -> str:
    return f"{table}_rejects"


_LEDGER = (
    "stream STRING, epoch STRING, number BIGINT, state STRING, fingerprint STRING, n_events BIGINT, n_invalid BIGINT, "
    "n_suppressed BIGINT, n_rows BIGINT, n_written BIGINT, flushed_at TIMESTAMP, span BIGINT"
)


def create_ledger(spark: SparkSession, table: str) -> str:
    """Entries of batches (``begun``, ``failed``) and of their flushes (``done``, ``repeated``), only ever appended;
    ``span`` holds as many numbers as are looked back."""
    name = ledger_name(table)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_LEDGER}) USING parquet PARTITIONED BY (span)")
    return name


def create_rejects(spark: SparkSession, table: str) -> str:
    name = rejects_name(table)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (value STRING, status STRING, number BIGINT, flush STRING, span BIGINT) "
        "USING parquet PARTITIONED BY (span)"
    )
    return name


@dataclass
class Past:
    """What the recent entries of a ledger say."""

    number: int = -1
    flushed_at: datetime | None = None
    seen: set[str] = field(default_factory=set)
    # Batches that were closed, with the events of their flushes; and tries that were not.
    closed: dict[str, int] = field(default_factory=dict)
    broken: dict[str, list[int]] = field(default_factory=dict)

    def next(self, now: datetime | None = None) -> tuple[int, datetime]:
        """Number and time of the next flush; neither is ever below an earlier one."""
        now = now or datetime.now(timezone.utc)
        return self.number + 1, now if self.flushed_at is None else max(now, self.flushed_at + timedelta(microseconds=1))


def read_ledger(spark: SparkSession, ledger: str) -> Past:
    """A batch is one entry and a flush another, so the last two spans are a few thousand rows."""
    spark.catalog.refreshTable(ledger)
    spans = [int(r[0].split("=")[1]) for r in spark.sql(f"SHOW PARTITIONS {ledger}").collect()]
    past = Past()
    if not spans:
        return past
    recent = spark.table(ledger).where(F.col("span") >= max(spans) - 1).withColumn("micros", F.expr("unix_micros(flushed_at)"))
    rows = recent.collect()
    last = max(rows, key=lambda r: r.number)
    past.number = last.number
    past.flushed_at = datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=max(r.micros for r in rows))
    for r in rows:
        if r.state in ("done", "repeated"):
            past.closed[r.epoch] = past.closed.get(r.epoch, 0) + r.n_events
            if r.number > last.number - REPEAT_WINDOW:
                past.seen.add(r.fingerprint)
    for r in rows:
        if r.state in ("begun", "failed") and r.epoch not in past.closed:
            past.broken.setdefault(r.epoch, []).append(r.number)
    return past


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, datetime):
        micros = (value.astimezone(timezone.utc) - datetime.fromtimestamp(0, timezone.utc)) // timedelta(microseconds=1)
        return f"timestamp_micros({micros})"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _enter(spark: SparkSession, ledger: str, entries: list[dict]) -> None:
    if entries:
        columns = [c.split() for c in _LEDGER.split(", ")]
        rows = []
        for entry in entries:
            whole = {"span": entry["number"] // REPEAT_WINDOW, **entry}
            rows.append("(" + ", ".join(f"CAST({_literal(whole.get(name))} AS {kind})" for name, kind in columns) + ")")
        spark.sql(f"INSERT INTO {ledger} VALUES {', '.join(rows)}")


def ledger_counters(spark: SparkSession, table: str) -> DataFrame:
    """Totals of all flushes of a table, by all streams and runs: (counter, n)."""
    of = lambda name, *states: F.coalesce(F.sum(F.when(F.col("state").isin(*states), F.col(name))), F.lit(0)).cast("bigint")
    totals = {
        "events_received": of("n_events", "done", "repeated"),
        "events_invalid": of("n_invalid", "done"),
        "events_suppressed": of("n_suppressed", "done"),
        "rows_enqueued": of("n_rows", "done"),
        "rows_flushed": of("n_written", "done"),
        "batches_flushed": F.count_if(F.col("state") == "done"),
        "events_repeated": of("n_events", "repeated"),
        "batches_failed": F.count_if(F.col("state") == "failed"),
    }
    row = spark.table(create_ledger(spark, table)).agg(*[c.alias(n) for n, c in totals.items()])
    return row.selectExpr(f"stack({len(totals)}, {', '.join(f'{n!r}, {n}' for n in totals)}) AS (counter, n)")


def take_back(spark: SparkSession, table: str, marks: list[str]) -> None:
    """Remove the rows and rejects that tries of these marks stored; only days they touched are rewritten."""
    spark.catalog.refreshTable(table)
    mine = F.coalesce(F.col("flush").isin(marks), F.lit(False))
    hit = spark.table(table).where(mine).select(PARTITION_COLUMN).distinct()
    days = sorted(r[0] for r in hit.collect())
    if rewrite_days(spark, table, days, lambda rows: rows.where(~mine)) != days:
        raise RuntimeError("rows were added to a day while a broken batch was taken back; try again")
    rejects = create_rejects(spark, table)
    spans = [r[0] for r in spark.table(rejects).where(mine).select("span").distinct().collect()]
    if spans:
        log = spark.table(rejects)
        path = fresh_path(spark, "rejects")
        log.where(F.col("span").isin(spans) & ~mine).write.parquet(path)
        kept = spark.read.schema(log.schema).parquet(path)
        left = [r[0] for r in kept.select("span").distinct().collect()]
        if left:
            overwrite_partitions(kept, rejects)
        for span in set(spans) - set(left):
            spark.sql(f"ALTER TABLE {rejects} DROP IF EXISTS PARTITION (span = {span})")


def _mark(epoch: str, number: int) -> str:
    return f"{epoch}/{number}"


def flush_batch(
    lines: DataFrame,
    table: str,
    options: IngestOptions = IngestOptions(),
    stream: str = "batch",
    now: datetime | None = None,
    batch: int | None = None,
    max_events: int | None = None,
) -> dict[str, int]:
    """Write one batch of raw lines, in flushes of ``max_events`` documents if that is given, unless they were flushed
    before; returns the counters of the batch.

    The documents are passed twice: once to check them (``check_lines``), which is all a resend costs, and once to decode
    them straight into the append; only if some key occurs twice do whole rows move to be deduplicated.  ``batch`` is
    the number a stream gives it: the same number again is the same batch, which is skipped if it was closed and
    taken back first if it was broken off."""
    spark = lines.sparkSession
    ledger = create_ledger(spark, table)
    past = read_ledger(spark, ledger)
    total = dict.fromkeys(COUNTERS, 0)
    epoch = None if batch is None else f"{stream}/{batch}"
    if epoch in past.closed:
        return total | {"events_received": past.closed[epoch], "events_repeated": past.closed[epoch]}
    if epoch in past.broken:
        take_back(spark, table, [_mark(epoch, n) for n in past.broken[epoch]])
    number, at = past.next(now)
    first, begun, entries = number, False, []
    try:
        for part in cut_lines(lines, max_events):
            checked = check_lines(part, options)
            facts = batch_facts(checked)
            if facts["events_received"] == 0:
                continue
            total["events_received"] += facts["events_received"]
            epoch = epoch or f"{stream}/{facts['fingerprint']}"
            entry = {"stream": stream, "epoch": epoch, "number": number, "fingerprint": facts["fingerprint"], "n_events": facts["events_received"], "flushed_at": at}
            if facts["fingerprint"] in past.seen:
                total["events_repeated"] += facts["events_received"]
                entries.append(entry | {"state": "repeated", "number": max(number - 1, 0)})  # takes no number
                continue
            if not begun:
                if batch is None and epoch in past.broken:
                    take_back(spark, table, [_mark(epoch, n) for n in past.broken[epoch]])
                _enter(spark, ledger, [{"stream": stream, "epoch": epoch, "number": number, "state": "begun", "flushed_at": at}])
                begun = True
            mark = _mark(epoch, first)
            append_log(stamped(batch_rows(part, options, facts["repeats"], spark.table(table).columns), at, number, mark), table)
            if facts["events_invalid"]:
                rejects = checked.where("status IN ('malformed', 'invalid')").select(
                    "value", "status", F.lit(number).cast("bigint").alias("number"), F.lit(mark).alias("flush"),
                    F.lit(number // REPEAT_WINDOW).cast("bigint").alias("span"), F.explode(F.sequence(F.lit(1), "n")).alias("_k"),
                ).drop("_k")
                rejects.write.insertInto(create_rejects(spark, table))
            entries.append(
                entry | {"state": "done", "n_invalid": facts["events_invalid"], "n_suppressed": facts["events_suppressed"],
                         "n_rows": facts["rows_enqueued"], "n_written": facts["keys"]}
            )
            for name in ("events_invalid", "events_suppressed", "rows_enqueued"):
                total[name] += facts[name]
            total["rows_flushed"] += facts["keys"]
            total["batches_flushed"] += 1
            past.seen.add(facts["fingerprint"])
            number, at = number + 1, at + timedelta(microseconds=1)
    except Exception:
        if begun:
            _enter(spark, ledger, [{"stream": stream, "epoch": epoch, "number": number, "state": "failed", "flushed_at": at}])
        raise
    _enter(spark, ledger, entries)
    return total


def stream_ingest(
    spark: SparkSession,
    landing: str,
    table: str,
    checkpoint: str,
    options: IngestOptions = IngestOptions(),
    interval: str | None = None,
    max_files: int = MAX_FILES,
    on_batch: Callable[[dict[str, int]], None] | None = None,
    max_events: int | None = None,
    max_bytes: int | None = None,
) -> StreamingQuery:
    """Start the stream.  With an ``interval`` it runs on; without one it drains what has landed
    and stops.  A micro-batch takes ``max_files`` files at most, or about ``max_bytes``, whatever has piled up, and is
    flushed every ``max_events`` events.  The checkpoint must lie in a folder all executors share."""

    def write(lines: DataFrame, batch_id: int) -> None:
        # The id is kept in the checkpoint, so it survives restarts.
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        numbered = batch_id if stream else None
        counters = flush_batch(lines, table, options, stream or "stream", batch=numbered, max_events=max_events)
        if on_batch is not None:
            on_batch(counters)

    writer = (
        stream_events(spark, landing, max_files, max_bytes=max_bytes)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def drain(spark: SparkSession, landing: str, table: str, checkpoint: str, **kwargs) -> None:
    """Flush everything that has landed, then stop.  A stream works in a session of its own, so this one's view of the
    table is renewed."""
    try:
        stream_ingest(spark, landing, table, checkpoint, **kwargs).awaitTermination()
    finally:
        for name in (table, ledger_name(table), rejects_name(table)):
            if spark.catalog.tableExists(name):
                spark.catalog.refreshTable(name)
