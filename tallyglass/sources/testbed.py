"""Query logs derived from the supplied ``events`` and ``documents`` tables.

One event stands for one finished query and one document for its statement.  Every formula below
is SQL that both Spark and DuckDB evaluate; the few spellings that differ are in ``Dialect``."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.operators.ingest import IngestOptions
from tallyglass.operators.table import create_log_table
from tallyglass.schema import SUMMARY_COLUMNS, VERSION_COLUMNS
from tallyglass.session import configure, fresh_path
from tallyglass.sources.events import read_events
from tallyglass.streaming.ingest import drain, flush_batch

OWN_SOURCE = IngestOptions().own_source
# The events span January 2024; "now" lies inside the last day.
NOW = datetime(2024, 1, 30, 18, 0, 0)


@dataclass(frozen=True)
class Dialect:
    name: str

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def div(self, a: str, b: str | int) -> str:
        return f"({a} div {b})" if self.spark else f"(({a}) // {b})"

    def stamp(self, ts: str) -> str:
        return (
            f"date_format({ts}, 'yyyyMMdd_HHmmss')" if self.spark else f"strftime({ts}, '%Y%m%d_%H%M%S')"
        )

    def plus_ms(self, ts: str, ms: str) -> str:
        if self.spark:
            return f"({ts} + make_dt_interval(0, 0, 0, CAST({ms} AS DECIMAL(15,0)) / 1000))"
        return f"({ts} + to_milliseconds({ms}))"

    def each(self, n: str, body: str, sep: str) -> str:
        """Join ``body`` for k = 1..n; nothing when n = 0."""
        if self.spark:
            return (
                f"CASE WHEN {n} > 0 THEN array_join(transform(sequence(1L, greatest({n}, 1L)), k -> {body}), {sep}) "
                "ELSE '' END"
            )
        return f"coalesce(array_to_string(list_transform(range(1, ({n}) + 1), lambda k: {body}), {sep}), '')"


SPARK = Dialect("spark")
DUCKDB = Dialect("duckdb")

STATUS = (
    "CASE WHEN i % 101 = 7 OR i % 211 = 9 THEN 'malformed' WHEN i % 103 = 5 THEN 'invalid' "
    "WHEN i % 107 = 3 THEN 'suppressed' ELSE 'accepted' END"
)


def _text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def plan_text(d: Dialect) -> str:
    """A textual plan: fragments, branch and top-level operators, layout lines, CPU lines with and
    without output rows, some CPU lines before any operator."""
    i, k = _text("i"), _text("k")
    operator = (
        "CASE (i + k) % 4 "
        f"WHEN 0 THEN '  Collect[keys = [l_suppkey, g' || {k} || ']]' "
        f"WHEN 1 THEN '  └─ ReadTable[lineitem_' || {k} || ', pushed = (l_quantity   < ' || {i} || ')]' "
        "WHEN 2 THEN '  ├─ MergeJoin(INNER)[l_orderkey = o_orderkey]' "
        f"ELSE '  │ Partitioning: p' || {k} END"
    )
    output = (
        f"CASE WHEN k % 5 = 3 THEN '' WHEN k % 4 = 0 THEN ', Output: 60,175,31' || {_text('k % 10')} || ' rows (5MB)' "
        f"ELSE ', Output: ' || {_text('(i * k) % 7001')} || ' row (8B)' END"
    )
    share = (
        f"'  │ CPU: ' || {_text('(i * k) % 89')} || '.' || lpad({_text('(k * 13) % 100')}, 2, '0') || 'ms (' || "
        f"{_text('(i * 19 + k * 23) % 11')} || '.' || {_text('(i + k) % 8')} || '%), Waiting: 4ms' || {output}"
    )
    body = d.each("(1 + i % 7)", f"{operator} || chr(10) || {share}", "chr(10)")
    head = (
        f"CASE WHEN i % 5 = 0 THEN '  CPU: ' || {_text('i % 40')} || '.25s (' || {_text('i % 90')} || '.5%), Output: ' || {i} || ' rows' || chr(10) ELSE '' END"
    )
    return (
        f"({head} || 'Stage ' || {_text('i % 4')} || ': lineitem by l_shipdate' || chr(10) || "
        f"'  CPU: 17ms, Waiting: 1ms, Input: 60175 rows' || chr(10) || {body})"
    )


def inputs_list(d: Dialect, landed: bool) -> str:
    """The inputs array as JSON text.  The landed form has a key the log does not model, and leaves out names
    and types that the log keeps as empty texts."""
    k = _text("k")
    connector = '"connectorName":"iceberg",' if landed else ""
    unnamed = "''" if landed else "'\"catalogName\":\"\",\"schema\":\"\",'"
    untyped = "'null'" if landed else "'\"\"'"
    item = (
        f"'{{{connector}' || CASE WHEN i % 5 = 4 THEN {unnamed} ELSE '\"catalogName\":\"hive\",\"schema\":\"s' || {k} || '\",' END || "
        f"'\"table\":\"t' || {_text('(i + k) % 11')} || "
        f"'\",\"columns\":[{{\"name\":\"id\",\"type\":\"bigint\"}},{{\"name\":\"c' || {_text('i % 7')} || '\",\"type\":' || "
        f"CASE WHEN i % 5 = 3 THEN {untyped} ELSE '\"varchar\"' END || '}}],\"physicalInputBytes\":' || "
        f"CASE WHEN k = 2 AND i % 2 = 0 THEN 'null' ELSE {_text('(i * k * 4099) % 5000000')} END || ',\"physicalInputRows\":' || "
        f"CASE WHEN k = 2 AND i % 4 = 0 THEN 'null' ELSE {_text('(i * k * 31) % 70000')} END || '}}'"
    )
    return d.each("(i % 3)", item, "','")


def log_fields(d: Dialect) -> dict[str, str]:
    """Query-log columns before plan policy and preview, as SQL over
    (i, ts, user_id, event_type, doc_text, v); v numbers the versions of a row."""
    wall = "(((i * 6133 + CASE WHEN v = 1 THEN 4001 ELSE 0 END) % 160) * 125)"
    create = d.plus_ms("ts", "CASE WHEN v = 2 THEN 1000 ELSE 0 END")
    failed = "event_type = 'error'"
    inputs = inputs_list(d, landed=False)

    def count(expr: str) -> str:
        return f"CAST({expr} AS BIGINT)"

    return {
        "query_id": f"({d.stamp('ts')} || '_' || lpad({_text('i % 100000')}, 5, '0') || '_abcde')",
        "query_state": f"CASE WHEN {failed} THEN 'FAILED' WHEN event_type = 'signup' THEN 'CANCELED' ELSE 'FINISHED' END",
        "query_type": "CASE i % 7 WHEN 1 THEN 'INSERT' WHEN 2 THEN '' ELSE 'SELECT' END",
        "user_name": f"('user_' || {_text('user_id')})",
        "source": f"CASE WHEN i % 107 = 3 THEN '{OWN_SOURCE}' WHEN i % 5 = 0 THEN '' ELSE 'bi-tool' END",
        "principal": f"CASE WHEN i % 4 = 0 THEN '' ELSE 'user_' || {_text('user_id')} || '@example.com' END",
        "client_tags": f"CASE i % 3 WHEN 0 THEN '' WHEN 1 THEN 'team:data,env:prod' ELSE 't' || {_text('user_id % 7')} END",
        "catalog": "CASE i % 3 WHEN 0 THEN 'hive' WHEN 1 THEN 'iceberg' ELSE '' END",
        "schema_name": "CASE WHEN i % 2 = 0 THEN 'sales' ELSE '' END",
        "query_text": "doc_text",
        "update_type": "CASE WHEN i % 7 = 1 THEN 'INSERT' ELSE '' END",
        "create_time": create,
        "execution_start_time": f"CASE WHEN i % 4 = 0 THEN NULL ELSE {d.plus_ms(create, 'i % 3600000')} END",
        "end_time": f"CASE WHEN i % 4 = 0 THEN NULL ELSE {d.plus_ms(create, wall)} END",
        "queued_ms": count("(i % 8) * 250"),
        "analysis_ms": count("(i % 16) * 125"),
        "planning_ms": count("(i % 24) * 125"),
        "execution_ms": count("(i % 1000) * 61000"),
        "wall_ms": count(wall),
        "cpu_ms": count("CASE WHEN i % 13 IN (4, 5) THEN 0 ELSE ((i * 86243) % 80) * 125 END"),
        "peak_user_memory_bytes": count("(i * 22801763) % 100000"),
        "peak_total_memory_bytes": count("((i * 22801763) % 100000) * 2"),
        "physical_input_bytes": count("(i * 9161453) % 100000"),
        "physical_input_rows": count("(i * 31) % 5000"),
        "processed_input_bytes": count("(i * 9161453) % 100000 + 1"),
        "processed_input_rows": count("(i * 17) % 3000"),
        "output_bytes": count("(i * 13) % 70000"),
        "output_rows": count("(i * 37139213) % 1000"),
        "written_bytes": count("CASE WHEN i % 7 = 1 THEN (i * 11) % 9000 ELSE 0 END"),
        "written_rows": count("CASE WHEN i % 7 = 1 THEN (i * 3) % 900 ELSE 0 END"),
        "completed_splits": count("i % 64"),
        "error_code": f"CASE WHEN {failed} THEN CASE WHEN i % 2 = 0 THEN 'COLUMN_NOT_FOUND' ELSE 'EXCEEDED_CPU_LIMIT' END ELSE '' END",
        "error_type": f"CASE WHEN {failed} THEN CASE WHEN i % 3 = 0 THEN 'java.lang.RuntimeException' ELSE 'USER_ERROR' END ELSE '' END",
        "error_message": f"CASE WHEN {failed} THEN 'line 1:' || {_text('i')} || ':' || chr(10) || chr(9) || ' Column  is not there' ELSE '' END",
        "plan": plan_text(d),
        "json_plan": f"('{{\"id\":' || {_text('i')} || '}}')",
        "inputs_json": f"CASE WHEN i % 3 = 0 THEN '' ELSE '[' || {inputs} || ']' END",
        "resource_group": f"CASE WHEN i % 6 = 0 THEN '' ELSE 'global.user_' || {_text('user_id')} END",
        "server_version": f"('47' || {_text('i % 3')})",
        "environment": "CASE WHEN i % 10 = 0 THEN '' ELSE 'production' END",
    }


# --- Spark side ----------------------------------------------------------------------------


def spread(rows: DataFrame) -> DataFrame:
    """A one-file table arrives as one task; hand its rows to all cores before they are widened.  A table of many files stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= cores else rows.repartition(cores)


def source_rows(spark: SparkSession, sf_dir: str, documents: bool = True, part: Column | None = None, small: bool = False) -> DataFrame:
    """(i, ts, user_id, event_type[, doc_text]), one row per event; of a ``part`` only, which is sent to the documents if it
    is ``small``, so that no text is shuffled for it."""
    configure(spark)
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet")).select(
        F.col("event_id").alias("i"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type"
    )
    if part is not None:
        events = events.where(part)
    if not documents:
        return events
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", F.col("text").alias("doc_text")
    )
    n_docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # answered from file footers
    return (F.broadcast(events) if small else events).join(docs, F.col("i") % F.lit(n_docs) == F.col("doc_id")).drop("doc_id")


def versions(rows: DataFrame, moved: bool = False, only: int | None = None) -> DataFrame:
    """Every row, every tenth one again with another wall time, and with ``moved`` every fiftieth
    instead again a second later; or ``only`` those of one number, cut out before the rows are widened."""
    resent = (
        "CASE WHEN i % 50 = 0 THEN array(0L, 2L) WHEN i % 10 = 0 THEN array(0L, 1L) ELSE array(0L) END"
        if moved
        else "CASE WHEN i % 10 = 0 THEN array(0L, 1L) ELSE array(0L) END"
    )
    if only is not None:
        return rows.where(F.array_contains(F.expr(resent), F.lit(only).cast("bigint"))).withColumn("v", F.lit(only).cast("bigint"))
    return rows.withColumn("v", F.explode(F.expr(resent)))


def version_fields() -> dict[str, str]:
    return {
        "ingested_at": "CASE v WHEN 0 THEN TIMESTAMP '2024-02-01 00:00:00' WHEN 1 THEN TIMESTAMP '2024-02-01 01:00:00' "
        "ELSE TIMESTAMP '2024-02-01 02:00:00' END",
        "ingest_seq": "(i * 3 + v)",
    }


def direct_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Log columns straight from the formulas (no landing, no decode)."""
    fields = log_fields(SPARK) | version_fields() | {"create_date": f"to_date({log_fields(SPARK)['create_time']})"}
    return rows.select("i", *[F.expr(fields[c]).alias(c) for c in columns])


def landing_lines(versioned: DataFrame, own_keys: bool = True) -> DataFrame:
    """The event documents as JSON lines, some of them broken, incomplete or our own.  Without ``own_keys`` no
    event says when it was ingested; some have keys of that name that mean something else."""
    f = log_fields(SPARK)

    def opt(expr: str) -> str:
        return f"nullif({expr}, '')"

    metadata = (
        f"named_struct('queryId', CASE WHEN i % 103 = 5 AND i % 2 = 0 THEN '' ELSE {f['query_id']} END, "
        f"'query', doc_text, 'updateType', {opt(f['update_type'])}, 'queryState', {f['query_state']}, "
        f"'routines', 'none', 'plan', {f['plan']}, 'jsonPlan', {f['json_plan']})"
    )
    context = (
        f"named_struct('user', {f['user_name']}, 'principal', {opt(f['principal'])}, 'source', {opt(f['source'])}, "
        f"'catalog', {opt(f['catalog'])}, 'schema', {opt(f['schema_name'])}, "
        f"'clientTags', CASE i % 3 WHEN 0 THEN NULL ELSE split({f['client_tags']}, ',') END, "
        f"'resourceGroupId', CASE WHEN i % 6 = 0 THEN array() ELSE array('global', {f['user_name']}) END, "
        f"'queryType', {opt(f['query_type'])}, 'timezone', 'UTC', 'serverVersion', {f['server_version']}, "
        f"'environment', {opt(f['environment'])})"
    )
    failure = (
        f"named_struct('errorCode', named_struct('code', CASE WHEN i % 2 = 0 THEN 3000000000L ELSE 7L END, 'name', {f['error_code']}, "
        "'type', CASE WHEN i % 3 = 0 THEN '' ELSE 'USER_ERROR' END), "
        f"'failureType', 'java.lang.RuntimeException', 'failureMessage', {f['error_message']})"
    )

    def iso(ms: str) -> str:
        return f"'\"PT' || CAST(CAST({ms} AS DECIMAL(18,3)) / 1000 AS DECIMAL(18,3)) || 'S\"'"

    wall = (
        f"CASE i % 3 WHEN 0 THEN {iso(f['wall_ms'])} "
        f"WHEN 1 THEN CAST(CAST(CAST({f['wall_ms']} AS DECIMAL(18,3)) / 1000 AS DECIMAL(18,3)) AS STRING) "
        f"ELSE '\"PT' || ({f['wall_ms']} div 1000) || 'S' || (({f['wall_ms']} % 1000) / 1000) || 'S\"' END"
    )
    cpu = f"CASE i % 13 WHEN 4 THEN '\"garbage\"' WHEN 5 THEN 'null' ELSE {iso(f['cpu_ms'])} END"
    execution = (
        f"'\"PT' || ({f['execution_ms']} div 3600000) || 'H' || (({f['execution_ms']} % 3600000) div 60000) || 'M' || "
        f"(({f['execution_ms']} % 60000) div 1000) || 'S\"'"
    )
    numbers = {
        "peakUserMemoryBytes": "peak_user_memory_bytes",
        "peakTaskTotalMemory": "peak_total_memory_bytes",
        "physicalInputBytes": "physical_input_bytes",
        "physicalInputRows": "physical_input_rows",
        "processedInputBytes": "processed_input_bytes",
        "processedInputRows": "processed_input_rows",
        "outputBytes": "output_bytes",
        "writtenBytes": "written_bytes",
        "writtenRows": "written_rows",
        "completedSplits": "completed_splits",
    }
    statistics = " || ".join(
        [
            f"'{{\"cpuTime\":' || {cpu}",
            f"',\"wallTime\":' || {wall}",
            f"',\"queuedTime\":' || {iso(f['queued_ms'])}",
            f"',\"analysisTime\":' || {iso(f['analysis_ms'])}",
            f"',\"planningTime\":' || {iso(f['planning_ms'])}",
            f"',\"executionTime\":' || {execution}",
            "',\"cumulativeMemory\":1.23456789E9'",
            *[f"',\"{key}\":' || {f[name]}" for key, name in numbers.items()],
            f"',\"outputRows\":' || CASE WHEN i % 211 = 9 THEN '\"oops\"' ELSE {_text(f['output_rows'])} END || '}}'",
        ]
    )
    zulu = "yyyy-MM-dd''T''HH:mm:ss.SSSSSS"

    def instant(expr: str) -> str:
        return f"(date_format({expr}, '{zulu}') || 'Z')".replace("''T''", '\\\'T\\\'')

    shifted = f"(date_format({f['create_time']} + INTERVAL 2 HOURS, '{zulu}') || '+02:00')".replace(
        "''T''", '\\\'T\\\''
    )
    created = (
        "CASE WHEN i % 103 = 5 AND i % 2 = 1 THEN 'null' "
        f"WHEN i % 9 = 0 THEN '\"' || {shifted} || '\"' ELSE '\"' || {instant(f['create_time'])} || '\"' END"
    )

    def optional_time(name: str) -> str:
        return f"CASE WHEN i % 4 = 0 THEN 'null' ELSE '\"' || {instant(f[name])} || '\"' END"

    document = " || ".join(
        [
            f"'{{\"metadata\":' || to_json({metadata})",
            f"',\"statistics\":' || {statistics}",
            f"',\"context\":' || to_json({context})",
            f"',\"ioMetadata\":{{\"inputs\":[' || {inputs_list(SPARK, landed=True)} || ']}}'",
            f"CASE WHEN event_type = 'error' THEN ',\"failureInfo\":' || to_json({failure}) ELSE '' END",
            f"',\"warnings\":[],\"createTime\":' || {created}",
            f"',\"executionStartTime\":' || {optional_time('execution_start_time')}",
            f"',\"endTime\":' || {optional_time('end_time')}",
            f"',\"ingestedAt\":\"2024-02-01T0' || v || ':00:00Z\",\"ingestSeq\":' || {version_fields()['ingest_seq']} || '}}'"
            if own_keys
            else "CASE WHEN i % 4 = 0 THEN ',\"ingestedAt\":[1],\"ingestSeq\":\"abc\"}' ELSE '}' END",
            "CASE WHEN i % 97 = 11 THEN ' {\"second\":true}' ELSE '' END",
        ]
    )
    value = f"CASE WHEN i % 101 = 7 THEN '{{not json ' || i ELSE {document} END"
    return versioned.select(F.expr(value).alias("value"))


# What a session has already written, by application and source folder.
_written: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf_dir: str, kind: str, build):
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _written:
        _written[key] = build()
    return _written[key]


def _land(rows: DataFrame, path: str, mode: str = "error", compression: str | None = None) -> str:
    for v in (0, 1):
        landing_lines(versions(rows, only=v)).write.mode(mode).text(f"{path}/v={v}", compression=compression)
    return path


def landing(spark: SparkSession, sf_dir: str) -> str:
    """Folder of JSON lines: first sendings below ``v=0``, resends below ``v=1``."""
    configure(spark)
    return _once(spark, sf_dir, "landing", lambda: _land(source_rows(spark, sf_dir), fresh_path(spark, "landing")))


# Events of one part of a landing that is worked off part by part.
PART_EVENTS = 500_000


def event_parts(spark: SparkSession, sf_dir: str) -> list[tuple[Column, int]]:
    """Conditions on the time that cut the events into parts of about ``PART_EVENTS``, with the events of each.  Every event
    is in one part, and events of one time are in the same, so that no key of the log is in two; those without a time
    are in the first."""
    events = source_rows(spark, sf_dir, documents=False)
    n = -(-spark.read.parquet(f"{sf_dir}/events.parquet").count() // PART_EVENTS)  # answered from file footers
    at = F.unix_micros("ts")
    cuts = events.agg(F.percentile_approx(at, [k / n for k in range(1, n)])).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    if not cuts:
        return [(F.lit(True), events.count())]
    parts = [F.coalesce(at <= cuts[0], F.lit(True))]
    parts += [(at > a) & (at <= b) for a, b in zip(cuts, cuts[1:])] + [at > cuts[-1]]
    return list(zip(parts, events.agg(*[F.count_if(part) for part in parts]).first()))


def landing_parts(spark: SparkSession, sf_dir: str) -> Iterator[str]:
    """The documents of ``landing`` for a reader that is done with a part before it takes the next: each part is written
    over the one before, so that no more than one lies on disk.  A landing of one part is the shared one."""
    configure(spark)
    parts = _parts(spark, sf_dir)
    if len(parts) == 1:
        yield landing(spark, sf_dir)
        return
    path = fresh_path(spark, "landing-part")
    for part, n in parts:
        rows = source_rows(spark, sf_dir, part=part, small=n <= 2 * PART_EVENTS)
        yield _land(rows, path, mode="overwrite", compression="lz4")
        # Shuffle files of a part that is done go when the objects that own them are collected.
        gc.collect()
        spark._jvm.System.gc()


def _parts(spark: SparkSession, sf_dir: str) -> list[tuple[Column, int]]:
    return _once(spark, sf_dir, f"parts of {PART_EVENTS}", lambda: event_parts(spark, sf_dir))


def plain_landing(spark: SparkSession, sf_dir: str) -> str:
    """Documents without keys of ours: first sendings below ``first``; below ``later``, resends with another
    wall time and ids that come again a second later, in files that claim to be older."""

    def build() -> str:
        path = fresh_path(spark, "plain")
        rows = versions(source_rows(spark, sf_dir), moved=True)
        for name, part, files in (("first", "v = 0", 4), ("later", "v > 0", 2)):
            landing_lines(rows.where(part), own_keys=False).repartition(files).write.text(f"{path}/{name}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/later")
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for f in store.listStatus(folder):
            store.setTimes(f.getPath(), 1_000_000_000_000, -1)
        return path

    configure(spark)
    return _once(spark, sf_dir, "plain", build)


def database(spark: SparkSession) -> str:
    """A database whose managed tables lie in the shared folder."""

    def build() -> str:
        path = fresh_path(spark, "tables")
        name = "tallyglass_" + path[-12:]
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{path}'")
        return name

    return _once(spark, "", "database", build)


def new_table_name(spark: SparkSession, label: str) -> str:
    return f"{database(spark)}.{label}_{fresh_path(spark, label)[-12:]}"


# The documents of ``landing`` say when they were ingested, so that a log of them is known in advance.
OPTIONS = IngestOptions(event_versions=True)


def ingest_landing(spark: SparkSession, landing_path: str, table: str) -> str:
    """Two flushes: first sendings, then resends."""
    create_log_table(spark, table)
    for v in (0, 1):
        flush_batch(read_events(spark, f"{landing_path}/v={v}"), table, OPTIONS)
    return table


def flushed_table(spark: SparkSession, sf_dir: str) -> str:
    """A log of three flushes through the ledger: first sendings, resends, first sendings again."""

    def build() -> str:
        table = create_log_table(spark, new_table_name(spark, "flushed"))
        path = landing(spark, sf_dir)
        counters = [flush_batch(read_events(spark, f"{path}/v={v}"), table, OPTIONS) for v in (0, 1, 0)]
        totals = [(name, sum(c[name] for c in counters)) for name in counters[0]]
        spark.createDataFrame(totals, "counter string, n bigint").write.saveAsTable(f"{table}_counters")
        return table

    return _once(spark, sf_dir, "flushed", build)


def cut_table(spark: SparkSession, sf_dir: str) -> str:
    """A log streamed in one micro-batch that is flushed after every third of its events."""

    def build() -> str:
        table = create_log_table(spark, new_table_name(spark, "cut"))
        path = landing(spark, sf_dir)
        third = -(-read_events(spark, path).count() // 3)
        drain(spark, path, table, fresh_path(spark, "stream"), options=OPTIONS, max_files=100_000, max_events=third)
        return table

    return _once(spark, sf_dir, "cut", build)


# All but the statement, the plans and what only a detail shows.
LEAN_COLUMNS = [*SUMMARY_COLUMNS, "inputs_json", *VERSION_COLUMNS]


def log_table_name(spark: SparkSession, sf_dir: str, lean: bool = False) -> str:
    """The query-log table of this session, written once through the ingest path, part by part.  A log of several
    parts is written with the ``LEAN_COLUMNS`` alone for those who read no others; the rows are the same."""
    parts = len(_parts(configure(spark), sf_dir))
    columns = [*LEAN_COLUMNS, "flush"] if lean and parts > 1 else None

    def build() -> str:
        table = create_log_table(spark, new_table_name(spark, "query_log"), columns)
        for path in landing_parts(spark, sf_dir):
            ingest_landing(spark, path, table)
        return table

    return _once(spark, sf_dir, ("lean " if columns else "") + f"log of {parts}", build)


def log_table(spark: SparkSession, sf_dir: str, lean: bool = False) -> DataFrame:
    return spark.table(log_table_name(spark, sf_dir, lean))
