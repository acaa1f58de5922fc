"""One entry per operator: a callable (spark, folder of the given tables) -> DataFrame.

Each runs over whole tables: either ``events``/``documents`` themselves, the event documents made of
them (landing), or the query-log table written from those through the ingest path."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.functions import display as D
from tallyglass.functions import text as X
from tallyglass.functions import times as TM
from tallyglass.operators import ingest as I
from tallyglass.operators import inputs as IN
from tallyglass.operators import listing as L
from tallyglass.operators import lookup as LK
from tallyglass.operators import table as TB
from tallyglass.operators.fingerprint import batch_fingerprint
from tallyglass.operators.versions import dedupe_batch, latest_of_few, latest_version
from tallyglass.plans import hotspots as H
from tallyglass.plans import reports as R
from tallyglass.schema import (
    LOG_COLUMNS,
    SUMMARY_COLUMNS,
    VERSION_COLUMNS,
)
from tallyglass.session import configure, fresh_path
from tallyglass.sources import querylog as Q
from tallyglass.sources import testbed as T
from tallyglass.sources.events import MAX_EVENT_BYTES, decode_events, read_events
from tallyglass.streaming import ingest as S

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

NOW = T.NOW
SINCE = datetime(2024, 1, 10, 6, 30, 0, 1)
UNTIL = datetime(2024, 1, 22, 6, 30, 0, 1)
CUTOFF = datetime(2024, 1, 20, 12, 0, 0)
# The list every sort and page query shows.
WINDOW = {"since": SINCE, "until": UNTIL}
# A cap that long statements exceed.
CAP_BYTES = 3_000


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _register(name: str, fn: Query) -> None:
    _QUERIES[name] = fn


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_events(spark, T.landing(spark, sf_dir))


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.decode_and_rate(_lines(spark, sf_dir))


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.accepted(_rated(spark, sf_dir))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.log_table(spark, sf_dir)


def _lean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log for those who read only its lean columns."""
    return T.log_table(spark, sf_dir, lean=True)


def _latest(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    log = _lean if set(columns) <= set(T.LEAN_COLUMNS) else _log
    return Q.scan_latest(log(spark, sf_dir), columns).select(*columns)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.source_rows(spark, sf_dir, documents=False)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/documents.parquet")


# --- sources -------------------------------------------------------------------------------


@query
def event_source(spark, sf_dir):
    """Counts of the whole landing, which is read part by part."""
    counts = [
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.octet_length("value") <= MAX_EVENT_BYTES).alias("n_fitting"),
        F.count_if(F.col("value").startswith('{"metadata"')).alias("n_documents"),
    ]
    parts = [read_events(spark, path).agg(*counts).first() for path in T.landing_parts(spark, sf_dir)]
    return spark.createDataFrame([tuple(map(sum, zip(*parts)))], "n_events bigint, n_fitting bigint, n_documents bigint")


@query
def decode_event(spark, sf_dir):
    event = F.col("event")
    return decode_events(_lines(spark, sf_dir)).where(~F.col("malformed")).select(
        F.expr(I.EVENT_SEQ).alias("ingest_seq"),
        event["metadata"]["queryId"].alias("query_id"),
        event["metadata"]["query"].alias("query_text"),
        event["context"]["user"].alias("user_name"),
        event["context"]["catalog"].alias("catalog"),
        event["statistics"]["outputRows"].alias("output_rows"),
        F.coalesce(F.size(event["ioMetadata"]["inputs"]), F.lit(0)).cast("bigint").alias("n_inputs"),
        event["failureInfo"]["errorCode"]["name"].alias("error_code"),
        TM.rfc3339("event.createTime").alias("create_time"),
    )


@query
def scan_log(spark, sf_dir):
    return Q.scan_log(_log(spark, sf_dir))


@query
def scan_summary(spark, sf_dir):
    return Q.scan_summary(_log(spark, sf_dir))


# Columns that a log file from before they existed lacks.
LATER_COLUMNS = ["environment", "server_version", "completed_splits", "written_rows"]


@query
def scan_coalesced(spark, sf_dir):
    older = fresh_path(spark, "older")
    _log(spark, sf_dir).drop(*LATER_COLUMNS).write.parquet(older)
    return Q.scan_coalesced(Q.read_log(spark, older))


@query
def scan_latest(spark, sf_dir):
    return _latest(spark, sf_dir, LOG_COLUMNS)


@query
def list_partitions(spark, sf_dir):
    table = T.log_table_name(spark, sf_dir)
    return TB.list_partitions(spark, table, before=CUTOFF.date()).select("partition_id")


# --- table ---------------------------------------------------------------------------------


@query
def append_log(spark, sf_dir):
    table = T.ingest_landing(spark, T.landing(spark, sf_dir), T.new_table_name(spark, "appended"))
    return spark.table(table).select(*SUMMARY_COLUMNS, *VERSION_COLUMNS)


def _narrow_table(spark, sf_dir, label: str, flushes: int = 1) -> str:
    """A table of summaries, written in one flush or one flush per version."""
    log = _lean(spark, sf_dir)
    table = T.new_table_name(spark, label)
    TB.create_log_table(spark, table, [*SUMMARY_COLUMNS, *VERSION_COLUMNS])
    if flushes == 1:
        TB.append_log(log, table)
    else:
        resent = F.col("ingested_at") > F.lit(datetime(2024, 2, 1, tzinfo=timezone.utc))
        TB.append_log(log.where(~resent), table)
        TB.append_log(log.where(resent), table)
    return table


_SHORT = ["query_id", "create_time", "query_state", "wall_ms", "ingest_seq"]


@query
def create_log_table(spark, sf_dir):
    table = _narrow_table(spark, sf_dir, "created")
    TB.create_log_table(spark, table, [*SUMMARY_COLUMNS, *VERSION_COLUMNS])  # again: no effect
    return spark.table(table).select(*SUMMARY_COLUMNS, "create_date")


@query
def partition_day(spark, sf_dir):
    return _lean(spark, sf_dir).select(
        "query_id",
        "ingest_seq",
        TM.partition_day(F.col("create_time")).alias("create_day"),
        TM.partition_id(F.col("create_time")).alias("partition_id"),
    )


@query
def cluster_on_write(spark, sf_dir):
    return TB.clustered(_lean(spark, sf_dir).select(*_SHORT, "create_date"))


@query
def batch_fingerprint_by_day(spark, sf_dir):
    return batch_fingerprint(_log(spark, sf_dir), by=["create_date"])


_register("batch_fingerprint", _QUERIES.pop("batch_fingerprint_by_day"))


# --- row transforms ------------------------------------------------------------------------


@query
def validate_events(spark, sf_dir):
    return _rated(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def suppress_source(spark, sf_dir):
    event = F.col("event")
    return _rated(spark, sf_dir).where(F.col("status") == "suppressed").select(
        F.expr(I.EVENT_SEQ).alias("ingest_seq"),
        event["metadata"]["queryId"].alias("query_id"),
        event["context"]["source"].alias("source"),
    )


def duration_cases() -> str:
    """JSON tokens for the duration of event i, valid and not (SQL for both engines)."""
    ms = "lpad(CAST((i * 37) % 1000 AS STRING), 3, '0')"
    sec = "CAST((i * 7) % 500 AS STRING)"
    return (
        "CASE i % 12 "
        f"WHEN 0 THEN '\"PT' || {sec} || '.' || {ms} || 'S\"' "
        f"WHEN 1 THEN {sec} || '.' || {ms} "
        f"WHEN 2 THEN '\"P' || CAST(i % 40 AS STRING) || 'DT' || CAST(i % 23 AS STRING) || 'H' || CAST(i % 59 AS STRING) || 'M' || {sec} || '.5S\"' "
        "WHEN 3 THEN '\"garbage\"' WHEN 4 THEN 'null' "
        "WHEN 5 THEN '\"-PT' || CAST(i % 59 AS STRING) || 'M1.5S\"' "
        "WHEN 6 THEN 'true' WHEN 7 THEN '\"2.5\"' "
        f"WHEN 8 THEN '\"PT-' || {sec} || '.25S\"' "
        "WHEN 9 THEN '\"P1W\"' WHEN 10 THEN '{\"a\":1}' "
        f"ELSE '\"+PT' || {sec} || 'H' || {sec} || 'H\"' END"
    )


@query
def duration_ms(spark, sf_dir):
    tokens = _events(spark, sf_dir).select("i", F.expr(duration_cases()).alias("token"))
    return tokens.select(
        F.col("i").alias("event_id"),
        "token",
        TM.duration_ms("parse_json(token)").alias("duration_ms"),
    )


@query
def flatten_event(spark, sf_dir):
    return I.to_log_rows(_accepted(spark, sf_dir), event_versions=True).select(*LOG_COLUMNS, "ingest_seq")


def _from_event(spark, sf_dir, columns: dict[str, str]) -> DataFrame:
    return _accepted(spark, sf_dir).selectExpr(
        f"{I.EVENT_SEQ} AS ingest_seq", *[f"{sql} AS {name}" for name, sql in columns.items()]
    )


@query
def join_tags(spark, sf_dir):
    return _from_event(spark, sf_dir, {"client_tags": I.join_tags("event.context.clientTags")})


@query
def join_resource_group(spark, sf_dir):
    path = "event.context.resourceGroupId"
    return _from_event(spark, sf_dir, {"resource_group": I.join_resource_group(path)})


@query
def failure_fields(spark, sf_dir):
    return _from_event(spark, sf_dir, I.failure_fields("event.failureInfo"))


@query
def inputs_to_json(spark, sf_dir):
    return _from_event(spark, sf_dir, {"inputs_json": I.inputs_to_json("event.ioMetadata.inputs")})


@query
def plan_policy(spark, sf_dir):
    rows = T.direct_rows(
        T.versions(_events(spark, sf_dir)),
        ["query_id", "ingest_seq", "error_code", "wall_ms", "plan", "json_plan"],
    )
    rows = rows.select("query_id", "ingest_seq", "error_code", "wall_ms", "plan", "json_plan")
    for label, capture in {"all": "all", "none": "none", "slow": "slow_or_failed"}.items():
        kept = I.apply_plan_policy(rows.select("*", F.struct("plan", "json_plan").alias("_whole")), capture, 10_000)
        rows = kept.withColumns(
            {f"plan_{label}": F.octet_length("plan").cast("bigint"), f"json_{label}": F.col("json_plan"), "plan": F.col("_whole.plan"), "json_plan": F.col("_whole.json_plan")}
        ).drop("_whole")
    return rows.drop("error_code", "wall_ms", "plan", "json_plan")


@query
def query_preview(spark, sf_dir):
    return _documents(spark, sf_dir).select(
        "doc_id", *[X.query_preview("text", n).alias(f"preview_{n}") for n in (200, 33)]
    )


@query
def truncate_fields(spark, sf_dir):
    columns = ["query_id", "query_text", "plan", "inputs_json", "client_tags", "error_message"]
    rows = T.direct_rows(
        T.source_rows(spark, sf_dir).withColumn("v", F.lit(0).cast("bigint")), columns
    )
    wide = I.truncate_fields(rows, 1000)
    narrow = {c: X.truncate_bytes(c, 15) for c in columns if c != "query_id"}
    return wide.withColumns({f"{c}_15": v for c, v in narrow.items()}).withColumnRenamed("i", "event_id")


@query
def ingest_row(spark, sf_dir):
    options = I.IngestOptions(event_versions=True, max_field_bytes=CAP_BYTES)
    return I.ingest_lines(_lines(spark, sf_dir), options).select(*LOG_COLUMNS, "ingest_seq")


@query
def one_line(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.one_line(F.col("text")).alias("line"))


@query
def ellipsize(spark, sf_dir):
    return _documents(spark, sf_dir).select(
        "doc_id", *[X.ellipsize(F.col("text"), n).alias(f"at_{n}") for n in (0, 1, 20, 500)]
    )


# --- filters -------------------------------------------------------------------------------


def _filtered(name: str, f: L.QueryFilter) -> None:
    _register(
        name,
        lambda spark, sf_dir: L.filtered_summaries(_lean(spark, sf_dir), f).select(*SUMMARY_COLUMNS),
    )


_filtered("filter_since", L.QueryFilter(since=SINCE))
_filtered("filter_until", L.QueryFilter(until=UNTIL))
_filtered("filter_user", L.QueryFilter(user=" user_8 "))
_filtered("filter_catalog", L.QueryFilter(catalog="hive "))
_filtered("filter_state", L.QueryFilter(state="CANCELED"))
_filtered("failed_only", L.toggle_failed_only(L.QueryFilter(**WINDOW)))


@query
def time_range(spark, sf_dir):
    """How many current queries each named range holds, one scan for all of them."""
    names = [*L.RANGES, "unknown"]
    bounds = {n: L.range_filter(n, NOW) for n in names}
    widest = L.filter_until(L.filter_since(_lean(spark, sf_dir), min(b.since for b in bounds.values())), NOW)
    rows = Q.scan_latest(widest, ["query_id", "create_time"])
    inside = [
        F.count_if(
            (F.col("create_time") >= F.lit(b.since.replace(tzinfo=timezone.utc)))
            & (F.col("create_time") < F.lit(b.until.replace(tzinfo=timezone.utc)))
        ).alias(n)
        for n, b in bounds.items()
    ]
    counted = rows.agg(*inside)
    stacked = ", ".join(f"'{n}', `{n}`" for n in names)
    return counted.selectExpr(f"stack({len(names)}, {stacked}) AS (range_name, n)")


@query
def get_query(spark, sf_dir):
    """The id is worked out from one event; the log is read for three days at most."""
    one = T.direct_rows(_events(spark, sf_dir).where("i = 1").withColumn("v", F.lit(0).cast("bigint")), ["query_id"])
    return LK.get_query(_log(spark, sf_dir), one.first().query_id)


@query
def query_id_day(spark, sf_dir):
    stamp = F.date_format("ts", "yyyyMMdd_HHmmss")
    candidate = (
        F.when(F.col("i") % 5 == 0, stamp)
        .when(F.col("i") % 5 == 1, F.substring(stamp, 1, 7))
        .when(F.col("i") % 5 == 2, F.concat(F.lit("manual_"), stamp))
        .when(F.col("i") % 5 == 3, F.concat(F.substring(stamp, 1, 6), F.lit("31_x")))
        .otherwise(F.concat(F.lit("2024ab30_"), F.col("i").cast("string")))
    )
    rows = _events(spark, sf_dir).select(F.col("i").alias("event_id"), candidate.alias("query_id"))
    return rows.withColumn("id_day", TM.query_id_day(F.col("query_id")))


@query
def lookup_many(spark, sf_dir):
    """Every id ever sent, looked up in the log; rejected events are not found."""
    sent = T.direct_rows(_events(spark, sf_dir).withColumn("v", F.lit(0).cast("bigint")), ["query_id"])
    columns = ["query_id", "create_time", "query_state", "wall_ms", "user_name"]
    return LK.lookup_many(_log(spark, sf_dir), sent, columns)


# --- sorts, pages --------------------------------------------------------------------------


def _sorted(name: str, **fields) -> None:
    f = L.QueryFilter(**WINDOW, **fields)

    def run(spark, sf_dir):
        page = L.list_queries(_lean(spark, sf_dir), f)
        return L.with_position(page, L.order_columns(f.sort, f.desc), f.offset)

    _register(name, run)


for _key in L.SORT_COLUMNS:
    _sorted(f"sort_{_key}", sort=_key, desc=_key not in ("start", "rows"), limit=1000)
_sorted("sort_unknown_key", sort="nonsense", limit=50)
_sorted("offset_page", sort="cpu", desc=True, limit=101, offset=300)
_sorted("deep_page", sort="wall", desc=True, limit=101, offset=2500)


LIMIT_CASES = ["", "0", "+7", "501", "5001", "99999999999999999999"]


def _counted(parts: list[tuple[str, DataFrame]], name: str, counts: dict[str, Column] | None = None) -> DataFrame:
    """One row per case: its name and what its rows count to."""
    counts = counts or {"n": F.count(F.lit(1))}
    rows = [df.agg(*[c.alias(k) for k, c in counts.items()]).select(F.lit(case).alias(name), *counts) for case, df in parts]
    return reduce(DataFrame.union, rows)


@query
def limit_clamp(spark, sf_dir):
    """How many rows a list of the whole log shows that is asked for these limits and offsets, by each of its doors.
    The versions are merged once; every page is cut out of that."""
    asked = []
    for text in LIMIT_CASES:
        n = L._int64(text)
        doors = {"store": L.store_limit(n or 0), "cli": L.store_limit(L.cli_limit(n)), "api": L.store_limit(L.api_limit(text))}
        asked += [(f"{door}:{text}", k, 0) for door, k in doors.items()]
        asked.append((f"offset:{text}", L.MAX_LIMIT, L.api_offset(text)))
    current = fresh_path(spark, "current")
    L.filtered_summaries(_lean(spark, sf_dir), L.QueryFilter()).select("create_time", "query_id").write.parquet(current)
    rows, order = spark.read.parquet(current), L.order_columns("", False)
    pages = [
        L.take_page(rows, order, k, o).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), F.lit(o).alias("o"), "n")
        for k, o in sorted({(k, o) for _, k, o in asked})
    ]
    cases = spark.createDataFrame(asked, "asked string, k int, o int")
    return cases.join(reduce(DataFrame.union, pages), ["k", "o"]).select("asked", "n")


@query
def api_list(spark, sf_dir):
    request = {"range": "30d", "user": " ", "catalog": " hive ", "sort": "bogus", "limit": "700", "offset": "10"}
    return L.api_list(_lean(spark, sf_dir), request, NOW)


@query
def page_after(spark, sf_dir):
    """The page behind the last row of another, in an order with many ties."""
    f = L.QueryFilter(**WINDOW, sort="rows", desc=True, limit=200)
    last = L.list_queries(_lean(spark, sf_dir), f).orderBy(*[c for c in L.order_columns("rows", True)]).tail(1)
    after = (last[0].output_rows, last[0].query_id) if last else None
    return L.list_queries(_lean(spark, sf_dir), replace(f, after=after))


@query
def page_has_next(spark, sf_dir):
    f = L.QueryFilter(**WINDOW, sort="bytes", desc=True)
    return L.ui_list_page(_lean(spark, sf_dir), f, page=3)


def _top(key: str) -> None:
    _register(
        f"top_{key}",
        lambda spark, sf_dir: L.top_by(_lean(spark, sf_dir), key, L.QueryFilter(state="FINISHED")),
    )


for _key in ("wall", "cpu", "bytes", "mem"):
    _top(_key)


@query
def top_by(spark, sf_dir):
    return L.top_by(_lean(spark, sf_dir), "cpu", L.QueryFilter(catalog="iceberg"), limit=500)


FLAGSHIP = L.QueryFilter(
    since=datetime(2024, 1, 5), until=datetime(2024, 1, 25), state="FAILED", sort="cpu", desc=True, limit=101
)


@query
def list_queries(spark, sf_dir):
    return L.list_queries(_lean(spark, sf_dir), FLAGSHIP)


# --- versions ------------------------------------------------------------------------------


def _versions(spark, sf_dir) -> DataFrame:
    rows = T.versions(_events(spark, sf_dir), moved=True)
    return T.direct_rows(
        rows,
        ["query_id", "create_date", "create_time", "wall_ms", "cpu_ms", "query_state", *VERSION_COLUMNS],
    ).drop("i")


@query
def dedupe_rows(spark, sf_dir):
    return dedupe_batch(_versions(spark, sf_dir), VERSION_COLUMNS)


_register("dedupe_batch", _QUERIES.pop("dedupe_rows"))


@query
def current_versions(spark, sf_dir):
    return latest_version(_versions(spark, sf_dir))


_register("latest_version", _QUERIES.pop("current_versions"))


@query
def skip_repeated_batch(spark, sf_dir):
    """First sendings, resends, first sendings again: the third flush is recognised."""
    return spark.table(T.flushed_table(spark, sf_dir)).select(*_SHORT)


# --- nested data ---------------------------------------------------------------------------


def _inputs(spark, sf_dir) -> DataFrame:
    return IN.explode_inputs(_latest(spark, sf_dir, ["query_id", "create_time", "inputs_json"]))


@query
def explode_inputs(spark, sf_dir):
    return _inputs(spark, sf_dir).drop("columns")


@query
def input_columns(spark, sf_dir):
    return IN.input_columns(_inputs(spark, sf_dir))


@query
def qualified_input_name(spark, sf_dir):
    name = IN.qualified_name(F.col("catalog_name"), F.col("schema_name"), F.col("table_name"))
    return _inputs(spark, sf_dir).select("query_id", "create_time", "input_no", name.alias("input_table"))


@query
def query_detail(spark, sf_dir):
    rows = LK.with_inputs(_latest(spark, sf_dir, LOG_COLUMNS))
    flat = rows.withColumns(
        {
            "n_inputs": F.coalesce(F.size("inputs"), F.lit(0)).cast("bigint"),
            "input_tables": F.coalesce(F.array_join(F.col("inputs.table"), ","), F.lit("")),
        }
    )
    return flat.drop("inputs")


@query
def detail_without_plans(spark, sf_dir):
    return LK.without_plans(_latest(spark, sf_dir, LOG_COLUMNS))


# --- plans ---------------------------------------------------------------------------------

_PLAN_ROWS = ["query_id", "create_time", "plan"]


@query
def plan_hotspots(spark, sf_dir):
    return H.plan_hotspots(_latest(spark, sf_dir, _PLAN_ROWS))


@query
def plan_top_n(spark, sf_dir):
    return H.plan_hotspots(_latest(spark, sf_dir, _PLAN_ROWS), top=3)


@query
def plan_op_name(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", H.operator_name(F.col("text")).alias("operator"))


@query
def parse_comma_int(spark, sf_dir):
    raw = F.expr(
        "CASE i % 5 WHEN 0 THEN '' WHEN 1 THEN ',' WHEN 2 THEN '9,999,999,999,999,999,999,' || CAST(i AS STRING) "
        "WHEN 3 THEN CAST(i AS STRING) || ',' || lpad(CAST(i % 1000 AS STRING), 3, '0') ELSE CAST(i AS STRING) END"
    )
    rows = _events(spark, sf_dir).select(F.col("i").alias("event_id"), raw.alias("raw"))
    return rows.withColumn("n", D.parse_comma_int("raw"))


@query
def hotspot_report(spark, sf_dir):
    return H.hotspot_report(_latest(spark, sf_dir, _PLAN_ROWS))


# --- display -------------------------------------------------------------------------------

# Figures of every magnitude, negative and zero included (SQL for both engines).
BYTES_CASE = (
    "CASE i % 7 WHEN 0 THEN (i * 9161453) % 100000 - 1000 WHEN 1 THEN ((i * 9161453) % 100000) * 1024 "
    "WHEN 2 THEN ((i * 9161453) % 100000) * 1048576 WHEN 3 THEN ((i * 9161453) % 100000) * 1073741824 "
    "WHEN 4 THEN ((i * 9161453) % 100000) * 1099511627776 WHEN 5 THEN 1125899906842624 * (i % 8000) "
    "ELSE i % 2000 END"
)
MS_CASE = (
    "CASE i % 5 WHEN 0 THEN (i * 6133) % 2000 - 100 WHEN 1 THEN (i * 6133) % 61000 WHEN 2 THEN (i * 6133) % 3700000 "
    "WHEN 3 THEN (i * 86243) % 400000000 ELSE i % 100000 END"
)


def _shown(name: str, case: str, show: Callable[[Column], Column]) -> None:
    def run(spark, sf_dir):
        rows = _events(spark, sf_dir).select(F.col("i").alias("event_id"), F.expr(case).alias("n"))
        return rows.withColumn("shown", show(F.col("n")))

    _register(name, run)


_shown("human_bytes_ui", BYTES_CASE, D.human_bytes_ui)
_shown("human_bytes_cli", BYTES_CASE, D.human_bytes_cli)
_shown("human_ms_ui", MS_CASE, D.human_ms_ui)
_shown("human_ms_cli", MS_CASE, D.human_ms_cli)
_shown("human_count", BYTES_CASE, D.human_count)


@query
def null_placeholder(spark, sf_dir):
    size, n = F.col("physical_input_bytes"), F.col("physical_input_rows")
    return _inputs(spark, sf_dir).select(
        "query_id",
        "create_time",
        "input_no",
        D.or_placeholder(D.human_bytes_cli(size), "-").alias("bytes_cli"),
        D.or_placeholder(D.human_count(n), "-").alias("rows_cli"),
        D.or_placeholder(D.human_bytes_ui(size), "—").alias("bytes_ui"),
        D.or_placeholder(D.human_count(n), "—").alias("rows_ui"),
    )


@query
def format_time(spark, sf_dir):
    return _log(spark, sf_dir).select(
        "query_id",
        "ingest_seq",
        D.format_time(F.col("create_time")).alias("created"),
        D.format_time(F.col("end_time")).alias("ended"),
    )


@query
def display_start(spark, sf_dir):
    return _log(spark, sf_dir).select(
        "query_id",
        "ingest_seq",
        D.display_start(F.col("execution_start_time"), F.col("create_time")).alias("start"),
    )


@query
def state_class(spark, sf_dir):
    return _log(spark, sf_dir).select(
        "query_id", "ingest_seq", D.state_class(F.col("query_state")).alias("state_class")
    )


@query
def list_report(spark, sf_dir):
    return R.list_report(_latest(spark, sf_dir, SUMMARY_COLUMNS))


@query
def dashboard_report(spark, sf_dir):
    return R.dashboard_report(_latest(spark, sf_dir, SUMMARY_COLUMNS))


@query
def detail_report(spark, sf_dir):
    return R.detail_report(_latest(spark, sf_dir, LOG_COLUMNS))


@query
def inputs_report(spark, sf_dir):
    return R.inputs_report(_inputs(spark, sf_dir))


# --- upkeep --------------------------------------------------------------------------------


# Times of three zones and the days to keep or to compact before them.
_EAST, _WEST = timezone(timedelta(hours=9)), timezone(timedelta(hours=-7))
UPKEEP_CASES = [
    (datetime(2024, 1, 22, 0, 30), 3),
    (datetime(2024, 1, 22, 0, 30, tzinfo=_EAST), 3),
    (datetime(2024, 1, 21, 20, 15, tzinfo=_WEST), 3),
    (datetime(2024, 1, 15, 23, 59, 59), 0),
    (datetime(2024, 1, 30), 14),
]


def _case(now: datetime, days: int) -> str:
    return f"{now.isoformat()} {days}"


@query
def retention_cutoff(spark, sf_dir):
    """What retention keeps at each of these times."""
    log = _lean(spark, sf_dir)
    return _counted([(_case(*c), TB.retained_rows(log, TB.retention_cutoff(*c))) for c in UPKEEP_CASES], "kept_at")


@query
def retained_rows(spark, sf_dir):
    cutoff = CUTOFF.replace(tzinfo=timezone.utc)
    return TB.retained_rows(_lean(spark, sf_dir), cutoff).select(*_SHORT)


@query
def prune(spark, sf_dir):
    table = _narrow_table(spark, sf_dir, "pruned")
    # Still the 19th in UTC.
    TB.prune(spark, table, datetime(2024, 1, 20, 3, 0, tzinfo=_EAST))
    return spark.table(table).select(*_SHORT, "create_date")


@query
def prune_exact(spark, sf_dir):
    table = _narrow_table(spark, sf_dir, "pruned_exactly", flushes=2)
    TB.prune(spark, table, CUTOFF, exact=True)
    return spark.table(table).select(*_SHORT)


@query
def compaction_window(spark, sf_dir):
    """The rows of the days that a compaction run at these times looks at."""
    log = _lean(spark, sf_dir)
    return _counted([(_case(*c), L.filter_since(log, TB.compaction_window(*c))) for c in UPKEEP_CASES], "run_at")


@query
def compact(spark, sf_dir):
    table = _narrow_table(spark, sf_dir, "compacted", flushes=2)
    TB.compact(spark, table, TB.compaction_window(NOW, 20))
    return spark.table(table).select(*_SHORT, "create_date")


@query
def compact_and_resolve(spark, sf_dir):
    table = _narrow_table(spark, sf_dir, "resolved", flushes=2)
    TB.compact(spark, table, datetime(2024, 1, 1), resolve_versions=True)
    return spark.table(table).select(*_SHORT, "create_date")


@query
def scan_resolved(spark, sf_dir):
    """Current rows of a log whose later days are resolved, so that only the earlier ones have keys to merge."""
    table = _narrow_table(spark, sf_dir, "half_resolved", flushes=2)
    TB.resolve_days(spark, table, datetime(2024, 1, 5), datetime(2024, 1, 24))
    return Q.shown(latest_of_few(spark.table(table)), SUMMARY_COLUMNS).select(*SUMMARY_COLUMNS)


# --- streaming -----------------------------------------------------------------------------


_CURRENT = ["query_id", "create_time", "query_state", "wall_ms", "cpu_ms", "error_code"]


@query
def stream_ingest(spark, sf_dir):
    table = TB.create_log_table(spark, T.new_table_name(spark, "streamed"))
    S.drain(spark, T.landing(spark, sf_dir), table, fresh_path(spark, "stream"), options=T.OPTIONS, max_files=8)
    return Q.scan_latest(spark.table(table), SUMMARY_COLUMNS).select(*SUMMARY_COLUMNS)


def _two_streams(spark, sf_dir, max_files: int) -> DataFrame:
    """Resends come by a second stream, in files older than those of the first; events carry no version."""
    table = TB.create_log_table(spark, T.new_table_name(spark, "streams"))
    for part in ("first", "later"):
        S.drain(spark, f"{T.plain_landing(spark, sf_dir)}/{part}", table, fresh_path(spark, "stream"), max_files=max_files)
    return Q.scan_latest(spark.table(table), _CURRENT).select(*_CURRENT)


@query
def stream_small_batches(spark, sf_dir):
    return _two_streams(spark, sf_dir, max_files=1)


@query
def stream_one_batch(spark, sf_dir):
    return _two_streams(spark, sf_dir, max_files=1000)


@query
def flush_by_events(spark, sf_dir):
    """One micro-batch of everything, flushed after every third of its events: current rows as from one flush."""
    table = T.cut_table(spark, sf_dir)
    return Q.scan_latest(spark.table(table), _CURRENT).select(*_CURRENT)


@query
def flush_sizes(spark, sf_dir):
    table = T.cut_table(spark, sf_dir)
    return spark.table(S.ledger_name(table)).where("state = 'done'").select("number", "n_events")


@query
def flush_batches(spark, sf_dir):
    table = TB.create_log_table(spark, T.new_table_name(spark, "batches"))
    for part in ("first", "later"):
        S.flush_batch(read_events(spark, f"{T.plain_landing(spark, sf_dir)}/{part}"), table)
    return Q.scan_latest(spark.table(table), _CURRENT).select(*_CURRENT)


@query
def late_data(spark, sf_dir):
    """Events of past days, flushed after newer ones, land in their own days; their resends come last of all."""
    table = TB.create_log_table(spark, T.new_table_name(spark, "late"))
    sent, resent = (read_events(spark, f"{T.landing(spark, sf_dir)}/v={v}") for v in (0, 1))
    is_late = F.coalesce(F.get_json_object("value", "$.createTime") < "2024-01-15", F.lit(False))
    for lines in (sent.union(resent).where(~is_late), sent.where(is_late), resent.where(is_late)):
        S.flush_batch(lines, table, T.OPTIONS)
    current = Q.scan_latest(spark.table(table), ["wall_ms"])
    return current.groupBy("create_date").agg(F.count(F.lit(1)).alias("n"), F.sum("wall_ms").alias("wall_ms"))


@query
def stream_drain(spark, sf_dir):
    table = TB.create_log_table(spark, T.new_table_name(spark, "drained"))
    checkpoint = fresh_path(spark, "drain")
    seen: list[dict] = []
    for _ in range(2):  # the second run finds nothing new
        S.drain(spark, T.landing(spark, sf_dir), table, checkpoint, options=T.OPTIONS, on_batch=seen.append)
    names = ["events_received", "events_invalid", "events_suppressed", "rows_enqueued"]
    totals = [(n, sum(c[n] for c in seen)) for n in names]
    return spark.createDataFrame(totals, "counter string, n bigint")


@query
def flush_counters(spark, sf_dir):
    return spark.table(f"{T.flushed_table(spark, sf_dir)}_counters")


@query
def ledger_counters(spark, sf_dir):
    """Totals over all runs, from the ledger alone."""
    return S.ledger_counters(spark, T.flushed_table(spark, sf_dir))


@query
def stored_rejects(spark, sf_dir):
    rejects = spark.table(S.rejects_name(T.flushed_table(spark, sf_dir)))
    return rejects.groupBy("status", "number").agg(F.count(F.lit(1)).alias("n"))


@query
def ingest_counters(spark, sf_dir):
    counted = I.ingest_counters(_rated(spark, sf_dir))
    names = ", ".join(f"'{n}', {n}" for n in counted.columns)
    return counted.selectExpr(f"stack({len(counted.columns)}, {names}) AS (counter, n)")


@query
def quarantine(spark, sf_dir):
    rejects = I.quarantine(_rated(spark, sf_dir))
    return rejects.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").startswith("{not json")).alias("n_broken")
    )


