"""DuckDB statements that must give what the registered queries give.

They compute from the given tables alone: the log is rebuilt from the same source formulas, and
every operator is written again in SQL."""

from __future__ import annotations

from datetime import timedelta, timezone

from tallyglass import registry as G
from tallyglass.operators import listing as L
from tallyglass.schema import LOG_COLUMNS, STRING_COLUMNS, SUMMARY_COLUMNS, VERSION_COLUMNS
from tallyglass.sources import testbed as T

_FIELDS = T.log_fields(T.DUCKDB)
_WHITE = (
    r"[\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
_BLANK = r"[\t\f\r ]"


def flat(text: str) -> str:
    return f"trim(regexp_replace({text}, '{_WHITE}+', ' ', 'g'), ' ')"


def byte_cut(text: str, n: str) -> str:
    tries = ", ".join(f"try(decode(encode({text})[1:({n}) - {k}]))" for k in range(4))
    return f"CASE WHEN strlen({text}) <= ({n}) THEN {text} ELSE coalesce({tries}, '') END"


def truncated(text: str, limit: int) -> str:
    room = f"({limit} - 22 - length(CAST(strlen({text}) AS VARCHAR)))"
    kept = byte_cut(text, room)
    return (
        f"CASE WHEN strlen({text}) <= {limit} THEN {text} WHEN {room} <= 0 THEN {byte_cut(text, str(limit))} "
        f"ELSE ({kept}) || chr(10) || '…[truncated ' || CAST(strlen({text}) - strlen({kept}) AS VARCHAR) || ' bytes]' END"
    )


def ellipsized(text: str, n: int) -> str:
    if n <= 0:
        return "''"
    if n == 1:
        return f"left({text}, 1)"
    return f"CASE WHEN length({text}) <= {n} THEN {text} ELSE left({text}, {n - 1}) || '…' END"


# --- the log -------------------------------------------------------------------------------

_EVENTS = f"""
src AS (
  SELECT event_id AS i, ts, user_id, event_type, 0 AS v
  FROM events
)"""


def _columns(names: list[str]) -> str:
    return ", ".join(f"{_FIELDS[n]} AS {n}" for n in names)


_RAW_COLUMNS = [c for c in LOG_COLUMNS if c != "query_preview"]
_INGESTED = (
    "TIMESTAMP '2024-02-01 00:00:00' + to_hours(v) AS ingested_at, CAST(i * 3 + v AS BIGINT) AS ingest_seq"
)
_KEEP = "(error_code <> '' OR wall_ms >= 10000)"

_DOCS = f"""
src0 AS (
  SELECT e.event_id AS i, e.ts, e.user_id, e.event_type, d.text AS doc_text
  FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)
),
src AS (SELECT *, {T.STATUS} AS status FROM src0)"""

# Everything sent, first sendings (v = 0) and resends (v = 1).
_SENT = f"""{_DOCS},
sent AS (
  SELECT *, unnest(CASE WHEN i % 10 = 0 THEN [CAST(0 AS BIGINT), CAST(1 AS BIGINT)] ELSE [CAST(0 AS BIGINT)] END) AS v
  FROM src
)"""

_LOG = f"""{_SENT},
flattened AS (
  SELECT i, v, {_columns(_RAW_COLUMNS)}, '' AS query_preview, {_INGESTED}
  FROM sent WHERE status = 'accepted'
),
flat_text AS (SELECT *, {flat('query_text')} AS one_line_text FROM flattened),
log AS (
  SELECT * EXCLUDE (one_line_text) REPLACE (
    CASE WHEN {_KEEP} THEN plan ELSE '' END AS plan,
    CASE WHEN {_KEEP} THEN json_plan ELSE '' END AS json_plan,
    {byte_cut('one_line_text', '200')} AS query_preview),
    CAST(create_time AS DATE) AS create_date
  FROM flat_text
),
latest AS (
  SELECT * FROM log
  QUALIFY row_number() OVER (PARTITION BY create_time, query_id ORDER BY ingested_at DESC, ingest_seq DESC) = 1
)"""


def _with(prelude: str, body: str) -> str:
    return f"WITH {prelude.strip()}\n{body.strip()}"


def log(body: str) -> str:
    return _with(_LOG, body)


def events(body: str) -> str:
    return _with(_EVENTS, body)


_SHORT = ", ".join(G._SHORT)
_SUMMARY = ", ".join(SUMMARY_COLUMNS)
_ALL = ", ".join(LOG_COLUMNS)


def _ts(t) -> str:
    return f"TIMESTAMP '{t:%Y-%m-%d %H:%M:%S.%f}'"


_IN_WINDOW = f"create_time >= {_ts(G.SINCE)} AND create_time < {_ts(G.UNTIL)}"


def _order(sort: str, desc: bool) -> str:
    way = "DESC NULLS LAST" if desc else "ASC NULLS LAST"
    return f"{L.SORT_COLUMNS.get(sort, 'create_time')} {way}, query_id {way}"


def _page(sort: str, desc: bool, limit: int, offset: int = 0, where: str = _IN_WINDOW) -> str:
    order = _order(sort, desc)
    return log(
        f"SELECT {_SUMMARY}, row_number() OVER (ORDER BY {order}) AS position FROM latest WHERE {where} "
        f"ORDER BY {order} LIMIT {limit} OFFSET {offset}"
    )


# --- inputs --------------------------------------------------------------------------------

_INPUTS = f"""{_LOG},
input AS (
  SELECT query_id, create_time, i, k AS input_no, CASE WHEN i % 5 = 4 THEN '' ELSE 'hive' END AS catalog_name,
    CASE WHEN i % 5 = 4 THEN '' ELSE 's' || k END AS schema_name,
    't' || ((i + k) % 11) AS table_name,
    CASE WHEN k = 2 AND i % 2 = 0 THEN NULL ELSE (i * k * 4099) % 5000000 END AS physical_input_bytes,
    CASE WHEN k = 2 AND i % 4 = 0 THEN NULL ELSE (i * k * 31) % 70000 END AS physical_input_rows
  FROM (SELECT query_id, create_time, i, unnest(range(1, i % 3 + 1)) AS k FROM latest)
)"""


# --- display -------------------------------------------------------------------------------


def _fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', {x})"


def bytes_ui(n: str) -> str:
    units = ["KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]
    whens = "".join(
        f"WHEN {n} // {1024 ** p} < 1024 THEN {_fixed(f'CAST({n} AS DOUBLE) / {1024 ** p}.0', 1)} || ' {u}' "
        for p, u in enumerate(units, start=1)
    )
    return f"CASE WHEN {n} <= 0 THEN '0' WHEN {n} < 1024 THEN {n} || ' B' {whens} END"


def bytes_cli(n: str) -> str:
    units = ["KiB", "MiB", "GiB", "TiB"]
    x = f"CAST({n} AS DOUBLE)"
    whens = "".join(
        f"WHEN {x} < {1024 ** (p + 1)}.0 THEN {_fixed(f'{x} / {1024 ** p}.0', 1)} || '{u}' "
        for p, u in enumerate(units, start=1)
    )
    return (
        f"CASE WHEN {n} <= 0 THEN '0' WHEN {n} < 1024 THEN {n} || 'B' {whens}"
        f"WHEN {n} IS NOT NULL THEN {_fixed(f'{x} / {1024 ** 5}.0', 1)} || 'PiB' END"
    )


def ms_shown(n: str, digits: int) -> str:
    return (
        f"CASE WHEN {n} <= 0 THEN '0' WHEN {n} < 1000 THEN {n} || 'ms' "
        f"WHEN {n} < 60000 THEN {_fixed(f'CAST({n} AS DOUBLE) / 1000.0', digits)} || 's' "
        f"WHEN {n} < 3600000 THEN ({n} // 60000) || 'm' || (({n} // 1000) % 60) || 's' "
        f"WHEN {n} IS NOT NULL THEN ({n} // 3600000) || 'h' || (({n} // 60000) % 60) || 'm' END"
    )


def count_shown(n: str) -> str:
    return f"format('{{:,}}', {n})"


def time_shown(t: str) -> str:
    return f"coalesce(strftime({t}, '%Y-%m-%d %H:%M:%S'), '—')"


# --- plans ---------------------------------------------------------------------------------

_HOTSPOTS = rf"""{_LOG},
line AS (
  SELECT query_id, create_time, unnest(string_split(plan, chr(10))) AS ln,
         generate_subscripts(string_split(plan, chr(10)), 1) AS n
  FROM latest WHERE plan <> ''
),
classed AS (
  SELECT *,
    CASE WHEN regexp_matches(ln, '[├└]─{_BLANK}*(.+)$') THEN regexp_extract(ln, '[├└]─{_BLANK}*(.+)$', 1)
         WHEN regexp_matches(ln, '^{_BLANK}*([A-Z][A-Za-z]+\[.*)$') THEN regexp_extract(ln, '^{_BLANK}*([A-Z][A-Za-z]+\[.*)$', 1)
    END AS op,
    'CPU:{_BLANK}*([0-9.]+{_BLANK}*[a-zµ]+){_BLANK}*\(([0-9.]+)%\)' AS cpu_pattern
  FROM line
),
named AS (
  SELECT *, {flat('op')} AS op_line FROM classed
),
labelled AS (
  SELECT *, {ellipsized('op_line', 60)} AS label FROM named
),
tracked AS (
  SELECT *, coalesce(last_value(label IGNORE NULLS) OVER (
    PARTITION BY query_id, create_time ORDER BY n ROWS UNBOUNDED PRECEDING), '') AS operator
  FROM labelled
),
hotspot AS (
  SELECT query_id, create_time, n, operator,
    coalesce(TRY_CAST(regexp_extract(ln, cpu_pattern, 2) AS DOUBLE), 0.0) AS cpu_pct,
    {flat('regexp_extract(ln, cpu_pattern, 1)')} AS cpu,
    coalesce(TRY_CAST(replace(regexp_extract(ln, 'Output:{_BLANK}*([0-9,]+){_BLANK}+rows?', 1), ',', '') AS BIGINT), 0) AS rows
  FROM tracked WHERE op IS NULL AND regexp_matches(ln, cpu_pattern)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, create_time ORDER BY cpu_pct DESC, n) AS hotspot_rank
  FROM hotspot
)"""


def _fingerprint() -> str:
    def shown(c: str) -> str:
        return f"CAST(epoch_us({c}) AS VARCHAR)" if c in ("create_time", "execution_start_time", "end_time") else f"CAST({c} AS VARCHAR)"

    lengths = ", ".join(f"coalesce(CAST(strlen({shown(c)}) AS VARCHAR), '')" for c in LOG_COLUMNS)
    values = ", ".join(f"coalesce({shown(c)}, '')" for c in LOG_COLUMNS)
    row = f"concat(concat_ws(' ', {lengths}), chr(10), {values})"
    sums = " || '|' || ".join(
        f"CAST(sum(CAST('0x' || substr(h, {8 * w + 1}, 8) AS BIGINT)) AS VARCHAR)" for w in range(8)
    )
    return log(
        f"SELECT create_date, count(*) AS n_rows, sha256(CAST(count(*) AS VARCHAR) || '|' || {sums}) AS fingerprint "
        f"FROM (SELECT create_date, sha256({row}) AS h FROM log) GROUP BY create_date"
    )


def _duration() -> str:
    ms = "lpad(CAST((i * 37) % 1000 AS VARCHAR), 3, '0')"
    sec = "((i * 7) % 500)"

    def nanos(x: str) -> str:
        return f"CAST(trunc(({x}) * 1e9) AS BIGINT)"

    decimal_text = f"CAST(CAST({sec} AS VARCHAR) || '.' || {ms} AS DOUBLE)"
    return events(
        f"SELECT i AS event_id, {G.duration_cases()} AS token, CASE i % 12 "
        f"WHEN 0 THEN {nanos(decimal_text)} // 1000000 WHEN 1 THEN {nanos(decimal_text)} // 1000000 "
        f"WHEN 2 THEN (i % 40) * 86400000 + (i % 23) * 3600000 + (i % 59) * 60000 + {sec} * 1000 + 500 "
        f"WHEN 5 THEN -((i % 59) * 60000 + 1500) "
        f"WHEN 8 THEN -({sec} * 1000 + 250) WHEN 11 THEN {sec} * 7200000 ELSE 0 END AS duration_ms FROM src"
    )


def _policy() -> str:
    keep = "(error_code <> '' OR wall_ms >= 10000)"
    return _with(
        f"""{_SENT},
rows AS (SELECT {_columns(['query_id', 'error_code', 'wall_ms', 'plan', 'json_plan'])}, {_INGESTED} FROM sent)""",
        f"SELECT query_id, ingest_seq, strlen(plan) AS plan_all, json_plan AS json_all, CAST(0 AS BIGINT) AS plan_none, "
        f"'' AS json_none, CASE WHEN {keep} THEN strlen(plan) ELSE 0 END AS plan_slow, "
        f"CASE WHEN {keep} THEN json_plan ELSE '' END AS json_slow FROM rows",
    )


def _truncate_fields() -> str:
    columns = ["query_text", "plan", "inputs_json", "client_tags", "error_message"]
    wide = ", ".join(f"{truncated(c, 1000)} AS {c}" for c in columns)
    narrow = ", ".join(f"{truncated(c, 15)} AS {c}_15" for c in columns)
    return _with(
        f"""{_DOCS},
rows AS (SELECT i AS event_id, {_columns(['query_id', *columns])} FROM (SELECT *, 0 AS v FROM src))""",
        f"SELECT event_id, query_id, {wide}, {narrow} FROM rows",
    )


def _versions(keep: str) -> str:
    names = ["query_id", "create_time", "wall_ms", "cpu_ms", "query_state"]
    return _with(
        f"""{_DOCS},
sent AS (
  SELECT *, unnest(CASE WHEN i % 50 = 0 THEN [CAST(0 AS BIGINT), CAST(2 AS BIGINT)]
                        WHEN i % 10 = 0 THEN [CAST(0 AS BIGINT), CAST(1 AS BIGINT)] ELSE [CAST(0 AS BIGINT)] END) AS v
  FROM src
),
rows AS (SELECT {_columns(names)}, {_INGESTED} FROM sent)""",
        f"SELECT *, CAST(create_time AS DATE) AS create_date FROM rows "
        f"QUALIFY row_number() OVER (PARTITION BY {keep} ORDER BY ingested_at DESC, ingest_seq DESC) = 1",
    )


def _id_day() -> str:
    stamp = "strftime(ts, '%Y%m%d_%H%M%S')"
    return events(
        f"SELECT event_id, query_id, CASE WHEN regexp_matches(query_id, '^[0-9]{{8}}') "
        f"THEN CAST(try_strptime(left(query_id, 8), '%Y%m%d') AS DATE) END AS id_day FROM ("
        f"SELECT i AS event_id, CASE i % 5 WHEN 0 THEN {stamp} WHEN 1 THEN left({stamp}, 7) "
        f"WHEN 2 THEN 'manual_' || {stamp} WHEN 3 THEN left({stamp}, 6) || '31_x' ELSE '2024ab30_' || i END AS query_id FROM src)"
    )


def _limits() -> str:
    parts = []
    for text in G.LIMIT_CASES:
        n = L._int64(text)
        store = n if n is not None and 0 < n <= 5000 else 100
        cli = min(max(20 if n is None else n, 1), 500)
        api = 100 if n is None or n < 1 else min(n, 500)
        offset = 0 if n is None or n < 0 else min(n, 100_000)
        parts += [(f"{door}:{text}", k, 0) for door, k in (("store", store), ("cli", cli), ("api", api))] + [(f"offset:{text}", 5000, offset)]
    rows = ", ".join(f"('{case}', {limit}, {offset})" for case, limit, offset in parts)
    return log(
        "SELECT asked, CAST(greatest(least((SELECT count(*) FROM latest) - o, l), 0) AS BIGINT) AS n "
        f"FROM (VALUES {rows}) x(asked, l, o)"
    )


def _upkeep(name: str, back) -> str:
    parts = []
    for now, days in G.UPKEEP_CASES:
        day = (now.astimezone(timezone.utc) if now.tzinfo else now).date() - timedelta(days=back(days))
        parts.append(f"SELECT '{G._case(now, days)}' AS {name}, count(*) AS n FROM log WHERE create_time >= TIMESTAMP '{day} 00:00:00'")
    return log(" UNION ALL ".join(parts))


# Counters of three flushes: first sendings, resends, first sendings again.
_FLUSHED = (
    "SELECT 'events_received' AS counter, count(*) + count(*) FILTER (WHERE v = 0) AS n FROM sent UNION ALL "
    "SELECT 'events_invalid', count(*) FROM sent WHERE status IN ('malformed', 'invalid') UNION ALL "
    "SELECT 'events_suppressed', count(*) FROM sent WHERE status = 'suppressed' UNION ALL "
    "SELECT 'rows_enqueued', count(*) FROM sent WHERE status = 'accepted' UNION ALL "
    "SELECT 'rows_flushed', count(*) FROM sent WHERE status = 'accepted' UNION ALL SELECT 'batches_flushed', 2 UNION ALL "
    "SELECT 'events_repeated', count(*) FROM sent WHERE v = 0"
)

_PLAIN = f"""{_DOCS},
sent AS (
  SELECT *, unnest(CASE WHEN i % 50 = 0 THEN [CAST(0 AS BIGINT), CAST(2 AS BIGINT)]
                        WHEN i % 10 = 0 THEN [CAST(0 AS BIGINT), CAST(1 AS BIGINT)] ELSE [CAST(0 AS BIGINT)] END) AS v
  FROM src
),
rows AS (SELECT v, {_columns(G._CURRENT)} FROM sent WHERE status = 'accepted')"""


def _plain_current() -> str:
    return _with(_PLAIN, f"SELECT {', '.join(G._CURRENT)} FROM rows QUALIFY row_number() OVER (PARTITION BY create_time, query_id ORDER BY v DESC) = 1")


def _api_list() -> str:
    hits = f"hits AS (SELECT * FROM latest WHERE catalog = 'hive' AND create_time >= {_ts(G.NOW - timedelta(days=30))} AND create_time < {_ts(G.NOW)})"
    return _with(
        f"{_LOG},\n{hits}",
        f"SELECT *, (SELECT count(*) FROM hits) > 510 AS has_next FROM (SELECT {_SUMMARY}, row_number() OVER (ORDER BY {_order('start', True)}) AS position FROM hits) "
        "WHERE position BETWEEN 11 AND 510",
    )


def _comma_int() -> str:
    return events(
        "SELECT i AS event_id, CASE i % 5 WHEN 0 THEN '' WHEN 1 THEN ',' WHEN 2 THEN '9,999,999,999,999,999,999,' || i "
        "WHEN 3 THEN i || ',' || lpad(CAST(i % 1000 AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END AS raw, "
        "CASE i % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 9223372036854775807 WHEN 3 THEN i * 1000 + i % 1000 ELSE i END AS n "
        "FROM src"
    )


def _shown(case: str, show: str) -> str:
    return events(f"SELECT event_id, n, {show} AS shown FROM (SELECT i AS event_id, {case} AS n FROM src)")


def _range_counts() -> str:
    parts = []
    for name in (*L.RANGES, "unknown"):
        f = L.range_filter(name, G.NOW)
        parts.append(
            f"SELECT '{name}' AS range_name, count(*) AS n FROM latest "
            f"WHERE create_time >= {_ts(f.since)} AND create_time < {_ts(f.until)}"
        )
    return log(" UNION ALL ".join(parts))


def _detail() -> str:
    error_line = flat("error_message")
    return log(
        "SELECT query_id, CASE WHEN error_code <> '' THEN query_state || '  (' || error_code || ' / ' || error_type || ')' ELSE query_state END AS state, "
        "user_name || '    Source ' || source || '    Type ' || query_type AS user, "
        f"'queued ' || {ms_shown('queued_ms', 1)} || '  planning ' || {ms_shown('planning_ms', 1)} || '  exec ' || {ms_shown('execution_ms', 1)} || '  wall ' || {ms_shown('wall_ms', 1)} AS timings, "
        f"({ms_shown('cpu_ms', 1)}) || '    Peak mem ' || {bytes_cli('peak_user_memory_bytes')} AS cpu, "
        f"'in ' || {bytes_cli('physical_input_bytes')} || ' / ' || {count_shown('physical_input_rows')} || ' rows    out ' || {count_shown('output_rows')} || ' rows    written ' || {count_shown('written_rows')} || ' rows' AS io, "
        f"CASE WHEN error_message <> '' THEN {ellipsized(error_line, 200)} END AS error, "
        f"CASE WHEN plan <> '' OR json_plan <> '' THEN ({bytes_cli('strlen(plan)')}) || ' text / ' || ({bytes_cli('strlen(json_plan)')}) || ' json' END AS plan_sizes "
        "FROM latest"
    )


_ACCEPTED = f"{_SENT}, got AS (SELECT *, CAST(i * 3 + v AS BIGINT) AS ingest_seq FROM sent WHERE status = 'accepted')"


def _got(*names: str) -> str:
    return _with(_ACCEPTED, f"SELECT ingest_seq, {_columns(list(names))} FROM got")


def oracle_sql() -> dict[str, str]:
    sql = {
        "event_source": _with(
            _SENT,
            "SELECT count(*) AS n_events, count(*) AS n_fitting, count(*) FILTER (WHERE i % 101 <> 7) AS n_documents FROM sent",
        ),
        "decode_event": _with(
            _SENT,
            f"SELECT CAST(i * 3 + v AS BIGINT) AS ingest_seq, CASE WHEN i % 103 = 5 AND i % 2 = 0 THEN '' ELSE {_FIELDS['query_id']} END AS query_id, "
            f"doc_text AS query_text, {_FIELDS['user_name']} AS user_name, nullif({_FIELDS['catalog']}, '') AS catalog, {_FIELDS['output_rows']} AS output_rows, "
            f"i % 3 AS n_inputs, nullif({_FIELDS['error_code']}, '') AS error_code, "
            f"CASE WHEN i % 103 = 5 AND i % 2 = 1 THEN NULL ELSE {_FIELDS['create_time']} END AS create_time "
            "FROM sent WHERE status <> 'malformed'",
        ),
        "scan_log": log(f"SELECT {_ALL} FROM log"),
        "scan_summary": log(f"SELECT {_SUMMARY} FROM log"),
        "scan_coalesced": log(
            "SELECT * REPLACE ('' AS environment, '' AS server_version, CAST(0 AS BIGINT) AS completed_splits, CAST(0 AS BIGINT) AS written_rows) "
            f"FROM (SELECT {_ALL} FROM log)"
        ),
        "scan_latest": log(f"SELECT {_ALL} FROM latest"),
        "list_partitions": log(
            f"SELECT DISTINCT strftime(create_date, '%Y%m%d') AS partition_id FROM log WHERE create_date < DATE '{G.CUTOFF:%Y-%m-%d}' ORDER BY 1"
        ),
        "append_log": log(f"SELECT {_SUMMARY}, {', '.join(VERSION_COLUMNS)} FROM log"),
        "create_log_table": log(f"SELECT {_SUMMARY}, create_date FROM log"),
        "partition_day": log(
            "SELECT query_id, ingest_seq, create_date AS create_day, strftime(create_time, '%Y%m%d') AS partition_id FROM log"
        ),
        "cluster_on_write": log(f"SELECT {_SHORT}, create_date FROM log"),
        "batch_fingerprint": _fingerprint(),
        "validate_events": _with(_SENT, "SELECT status, count(*) AS n FROM sent GROUP BY status"),
        "suppress_source": _with(
            _SENT,
            f"SELECT CAST(i * 3 + v AS BIGINT) AS ingest_seq, {_columns(['query_id', 'source'])} FROM sent WHERE status = 'suppressed'",
        ),
        "duration_ms": _duration(),
        "flatten_event": log(f"SELECT {_ALL}, ingest_seq FROM flattened"),
        "join_tags": _got("client_tags"),
        "join_resource_group": _got("resource_group"),
        "failure_fields": _got("error_code", "error_type", "error_message"),
        "inputs_to_json": _got("inputs_json"),
        "plan_policy": _policy(),
        "query_preview": "WITH d AS (SELECT doc_id, "
        + flat("text")
        + f" AS line FROM documents) SELECT doc_id, {byte_cut('line', '200')} AS preview_200, {byte_cut('line', '33')} AS preview_33 FROM d",
        "truncate_fields": _truncate_fields(),
        "ingest_row": log(
            "SELECT * REPLACE (" + ", ".join(f"{truncated(c, G.CAP_BYTES)} AS {c}" for c in STRING_COLUMNS) + f") FROM (SELECT {_ALL}, ingest_seq FROM log)"
        ),
        "one_line": f"SELECT doc_id, {flat('text')} AS line FROM documents",
        "ellipsize": "SELECT doc_id, "
        + ", ".join(f"{ellipsized('text', n)} AS at_{n}" for n in (0, 1, 20, 500))
        + " FROM documents",
        "filter_since": log(f"SELECT {_SUMMARY} FROM latest WHERE create_time >= {_ts(G.SINCE)}"),
        "filter_until": log(f"SELECT {_SUMMARY} FROM latest WHERE create_time < {_ts(G.UNTIL)}"),
        "filter_user": log(f"SELECT {_SUMMARY} FROM latest WHERE user_name = 'user_8'"),
        "filter_catalog": log(f"SELECT {_SUMMARY} FROM latest WHERE catalog = 'hive'"),
        "filter_state": log(f"SELECT {_SUMMARY} FROM latest WHERE query_state = 'CANCELED'"),
        "failed_only": log(f"SELECT {_SUMMARY} FROM latest WHERE {_IN_WINDOW} AND query_state = 'FAILED'"),
        "time_range": _range_counts(),
        "get_query": log(f"SELECT {_ALL} FROM latest WHERE query_id = (SELECT query_id FROM log WHERE i = 1 LIMIT 1)"),
        "query_id_day": _id_day(),
        "lookup_many": log("SELECT query_id, create_time, query_state, wall_ms, user_name FROM latest"),
        "sort_unknown_key": _page("start", False, 50),
        "offset_page": _page("cpu", True, 101, 300),
        "deep_page": _page("wall", True, 101, 2500),
        "limit_clamp": _limits(),
        "page_has_next": log(
            f"SELECT * FROM (SELECT *, (SELECT count(*) FROM latest WHERE {_IN_WINDOW}) > 300 AS has_next FROM ("
            f"SELECT {_SUMMARY}, row_number() OVER (ORDER BY {_order('bytes', True)}) AS position FROM latest WHERE {_IN_WINDOW})) "
            "WHERE position BETWEEN 201 AND 300"
        ),
        "top_by": log(
            f"SELECT {_SUMMARY} FROM latest WHERE catalog = 'iceberg' ORDER BY {_order('cpu', True)} LIMIT 500"
        ),
        "list_queries": log(
            f"SELECT {_SUMMARY} FROM latest WHERE create_time >= {_ts(G.FLAGSHIP.since)} AND create_time < {_ts(G.FLAGSHIP.until)} "
            f"AND query_state = 'FAILED' ORDER BY {_order('cpu', True)} LIMIT 101"
        ),
        "dedupe_batch": _versions("query_id"),
        "latest_version": _versions("create_time, query_id"),
        "skip_repeated_batch": log(f"SELECT {_SHORT} FROM log"),
        "api_list": _api_list(),
        "page_after": log(f"SELECT {_SUMMARY} FROM latest WHERE {_IN_WINDOW} ORDER BY {_order('rows', True)} LIMIT 200 OFFSET 200"),
        "explode_inputs": _with(_INPUTS, "SELECT * EXCLUDE (i) FROM input"),
        "input_columns": _with(
            _INPUTS,
            "SELECT query_id, create_time, input_no, n AS column_no, CASE n WHEN 1 THEN 'id' ELSE 'c' || (i % 7) END AS column_name, "
            "CASE WHEN n = 1 THEN 'bigint' WHEN i % 5 = 3 THEN '' ELSE 'varchar' END AS column_type FROM (SELECT *, unnest([CAST(1 AS BIGINT), 2]) AS n FROM input)",
        ),
        "qualified_input_name": _with(
            _INPUTS,
            "SELECT query_id, create_time, input_no, catalog_name || '.' || schema_name || '.' || table_name AS input_table FROM input",
        ),
        "query_detail": log(
            f"SELECT {_ALL}, i % 3 AS n_inputs, coalesce(array_to_string(list_transform(range(1, i % 3 + 1), lambda k: 't' || ((i + k) % 11)), ','), '') AS input_tables FROM latest"
        ),
        "detail_without_plans": log(
            f"SELECT {_ALL} FROM (SELECT * REPLACE ('' AS plan, '' AS json_plan) FROM latest)"
        ),
        "plan_hotspots": _with(_HOTSPOTS, "SELECT query_id, create_time, hotspot_rank, operator, cpu_pct, cpu, rows FROM ranked"),
        "plan_top_n": _with(
            _HOTSPOTS, "SELECT query_id, create_time, hotspot_rank, operator, cpu_pct, cpu, rows FROM ranked WHERE hotspot_rank <= 3"
        ),
        "plan_op_name": f"SELECT doc_id, {ellipsized('line', 60)} AS operator FROM (SELECT doc_id, {flat('text')} AS line FROM documents)",
        "parse_comma_int": _comma_int(),
        "hotspot_report": _with(
            _HOTSPOTS,
            f"SELECT query_id, create_time, hotspot_rank, printf('%.1f', cpu_pct) || '%' AS cpu_share, cpu, {count_shown('rows')} AS rows, operator "
            "FROM ranked WHERE hotspot_rank <= 10",
        ),
        "human_bytes_ui": _shown(G.BYTES_CASE, bytes_ui("n")),
        "human_bytes_cli": _shown(G.BYTES_CASE, bytes_cli("n")),
        "human_ms_ui": _shown(G.MS_CASE, ms_shown("n", 2)),
        "human_ms_cli": _shown(G.MS_CASE, ms_shown("n", 1)),
        "human_count": _shown(G.BYTES_CASE, count_shown("n")),
        "null_placeholder": _with(
            _INPUTS,
            f"SELECT query_id, create_time, input_no, coalesce({bytes_cli('physical_input_bytes')}, '-') AS bytes_cli, coalesce({count_shown('physical_input_rows')}, '-') AS rows_cli, "
            f"coalesce({bytes_ui('physical_input_bytes')}, '—') AS bytes_ui, coalesce({count_shown('physical_input_rows')}, '—') AS rows_ui FROM input",
        ),
        "format_time": log(
            f"SELECT query_id, ingest_seq, {time_shown('create_time')} AS created, {time_shown('end_time')} AS ended FROM log"
        ),
        "display_start": log(
            f"SELECT query_id, ingest_seq, {time_shown('coalesce(execution_start_time, create_time)')} AS start FROM log"
        ),
        "state_class": log(
            "SELECT query_id, ingest_seq, CASE WHEN query_state IN ('FINISHED', 'FAILED') THEN query_state ELSE 'other' END AS state_class FROM log"
        ),
        "list_report": log(
            f"SELECT query_id AS id, query_state AS state, query_type AS type, {ellipsized('user_name', 20)} AS user, {ms_shown('cpu_ms', 1)} AS cpu, "
            f"{ms_shown('wall_ms', 1)} AS wall, {count_shown('output_rows')} AS rows FROM latest"
        ),
        "dashboard_report": log(
            f"SELECT query_id, {time_shown('coalesce(execution_start_time, create_time)')} AS start, user_name AS user, query_state AS state, "
            "CASE WHEN query_state IN ('FINISHED', 'FAILED') THEN query_state ELSE 'other' END AS state_class, catalog, query_type AS type, "
            f"{ms_shown('wall_ms', 2)} AS wall, {ms_shown('cpu_ms', 2)} AS cpu, {bytes_ui('physical_input_bytes')} AS scanned, "
            f"{bytes_ui('peak_user_memory_bytes')} AS peak_mem, {count_shown('output_rows')} AS out_rows, query_preview AS query FROM latest"
        ),
        "detail_report": _detail(),
        "inputs_report": _with(
            _INPUTS,
            f"SELECT query_id, create_time, input_no, catalog_name || '.' || schema_name || '.' || table_name AS input_table, "
            f"coalesce({count_shown('physical_input_rows')}, '-') AS rows, coalesce({bytes_cli('physical_input_bytes')}, '-') AS bytes FROM input",
        ),
        "retention_cutoff": _upkeep("kept_at", lambda days: days),
        "retained_rows": log(f"SELECT {_SHORT} FROM log WHERE create_time >= {_ts(G.CUTOFF)}"),
        "prune": log(f"SELECT {_SHORT}, create_date FROM log WHERE create_date >= DATE '2024-01-19'"),
        "prune_exact": log(f"SELECT {_SHORT} FROM log WHERE create_time >= {_ts(G.CUTOFF)}"),
        "compaction_window": _upkeep("run_at", lambda days: max(days, 1) - 1),
        "compact": log(f"SELECT {_SHORT}, create_date FROM log"),
        "scan_resolved": log(f"SELECT {_SUMMARY} FROM latest"),
        "compact_and_resolve": log(f"SELECT {_SHORT}, create_date FROM latest"),
        "stream_ingest": log(f"SELECT {_SUMMARY} FROM latest"),
        "stream_small_batches": _plain_current(),
        "stream_one_batch": _plain_current(),
        "flush_batches": _plain_current(),
        "late_data": log("SELECT create_date, count(*) AS n, CAST(sum(wall_ms) AS BIGINT) AS wall_ms FROM latest GROUP BY create_date"),
        "flush_counters": _with(_SENT, _FLUSHED),
        "ledger_counters": _with(_SENT, f"{_FLUSHED} UNION ALL SELECT 'batches_failed', 0"),
        "flush_by_events": log(f"SELECT {', '.join(G._CURRENT)} FROM latest"),
        "flush_sizes": _with(
            _SENT,
            "SELECT k AS number, least(third, total - k * third) AS n_events FROM "
            "(SELECT count(*) AS total, (count(*) + 2) // 3 AS third FROM sent), range(0, 3) r(k) WHERE k * third < total",
        ),
        "stored_rejects": _with(
            _SENT, "SELECT status, v AS number, count(*) AS n FROM sent WHERE status IN ('malformed', 'invalid') GROUP BY status, v"
        ),
        "stream_drain": _with(_SENT, _COUNTERS),
        "ingest_counters": _with(_SENT, _COUNTERS),
        "quarantine": _with(
            _SENT,
            "SELECT status, count(*) AS n, count(*) FILTER (WHERE i % 101 = 7) AS n_broken FROM sent "
            "WHERE status IN ('malformed', 'invalid') GROUP BY status",
        ),
    }
    for key in L.SORT_COLUMNS:
        sql[f"sort_{key}"] = _page(key, key not in ("start", "rows"), 1000)
    for key in ("wall", "cpu", "bytes", "mem"):
        sql[f"top_{key}"] = log(
            f"SELECT {_SUMMARY} FROM latest WHERE query_state = 'FINISHED' ORDER BY {_order(key, True)} LIMIT 100"
        )
    return sql


_COUNTERS = (
    "SELECT 'events_received' AS counter, count(*) AS n FROM sent UNION ALL "
    "SELECT 'events_invalid', count(*) FROM sent WHERE status IN ('malformed', 'invalid') UNION ALL "
    "SELECT 'events_suppressed', count(*) FROM sent WHERE status = 'suppressed' UNION ALL "
    "SELECT 'rows_enqueued', count(*) FROM sent WHERE status = 'accepted'"
)
