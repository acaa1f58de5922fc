"""Filtered, sorted, paged lists of query summaries."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.functions.times import utc
from tallyglass.schema import PARTITION_COLUMN, ROW_KEY, SUMMARY_COLUMNS
from tallyglass.sources.querylog import scan_latest, shown

# List limits, paging bounds, named ranges and sort keys.
DEFAULT_LIMIT = 100
MAX_LIMIT = 5000
API_MAX_LIMIT = 500
API_MAX_OFFSET = 100_000
# Stored versions looked at for one page before all are merged instead.
MAX_CANDIDATES = 200_000
CLI_DEFAULT_LIMIT = 20
UI_PAGE_ROWS = 100
UI_MAX_PAGES = 50
DEFAULT_RANGE = "24h"
RANGES = {
    "1h": timedelta(hours=1),
    "6h": timedelta(hours=6),
    "24h": timedelta(hours=24),
    "7d": timedelta(days=7),
    "30d": timedelta(days=30),
}
SORT_COLUMNS = {
    "start": "create_time",
    "wall": "wall_ms",
    "cpu": "cpu_ms",
    "bytes": "physical_input_bytes",
    "mem": "peak_user_memory_bytes",
    "rows": "output_rows",
}

@dataclass(frozen=True)
class QueryFilter:
    since: datetime | None = None
    until: datetime | None = None
    user: str = ""
    catalog: str = ""
    state: str = ""
    sort: str = ""
    desc: bool = False
    limit: int = 0
    offset: int = 0
    # Continue behind a row: its sort value and its id.
    after: tuple | None = None


# --- filters -------------------------------------------------------------------------------


def filter_since(df: DataFrame, since: datetime | None) -> DataFrame:
    """Inclusive; the implied day bound prunes partitions, which a time bound alone cannot."""
    if since is None:
        return df
    if PARTITION_COLUMN in df.columns:
        df = df.where(F.col(PARTITION_COLUMN) >= F.lit(utc(since).date()))
    return df.where(F.col("create_time") >= F.lit(utc(since)))


def filter_until(df: DataFrame, until: datetime | None) -> DataFrame:
    """Exclusive."""
    if until is None:
        return df
    if PARTITION_COLUMN in df.columns:
        df = df.where(F.col(PARTITION_COLUMN) <= F.lit(utc(until).date()))
    return df.where(F.col("create_time") < F.lit(utc(until)))


def _filter_equal(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.col(column) == F.lit(value)) if value else df


def filter_user(df: DataFrame, user: str) -> DataFrame:
    return _filter_equal(df, "user_name", user.strip())


def filter_catalog(df: DataFrame, catalog: str) -> DataFrame:
    return _filter_equal(df, "catalog", catalog.strip())


def filter_state(df: DataFrame, state: str) -> DataFrame:
    """Any value is allowed and none is trimmed."""
    return _filter_equal(df, "query_state", state)


def toggle_failed_only(f: QueryFilter) -> QueryFilter:
    return replace(f, state="" if f.state == "FAILED" else "FAILED")


def range_bounds(name: str, now: datetime) -> tuple[datetime, datetime]:
    """(since, until) of a named range; an unknown name means the default."""
    return now - RANGES.get(name, RANGES[DEFAULT_RANGE]), now


def range_filter(name: str, now: datetime, **fields) -> QueryFilter:
    since, until = range_bounds(name, now)
    return QueryFilter(since=since, until=until, **fields)


# --- limits --------------------------------------------------------------------------------

def store_limit(n: int) -> int:
    """Out of bounds means the default, not the nearest bound."""
    return n if 0 < n <= MAX_LIMIT else DEFAULT_LIMIT


def cli_limit(n: int | None = None) -> int:
    return min(max(CLI_DEFAULT_LIMIT if n is None else n, 1), API_MAX_LIMIT)


def _int64(text: str) -> int | None:
    n = int(text) if re.fullmatch(r"[+-]?[0-9]+", text) else None
    return n if n is not None and -(2**63) <= n < 2**63 else None


def api_limit(text: str) -> int:
    n = _int64(text)
    return DEFAULT_LIMIT if n is None or n < 1 else min(n, API_MAX_LIMIT)


def api_offset(text: str) -> int:
    n = _int64(text)
    return 0 if n is None or n < 0 else min(n, API_MAX_OFFSET)


def ui_page(text: str) -> int:
    n = _int64(text)
    return 1 if n is None or n < 1 else min(n, UI_MAX_PAGES)


# --- order and pages -----------------------------------------------------------------------


def order_columns(sort: str, desc: bool) -> list[Column]:
    """Sort column, then ``query_id`` in the same direction; NULLs last either way."""
    names = [SORT_COLUMNS.get(sort, "create_time"), "query_id"]
    return [F.col(n).desc_nulls_last() if desc else F.col(n).asc_nulls_last() for n in names]


def take_page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset .. offset+limit`` of the order: one top-k at any depth.  Its cost grows with the offset; whoever
    pages deep continues behind a row instead (``QueryFilter.after``), at the cost of a first page."""
    page = df.orderBy(*order)
    return (page.offset(offset) if offset else page).limit(limit)


def rows_after(df: DataFrame, sort: str, desc: bool, value, query_id: str) -> DataFrame:
    """Rows behind (value, query_id) in the order of ``order_columns``; NULLs stand last either way."""
    column, ids = F.col(SORT_COLUMNS.get(sort, "create_time")), F.col("query_id")
    behind = ids < F.lit(query_id) if desc else ids > F.lit(query_id)
    if value is None:
        return df.where(column.isNull() & behind)
    beyond = column < F.lit(value) if desc else column > F.lit(value)
    return df.where(beyond | column.isNull() | ((column == F.lit(value)) & behind))


def with_position(page: DataFrame, order: list[Column], offset: int = 0) -> DataFrame:
    """Number the rows of one page (never more than a page, so one task is enough)."""
    return page.withColumn(
        "position", F.row_number().over(Window.orderBy(*order)).cast("bigint") + F.lit(offset)
    )


def _equal_filters(df: DataFrame, f: QueryFilter) -> DataFrame:
    return filter_state(filter_catalog(filter_user(df, f.user), f.catalog), f.state)


def _bounded(log: DataFrame, f: QueryFilter) -> DataFrame:
    return filter_until(filter_since(log, f.since), f.until)


def filtered_summaries(log: DataFrame, f: QueryFilter) -> DataFrame:
    """Current summaries that pass the filter.

    Time bounds are part of the version key and go below the merge.  User, catalog and state must hold for
    the current version, but some stored version has to pass them too: those are found first, by a filter that
    reaches the scan, and only the versions of their keys are merged."""
    bounded = _bounded(log, f)
    if f.user.strip() or f.catalog.strip() or f.state:
        keys = _equal_filters(bounded, f).select(*ROW_KEY).distinct()
        bounded = bounded.join(keys, ROW_KEY, "left_semi")
    return _equal_filters(scan_latest(bounded, SUMMARY_COLUMNS), f)


def _behind(df: DataFrame, f: QueryFilter) -> DataFrame:
    return df if f.after is None else rows_after(df, f.sort, f.desc, *f.after)


def _ahead(row: dict, other: dict, column: str, desc: bool) -> bool:
    """Whether a row stands before another in the order of ``order_columns``."""
    if (row[column] is None) != (other[column] is None):
        return other[column] is None
    mine, theirs = (row[column], row["query_id"]), (other[column], other["query_id"])
    if row[column] is None:
        mine, theirs = mine[1:], theirs[1:]
    return mine > theirs if desc else mine < theirs


def _last(rows: pa.Table) -> dict:
    return rows.slice(rows.num_rows - 1).to_pylist()[0]


def _versions_of(rows: DataFrame, keys: pa.Table) -> DataFrame:
    """Every stored version of a few keys, read from their days alone."""
    days = set(keys.column(PARTITION_COLUMN).to_pylist())
    if None not in days:
        rows = rows.where(F.col(PARTITION_COLUMN).isin(sorted(days)) if days else F.lit(False))
    wanted = rows.sparkSession.createDataFrame(keys).distinct()
    same = [rows[c].eqNullSafe(wanted[c]) for c in ROW_KEY]
    return rows.join(F.broadcast(wanted), same, "left_semi")


def candidate_page(log: DataFrame, f: QueryFilter, wanted: int, candidates: int | None = None) -> DataFrame | None:
    """The first ``wanted`` rows of a list, in order, without merging the versions of all others; None if too many
    candidates would be needed.  Runs its jobs when called.

    A current row is one of the stored ones, so none can stand before the best stored version of its key.  The first
    ``candidates`` stored versions are taken, the versions of their keys merged, and if the last row wanted stands before
    the last candidate, no key that was not seen can come in between.  Else, as where superseded versions crowd the
    front, eight times as many are taken.  The driver holds keys and rows of a page, no more."""
    spark, order = log.sparkSession, order_columns(f.sort, f.desc)
    column = SORT_COLUMNS.get(f.sort, "create_time")
    bounded = _bounded(log, f)
    stored = _behind(shown(_equal_filters(bounded, f), list(dict.fromkeys([column, "create_time", "query_id"]))), f)
    n = candidates or 2 * wanted + 64
    while n <= MAX_CANDIDATES:
        first = stored.orderBy(*order).limit(n).toArrow()
        merged = scan_latest(_versions_of(bounded, first.select(ROW_KEY)), SUMMARY_COLUMNS)
        page = _behind(_equal_filters(merged, f), f).select(*SUMMARY_COLUMNS).orderBy(*order).limit(wanted).toArrow()
        if first.num_rows < n or (page.num_rows == wanted and _ahead(_last(page), _last(first), column, f.desc)):
            return spark.createDataFrame(page)
        n *= 8
    return None


def list_queries(log: DataFrame, f: QueryFilter) -> DataFrame:
    """A page of the list.  Pages that start within the first few thousand rows are found by ``candidate_page``, at the
    cost of their own rows; deeper ones merge all versions the filter leaves."""
    order, limit = order_columns(f.sort, f.desc), store_limit(f.limit)
    if f.offset + limit <= MAX_LIMIT + UI_PAGE_ROWS * UI_MAX_PAGES:
        page = candidate_page(log, f, f.offset + limit)
        if page is not None:
            return take_page(page, order, limit, f.offset)
    rows = _behind(filtered_summaries(log, f), f).select(*SUMMARY_COLUMNS)
    return take_page(rows, order, limit, f.offset)


def list_page(log: DataFrame, f: QueryFilter, page_rows: int, last_page: bool = False) -> DataFrame:
    """One page with its positions and ``has_next``, found by fetching one row more."""
    if not 0 < page_rows < MAX_LIMIT:
        raise ValueError(f"a page has 1 to {MAX_LIMIT - 1} rows")
    order = order_columns(f.sort, f.desc)
    rows = list_queries(log, replace(f, limit=page_rows + 1))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fetched = with_position(rows, order, f.offset).withColumn(
        "has_next", F.lit(not last_page) & (F.count(F.lit(1)).over(everything) > page_rows)
    )
    return fetched.where(F.col("position") <= f.offset + page_rows)


def ui_list_page(log: DataFrame, f: QueryFilter, page: int) -> DataFrame:
    """A dashboard page; the last allowed page has no next."""
    page = min(max(page, 1), UI_MAX_PAGES)
    at = replace(f, offset=(page - 1) * UI_PAGE_ROWS)
    return list_page(log, at, UI_PAGE_ROWS, last_page=page >= UI_MAX_PAGES)


def top_by(log: DataFrame, key: str, f: QueryFilter = QueryFilter(), limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Heaviest queries of the current filter by wall, cpu, bytes or mem."""
    return list_queries(log, replace(f, sort=key, desc=True, limit=limit, offset=0))


def request_filter(params: dict[str, str], now: datetime) -> QueryFilter:
    """What a list request asks for: a named range up to ``now``, trimmed user and catalog, the state as it is;
    an unknown sort is by start, descending unless the direction is ``asc``."""
    sort = params.get("sort", "")
    return range_filter(
        params.get("range", ""),
        now,
        user=params.get("user", "").strip(),
        catalog=params.get("catalog", "").strip(),
        state=params.get("state", ""),
        sort=sort if sort in SORT_COLUMNS else "start",
        desc=params.get("dir") != "asc",
    )


def api_list(log: DataFrame, params: dict[str, str], now: datetime) -> DataFrame:
    """The page a list request gets, with positions and ``has_next``; limit and offset are texts, clamped."""
    f = replace(request_filter(params, now), offset=api_offset(params.get("offset", "")))
    return list_page(log, f, api_limit(params.get("limit", "")))
