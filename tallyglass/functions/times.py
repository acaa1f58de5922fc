"""Durations, RFC 3339 instants, day keys."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyglass.functions.text import let

# Duration grammar and unit scales in nanoseconds.
_NUMBER = r"-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
_DURATION = rf"^[+-]?P(?:{_NUMBER}D)*(?:T(?:{_NUMBER}[DHMS]|T)*)?$"
_PLAIN_SECONDS = r"^PT[0-9]+(?:\.[0-9]*)?S$"
_COMPONENT = rf"({_NUMBER})([DHMS])"
_NANOS = {"D": 86_400e9, "H": 3_600e9, "M": 60e9, "S": 1e9}

_RFC3339 = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"


def utc(t: datetime) -> datetime:
    """The instant in UTC; a time without a zone is UTC already."""
    return t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)


def _whole(nanos: str) -> str:
    # Toward zero; out of range counts as zero.
    return f"coalesce(try_cast({nanos} AS BIGINT), 0L)"


def _iso_nanos(text: str) -> str:
    scales = " ".join(f"WHEN '{unit}' THEN {scale:.0f}D" for unit, scale in _NANOS.items())
    component = _whole(f"(try_cast(n AS DOUBLE) * CASE u {scales} END)")
    parts = [f"regexp_extract_all({text}, r'{_COMPONENT}', {group})" for group in (1, 2)]
    total = (
        f"aggregate(zip_with({parts[0]}, {parts[1]}, (n, u) -> {component}), 0L, "
        "(total, x) -> coalesce(try_add(total, x), 0L))"
    )
    seconds = f"try_cast(substring({text}, 3, length({text}) - 3) AS DOUBLE)"
    return (
        # Nearly every duration is plain seconds; the rest takes the general way.
        f"CASE WHEN {text} RLIKE r'{_PLAIN_SECONDS}' THEN {_whole(f'({seconds} * {_NANOS["S"]:.0f}D)')} "
        f"WHEN NOT ({text} RLIKE r'{_DURATION}') THEN 0L "
        f"WHEN startswith({text}, '-') THEN -{total} ELSE {total} END"
    )


def _millis(nanos: str) -> str:
    return f"coalesce(({nanos}) div 1000000L, 0L)"


def iso_duration_ms(column: str) -> Column:
    """ISO-8601 duration in milliseconds; anything else is 0.  Every component is scaled to
    nanoseconds in double arithmetic and cut to a whole number before the sum."""
    return F.expr(_millis(_iso_nanos(column)))


def duration_ms(column: str) -> Column:
    return F.expr(duration_ms_sql(column))


def duration_ms_sql(column: str) -> str:
    """Milliseconds of a VARIANT duration: a JSON string is an ISO-8601 duration, a JSON number
    is seconds, everything else is 0."""
    text = f"try_variant_get({column}, '$', 'string')"
    seconds = f"try_variant_get({column}, '$', 'double')"
    return _millis(
        f"CASE WHEN schema_of_variant({column}) = 'STRING' THEN {let(text, 's', _iso_nanos('s'))} "
        f"WHEN schema_of_variant({column}) RLIKE '^(BIGINT|DOUBLE|FLOAT|DECIMAL)' "
        f"THEN {_whole(f'({seconds} * 1e9D)')} ELSE 0L END"
    )


def rfc3339_sql(column: str) -> str:
    """Instant of a strict RFC 3339 text, NULL otherwise; digits past microseconds are cut."""
    return f"CASE WHEN {column} RLIKE r'{_RFC3339}' THEN try_to_timestamp({column}) END"


def rfc3339(column: str) -> Column:
    return F.expr(rfc3339_sql(column))


def bad_rfc3339_sql(column: str) -> str:
    """A time was given but is not RFC 3339."""
    return f"({column} IS NOT NULL AND ({rfc3339_sql(column)}) IS NULL)"


def partition_day(create_time: Column) -> Column:
    return F.to_date(create_time)


def partition_id(create_time: Column) -> Column:
    return F.date_format(create_time, "yyyyMMdd")


def query_id_day(query_id: Column) -> Column:
    """The day a query id starts with (strict yyyyMMdd), NULL for any other id."""
    head = F.substring(query_id, 1, 8)
    return F.to_date(
        F.when(query_id.rlike("^[0-9]{8}"), F.try_to_timestamp(head, F.lit("yyyyMMdd")))
    )
