"""Whitespace, byte-bounded and character-bounded text expressions.

Builders of long expressions take the SQL name of their column and give one parsed expression:
assembling them call by call would cost seconds per micro-batch in the driver."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# With (?U), \s is the Unicode White_Space property; a hand-written class is three times slower.
WHITE_RUN = r"(?U)\s+"
ELLIPSIS = "…"
_MARKER = "…[truncated "
_MARKER_END = " bytes]"


def let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` standing for ``value``, worked out once.  Keeps long
    expressions out of generated code, which has a size limit."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def one_line_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, r'{WHITE_RUN}', ' '))"


def one_line(text: Column) -> Column:
    """Collapse every whitespace run to one blank and drop it at both ends."""
    return F.trim(F.regexp_replace(text, WHITE_RUN, " "))


def _prefix(text: str, n: str) -> str:
    """The longest valid prefix of at most n bytes, of a text longer than that: a character has at most four."""
    tries = ", ".join(f"try_validate_utf8(CAST(substring(CAST({text} AS BINARY), 1, {n} - {k}) AS STRING))" for k in range(4))
    return f"coalesce({tries})"


def _byte_prefix(text: str, n: int) -> str:
    return f"CASE WHEN octet_length({text}) <= {n} THEN {text} ELSE {_prefix(text, str(n))} END"


def byte_prefix(column: str, n: int) -> Column:
    """Longest prefix of at most n bytes that is still valid UTF-8."""
    return F.expr(_byte_prefix(column, n))


def query_preview_steps(column: str, n_bytes: int) -> dict[str, str]:
    """The preview of a statement as SQL in steps: its flattened beginning, all of it if need be, and the cut.

    A long statement is not flattened whole: if more than the wanted bytes are left of its beginning, what follows
    cannot change them."""
    reach = 4 * n_bytes + 64
    return {
        "_start": f"ltrim(regexp_replace(substring({column}, 1, {reach}), r'{WHITE_RUN}', ' '))",
        "_flat": f"CASE WHEN octet_length(_start) > {n_bytes} THEN _start WHEN char_length({column}) <= {reach} "
        f"THEN rtrim(_start) ELSE {one_line_sql(column)} END",
        "query_preview": _byte_prefix("_flat", n_bytes),
    }


def query_preview(column: str, n_bytes: int = 200) -> Column:
    """The same as one expression."""
    if n_bytes <= 0:
        return F.expr(one_line_sql(column))
    start, flat, cut = query_preview_steps(column, n_bytes).items()
    return F.expr(let(start[1], start[0], let(flat[1], flat[0], cut[1])))


def truncate_bytes(column: str, limit: int) -> Column:
    """Cap a text at ``limit`` bytes; a marker naming the removed bytes replaces the tail where it
    fits, else the result is a bare prefix.  ``limit <= 0`` empties longer texts."""
    cut = _cut_and_mark(column, limit) if limit > 0 else "''"
    return F.expr(f"CASE WHEN octet_length({column}) <= {limit} THEN {column} ELSE {cut} END")


def _cut_and_mark(text: str, limit: int) -> str:
    # The marker is sized with the full length, whose digits bound those of the count.
    fixed = len(f"\n{_MARKER}{_MARKER_END}".encode())
    room = f"({limit - fixed} - length(CAST(octet_length({text}) AS STRING)))"
    kept = _prefix(text, room)
    marked = f"concat({kept}, '\\n{_MARKER}', CAST(octet_length({text}) - octet_length({kept}) AS STRING), '{_MARKER_END}')"
    return f"CASE WHEN {room} <= 0 THEN {_prefix(text, str(limit))} ELSE {marked} END"


def ellipsize(text: Column, n: int) -> Column:
    """At most n characters, the last one an ellipsis when something was cut."""
    if n <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    if n == 1:
        return F.substring(text, 1, 1)
    return F.when(F.char_length(text) <= n, text).otherwise(
        F.concat(F.substring(text, 1, n - 1), F.lit(ELLIPSIS))
    )
