"""Order-free content fingerprints of row batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.schema import LOG_COLUMNS, LOG_SCHEMA

_WORDS = 8


def _shown(name: str) -> str:
    kind = LOG_SCHEMA[name].dataType.simpleString()
    return f"CAST(unix_micros({name}) AS STRING)" if kind == "timestamp" else f"CAST({name} AS STRING)"


def row_hash(columns: list[str] = LOG_COLUMNS) -> Column:
    """Hash of all values behind a list of their lengths in bytes: no two rows share a text, and a NULL (no
    length) differs from every value."""
    texts = [_shown(c) for c in columns]
    lengths = ", ".join(f"coalesce(CAST(octet_length({t}) AS STRING), '')" for t in texts)
    values = ", ".join(f"coalesce({t}, '')" for t in texts)
    return F.expr(f"sha2(concat(concat_ws(' ', {lengths}), '\n', {values}), 256)")


def word_sums(hashed: str) -> dict[str, str]:
    """Aggregates that sum the eight 32-bit words of a hex digest, by name."""
    return {
        f"_w{w}": f"sum(CAST(conv(substring({hashed}, {8 * w + 1}, 8), 16, 10) AS DECIMAL(10,0)))" for w in range(_WORDS)
    }


def sealed(n_rows: str, sums: list[str]) -> Column:
    """The fingerprint of a batch, given the number of its rows and the sums of its words."""
    joined = ", ".join(f"coalesce(CAST({s} AS STRING), '')" for s in sums)
    return F.expr(f"sha2(concat_ws('|', CAST({n_rows} AS STRING), {joined}), 256)")


def batch_fingerprint(
    rows: DataFrame, by: list[str] | None = None, columns: list[str] = LOG_COLUMNS, hashed: Column | None = None
) -> DataFrame:
    """64 hex digits per batch.

    The eight 32-bit words of every row hash are summed and the sums hashed with the row count:
    order does not matter, a repeated row does, and the work is a plain partial aggregate, so a
    batch of any size never meets in one task."""
    marked = rows.select(*(by or []), (row_hash(columns) if hashed is None else hashed).alias("_hash"))
    grouped = marked.groupBy(*by) if by else marked.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("n_rows"), sealed("count(1)", list(word_sums("_hash").values())).alias("fingerprint")
    )


def line_fingerprint(lines: DataFrame) -> DataFrame:
    """The same for a batch of raw documents, before anything is decoded."""
    return batch_fingerprint(lines, hashed=F.expr("sha2(value, 256)"))
