"""Human-readable sizes, times and counts in the two forms reports use:
``ui`` (dashboard) and ``cli`` (terminal)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_KIB = 1024


def _s(value: Column) -> Column:
    return value.cast("string")


def _fixed(x: Column, pattern: str) -> Column:
    # A pattern rounds half-even on the exact binary value; format_string does not.
    return F.call_function("format_number", x, F.lit(pattern))


def human_bytes_ui(n: Column) -> Column:
    """``512 B``, ``1.5 KiB`` … ``EiB``; the unit follows from whole division."""
    out = F.when(n <= 0, F.lit("0")).when(n < _KIB, F.concat(_s(n), F.lit(" B")))
    units = ["KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]
    for power, unit in enumerate(units, start=1):
        shown = F.concat(
            _fixed(n.cast("double") / F.lit(float(_KIB**power)), "0.0"), F.lit(f" {unit}")
        )
        if unit == units[-1]:
            return out.otherwise(F.when(n.isNotNull(), shown))
        out = out.when(n < F.lit(_KIB ** (power + 1)), shown)
    return out


def human_bytes_cli(n: Column) -> Column:
    """``512B``, ``1.5KiB`` … capped at ``PiB``; the unit follows from the rounded double."""
    x = n.cast("double")
    out = F.when(n <= 0, F.lit("0")).when(n < _KIB, F.concat(_s(n), F.lit("B")))
    units = ["KiB", "MiB", "GiB", "TiB", "PiB"]
    for power, unit in enumerate(units, start=1):
        shown = F.concat(_fixed(x / F.lit(float(_KIB**power)), "0.0"), F.lit(unit))
        if unit == units[-1]:
            return out.otherwise(F.when(n.isNotNull(), shown))
        out = out.when(x < F.lit(float(_KIB ** (power + 1))), shown)
    return out


def _human_ms(ms: Column, second_pattern: str) -> Column:
    def whole(per: int) -> Column:
        return F.call_function("div", ms, F.lit(per).cast("bigint"))

    return (
        F.when(ms <= 0, F.lit("0"))
        .when(ms < 1_000, F.concat(_s(ms), F.lit("ms")))
        .when(
            ms < 60_000,
            F.concat(_fixed(ms.cast("double") / F.lit(1000.0), second_pattern), F.lit("s")),
        )
        .when(
            ms < 3_600_000,
            F.concat(_s(whole(60_000)), F.lit("m"), _s(whole(1_000) % 60), F.lit("s")),
        )
        .when(
            ms.isNotNull(),
            F.concat(_s(whole(3_600_000)), F.lit("h"), _s(whole(60_000) % 60), F.lit("m")),
        )
    )


def human_ms_ui(ms: Column) -> Column:
    return _human_ms(ms, "0.00")


def human_ms_cli(ms: Column) -> Column:
    return _human_ms(ms, "0.0")


def human_count(n: Column) -> Column:
    return F.format_number(n, 0)


def or_placeholder(shown: Column, placeholder: str = "-") -> Column:
    """``-`` (terminal) or ``—`` (dashboard) where there is no value."""
    return F.coalesce(shown, F.lit(placeholder))


def format_time(t: Column) -> Column:
    return F.coalesce(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.lit("—"))


def display_start(execution_start: Column, create_time: Column) -> Column:
    return format_time(F.coalesce(execution_start, create_time))


def state_class(state: Column) -> Column:
    return F.when(state.isin("FINISHED", "FAILED"), state).otherwise("other")


def percent(pct: Column) -> Column:
    return F.concat(_fixed(pct, "0.0"), F.lit("%"))


def parse_comma_int_sql(text: str) -> str:
    """``1,346,579,962`` as a bigint; not a number is 0, past the range is the largest bigint."""
    digits = f"replace({text}, ',', '')"
    return (
        f"CASE WHEN {digits} RLIKE '^[0-9]+$' "
        f"THEN coalesce(try_cast({digits} AS BIGINT), {2**63 - 1}L) ELSE 0L END"
    )


def parse_comma_int(column: str) -> Column:
    return F.expr(parse_comma_int_sql(column))
