"""CPU hotspots of textual query plans.

A plan is one bounded text cell, so each is parsed inside its own row: the text is cut into
sections at operator lines and every line with a CPU share takes the operator of its section.  No
row needs another one, hence no shuffle, and a user with a third of all plans costs no more than
any other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.display import human_count, parse_comma_int_sql, percent
from tallyglass.functions.text import ELLIPSIS, ellipsize, let, one_line, one_line_sql

# The line patterns of a textual plan.
_BLANK = r"[\t\f\r ]"
BRANCH_OPERATOR = r"[├└]─" + _BLANK + r"*([^\n]+)\z"
TOP_OPERATOR = r"^" + _BLANK + r"*([A-Z][A-Za-z]+\[[^\n]*)\z"
CPU_SHARE = r"CPU:" + _BLANK + r"*([0-9.]+" + _BLANK + r"*[a-zµ]+)" + _BLANK + r"*\(([0-9.]+)%\)"
OUTPUT_ROWS = r"Output:" + _BLANK + r"*([0-9,]+)" + _BLANK + r"+rows?"
OPERATOR_CHARS = 60
DEFAULT_TOP = 10

# An operator line opens a section: the newline before it is where the plan is cut.
_SECTION_START = r"\n(?=[^\n]*[├└]─[^\n]|" + _BLANK + r"*[A-Z][A-Za-z]+\[)"


def operator_name(text: Column) -> Column:
    return ellipsize(one_line(text), OPERATOR_CHARS)


def _operator_name_sql(text: str) -> str:
    kept = f"concat(substring(o, 1, {OPERATOR_CHARS - 1}), '{ELLIPSIS}')"
    return let(
        one_line_sql(text), "o", f"CASE WHEN char_length(o) <= {OPERATOR_CHARS} THEN o ELSE {kept} END"
    )


def _is_operator(line: str) -> str:
    return f"({line} RLIKE r'{BRANCH_OPERATOR}' OR {line} RLIKE r'{TOP_OPERATOR}')"


def _line_operator(line: str) -> str:
    """Label of an operator line; '' when the line is none (the opening lines of a plan)."""
    branch = _operator_name_sql(f"regexp_extract({line}, r'{BRANCH_OPERATOR}', 1)")
    top = _operator_name_sql(f"regexp_extract({line}, r'{TOP_OPERATOR}', 1)")
    return (
        f"CASE WHEN {line} RLIKE r'{BRANCH_OPERATOR}' THEN {branch} "
        f"WHEN {line} RLIKE r'{TOP_OPERATOR}' THEN {top} ELSE '' END"
    )


def _share(operator: str, line: str) -> str:
    rows = f"regexp_extract({line}, r'{OUTPUT_ROWS}', 1)"
    return (
        f"named_struct('operator', {operator}, "
        f"'cpu_pct', coalesce(try_cast(regexp_extract({line}, r'{CPU_SHARE}', 2) AS DOUBLE), 0D), "
        f"'cpu', {one_line_sql(f"regexp_extract({line}, r'{CPU_SHARE}', 1)")}, "
        f"'rows', {let(rows, 'r', parse_comma_int_sql('r'))})"
    )


def hotspot_array(plan: str, top: int = 0) -> Column:
    """Hotspots of one plan, largest share first, equal shares in text order; ``top=0`` is all."""
    # Only the first line of a section can be an operator line.
    is_share = f"contains(ln, 'CPU:') AND ln RLIKE r'{CPU_SHARE}' AND NOT (at = 0 AND {_is_operator('ln')})"
    labelled = let(_line_operator("lines[0]"), "op", f"transform(shares, ln -> {_share('op', 'ln')})")
    section = let(
        "split(section, '\\n')",
        "lines",
        let(
            f"filter(lines, (ln, at) -> {is_share})",
            "shares",
            # The label is worked out only for sections that carry a share.
            f"CASE WHEN size(shares) > 0 THEN {labelled} END",
        ),
    )
    sections = f"filter(split({plan}, r'{_SECTION_START}'), section -> contains(section, 'CPU:'))"
    in_text_order = f"flatten(filter(transform({sections}, section -> {section}), found -> found IS NOT NULL))"
    keyed = f"transform({in_text_order}, (h, n) -> named_struct('neg', -h.cpu_pct, 'n', n, 'hotspot', h))"
    ranked = f"transform(sort_array({keyed}), ranked -> ranked.hotspot)"
    return F.expr(f"slice({ranked}, 1, {top})" if top > 0 else ranked)


def plan_hotspots(rows: DataFrame, keep: list[str] = ["query_id", "create_time"], top: int = 0) -> DataFrame:
    """One row per hotspot with its rank in the plan."""
    with_plan = rows.where(F.col("plan").contains("CPU:"))
    exploded = with_plan.select(*keep, F.posexplode(hotspot_array("plan", top)).alias("n", "hotspot"))
    return exploded.select(
        *keep, (F.col("n") + 1).cast("bigint").alias("hotspot_rank"), "hotspot.*"
    )


def hotspot_report(rows: DataFrame, keep: list[str] = ["query_id", "create_time"], top: int = DEFAULT_TOP) -> DataFrame:
    return plan_hotspots(rows, keep, top).select(
        *keep,
        "hotspot_rank",
        percent(F.col("cpu_pct")).alias("cpu_share"),
        "cpu",
        human_count(F.col("rows")).alias("rows"),
        "operator",
    )
