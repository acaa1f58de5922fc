"""Report projections: the columns people read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions import display as D
from tallyglass.functions.text import ellipsize, one_line


def list_report(summaries: DataFrame, *carry: str) -> DataFrame:
    """Terminal list."""
    c = F.col
    return summaries.select(
        *carry,
        c("query_id").alias("id"),
        c("query_state").alias("state"),
        c("query_type").alias("type"),
        ellipsize(c("user_name"), 20).alias("user"),
        D.human_ms_cli(c("cpu_ms")).alias("cpu"),
        D.human_ms_cli(c("wall_ms")).alias("wall"),
        D.human_count(c("output_rows")).alias("rows"),
    )


def dashboard_report(summaries: DataFrame, *carry: str) -> DataFrame:
    """Dashboard list."""
    c = F.col
    return summaries.select(
        *carry,
        c("query_id"),
        D.display_start(c("execution_start_time"), c("create_time")).alias("start"),
        c("user_name").alias("user"),
        c("query_state").alias("state"),
        D.state_class(c("query_state")).alias("state_class"),
        c("catalog"),
        c("query_type").alias("type"),
        D.human_ms_ui(c("wall_ms")).alias("wall"),
        D.human_ms_ui(c("cpu_ms")).alias("cpu"),
        D.human_bytes_ui(c("physical_input_bytes")).alias("scanned"),
        D.human_bytes_ui(c("peak_user_memory_bytes")).alias("peak_mem"),
        D.human_count(c("output_rows")).alias("out_rows"),
        c("query_preview").alias("query"),
    )


def _bytes_of(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def detail_report(rows: DataFrame) -> DataFrame:
    """Terminal detail view, one row per query.  The plan line is NULL without plans and the error
    line NULL without a message."""
    c, ms, size, count = F.col, D.human_ms_cli, D.human_bytes_cli, D.human_count

    def line(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    return rows.select(
        "query_id",
        F.when(
            c("error_code") != "",
            line(c("query_state"), "  (", c("error_code"), " / ", c("error_type"), ")"),
        ).otherwise(c("query_state")).alias("state"),
        line(c("user_name"), "    Source ", c("source"), "    Type ", c("query_type")).alias("user"),
        line(
            "queued ", ms(c("queued_ms")), "  planning ", ms(c("planning_ms")),
            "  exec ", ms(c("execution_ms")), "  wall ", ms(c("wall_ms")),
        ).alias("timings"),
        line(ms(c("cpu_ms")), "    Peak mem ", size(c("peak_user_memory_bytes"))).alias("cpu"),
        line(
            "in ", size(c("physical_input_bytes")), " / ", count(c("physical_input_rows")),
            " rows    out ", count(c("output_rows")), " rows    written ",
            count(c("written_rows")), " rows",
        ).alias("io"),
        F.when(c("error_message") != "", ellipsize(one_line(c("error_message")), 200)).alias("error"),
        F.when(
            (c("plan") != "") | (c("json_plan") != ""),
            line(size(_bytes_of(c("plan"))), " text / ", size(_bytes_of(c("json_plan"))), " json"),
        ).alias("plan_sizes"),
    )


def inputs_report(inputs: DataFrame, keep: list[str] = ["query_id", "create_time", "input_no"]) -> DataFrame:
    """Input tables of a detail view, missing figures as a dash."""
    from tallyglass.operators.inputs import qualified_name

    c = F.col
    return inputs.select(
        *keep,
        qualified_name(c("catalog_name"), c("schema_name"), c("table_name")).alias("input_table"),
        D.or_placeholder(D.human_count(c("physical_input_rows"))).alias("rows"),
        D.or_placeholder(D.human_bytes_cli(c("physical_input_bytes"))).alias("bytes"),
    )
