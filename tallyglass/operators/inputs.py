"""Input tables and columns a query read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.operators.lookup import parse_inputs


def explode_inputs(rows: DataFrame, keep: list[str] = ["query_id", "create_time"]) -> DataFrame:
    """One row per input table; rows without inputs, or with broken ones, give none."""
    exploded = rows.select(*keep, F.posexplode(parse_inputs(F.col("inputs_json"))).alias("n", "input"))
    return exploded.select(
        *keep,
        (F.col("n") + 1).cast("bigint").alias("input_no"),
        F.col("input.catalogName").alias("catalog_name"),
        F.col("input.schema").alias("schema_name"),
        F.col("input.table").alias("table_name"),
        F.col("input.columns").alias("columns"),
        F.col("input.physicalInputBytes").alias("physical_input_bytes"),
        F.col("input.physicalInputRows").alias("physical_input_rows"),
    )


def input_columns(inputs: DataFrame, keep: list[str] = ["query_id", "create_time", "input_no"]) -> DataFrame:
    """One row per column read."""
    exploded = inputs.select(*keep, F.posexplode("columns").alias("n", "column"))
    return exploded.select(
        *keep,
        (F.col("n") + 1).cast("bigint").alias("column_no"),
        F.col("column.name").alias("column_name"),
        F.col("column.type").alias("column_type"),
    )


def qualified_name(catalog: Column, schema: Column, table: Column) -> Column:
    return F.concat_ws(".", *[F.coalesce(part, F.lit("")) for part in (catalog, schema, table)])
