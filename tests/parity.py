"""Compare registered queries with their DuckDB statements: ``python tests/parity.py SF [name …]``."""

from __future__ import annotations

import datetime
import glob
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(v)
    return str(v)[:10] if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime) else v


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values without the two engines' ways of writing NULL and dates."""
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            shown = df[c].astype("datetime64[us]").astype(str)
            dates = shown.str.len().max() == 10
            df[c] = [None if v == "NaT" else v[:10] if dates else v for v in shown]
        else:
            df[c] = pd.Series([_plain(v) for v in df[c]], index=df.index, dtype=object)
    keys = {c: df[c].map(lambda v: "" if v is None else str(v)) for c in df.columns}
    rank = pd.DataFrame(keys).sort_values(list(keys)).index
    return df.loc[rank].reset_index(drop=True)


def difference(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(duck_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(duck_df.columns)}"
    if len(spark_df) != len(duck_df):
        return f"rows {len(spark_df)} != {len(duck_df)}"
    a, b = canonical(spark_df), canonical(duck_df)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            at = (~same).idxmax()
            return f"{c}: {int((~same).sum())} differ, first {a[c][at]!r} != {b[c][at]!r}"
    return None


TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "timestamp": "TIMESTAMP",
    "date": "DATE", "boolean": "BOOLEAN", "int": "INTEGER",
}


def type_difference(spark_types: list[tuple[str, str]], relation) -> str | None:
    want = dict(zip(relation.columns, map(str, relation.types)))
    bad = {n: (t, want.get(n)) for n, t in spark_types if TYPES.get(t) != want.get(n)}
    return f"types {bad}" if bad else None


def main(sf: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PARITY_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    print("no oracle:", sorted(set(queries) - set(oracle)), "no query:", sorted(set(oracle) - set(queries)))
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            result = queries[name](spark, sf_dir)
            got = result.toPandas()
            took = time.time() - start
            start = time.time()
            relation = con.sql(oracle[name])
            problem = type_difference(result.dtypes, relation) or difference(got, relation.df())
            print(f"{'ok  ' if problem is None else 'DIFF'} {name} rows={len(got)} spark={took:.2f}s duck={time.time() - start:.2f}s {problem or ''}", flush=True)
        except Exception as e:  # noqa: BLE001
            problem = str(e)
            print(f"FAIL {name} {str(e)[:600]}", flush=True)
        failed += problem is not None
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
