import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from tallyglass.session import configure

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tallyglass-warehouse-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate an expression on a single-column frame ``c`` and return the values in order."""

    def run(values, kind, *expressions):
        rows = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}")
        out = rows.select("i", *[e.alias(f"e{n}") for n, e in enumerate(expressions)]).orderBy("i").collect()
        return [r[1] if len(expressions) == 1 else tuple(r[1:]) for r in out]

    return run
