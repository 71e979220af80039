from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from thriftline import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("thriftline-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture()
def column(spark):
    """Evaluate one expression over rows of plain values."""

    def evaluate(rows, schema, expression):
        frame = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"_i int, {schema}")
        found = frame.select("_i", expression.alias("v")).collect()
        return [r["v"] for r in sorted(found, key=lambda r: r["_i"])]

    return evaluate
