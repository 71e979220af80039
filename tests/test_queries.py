"""Every registered query against its SQL twin, and what its plan must not contain."""

from __future__ import annotations

import contextlib
import io
import math
import pathlib
import re

import duckdb
import pytest

import __spark_entry__ as entry
from thriftline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
RUNS, TWINS = registry.load()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return connection


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value)


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_query(spark, duck, name):
    df = RUNS[name](spark, SF)
    cursor = duck.execute(TWINS[name])
    assert ordered(df.columns, df.collect()) == ordered([d[0] for d in cursor.description], cursor.fetchall())
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", shown.getvalue())


def test_every_operator_has_a_query():
    wanted = {
        f"{letter}{n}"
        for letter, last in {"s": 11, "p": 15, "c": 18, "j": 8, "a": 12, "w": 6, "v": 3, "u": 5, "x": 14, "m": 6, "r": 1}.items()
        for n in range(1, last + 1)
    }
    assert wanted == {name.split("_")[0] for name in RUNS}
    assert set(TWINS) == set(RUNS)
    assert set(RUNS) <= set(entry.queries()) and set(TWINS) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 5 and "annual_co2_saved_kg" in df.columns


def test_library_keeps_work_distributed():
    """No driver-side rows, no machine-local checkpoints, no pairings of everything."""
    banned = re.compile(r"\.collect\(|toPandas\(|[cC]heckpoint\(|crossJoin|toLocalIterator|\.rdd\b|F\.udf|broadcast\(")
    root = pathlib.Path(entry.__file__).parent / "thriftline"
    sources = [p for p in root.rglob("*.py") if p.relative_to(root).parts[0] != "llm"]
    assert [str(p) for p in sources if banned.search(p.read_text(encoding="utf-8"))] == []
