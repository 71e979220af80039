"""Queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thriftline.session import configure

Run = Callable[[SparkSession, str], DataFrame]

RUNS: dict[str, Run] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query under ``name``, with SQL that gives the same rows where SQL can express it."""

    def register(run: Run) -> Run:
        RUNS[name] = run
        if sql is not None:
            TWINS[name] = sql.strip()
        return run

    return register


def _configured(run: Run) -> Run:
    @functools.wraps(run)
    def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(configure(spark), sf_dir)

    return ready


def load() -> tuple[dict[str, Run], dict[str, str]]:
    import corpus_pipeline
    from thriftline.llm import queries  # noqa: F401

    runs = RUNS | {"pipeline": corpus_pipeline.run}
    twins = TWINS | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
    return {name: _configured(run) for name, run in runs.items()}, twins
