"""Registered queries: each runs over whole given tables, most with a SQL twin."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thriftline.session import configure

Run = Callable[[SparkSession, str], DataFrame]

RUNS: dict[str, Run] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query under ``name`` with the SQL that has to give the same rows."""

    def register(run: Run) -> Run:
        if name in RUNS:
            raise ValueError(f"query registered twice: {name}")
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
    from thriftline.plans import catalogue_queries, intake_queries, savings_queries  # noqa: F401

    return {name: _configured(run) for name, run in RUNS.items()}, dict(TWINS)
