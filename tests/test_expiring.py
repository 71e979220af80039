"""Streamed attempts whose state ends, against the batch rule."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from thriftline.operators import outcome
from thriftline.streaming import expiring

NAN = float("nan")
DAY = datetime.timedelta(days=1)
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
SCHEMA = "f string, attempt int, test_passed boolean, emissions_kg double, landed_at timestamp"
BATCHES, FUNCTIONS = 5, 30


def landed_rows(rng):
    """Batches a day apart; functions come back, deliveries repeat, some numbers do not count."""
    batches = []
    for day in range(BATCHES):
        rows = []
        for n in range(FUNCTIONS):
            who = f"f{rng.randrange(day * FUNCTIONS // 2, day * FUNCTIONS // 2 + FUNCTIONS)}"
            kg = rng.choice([None, NAN, 0.5, 1.5, 1e-12, rng.uniform(0, 3)])
            rows.append((who, rng.choice([None, 0, 1, 1, 2, 2, 3]), rng.choice([True, True, False, None]), kg, START + day * DAY))
        batches.append(rows + rows[:5])
    return batches


@pytest.fixture()
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("mode", [outcome.STRICT, outcome.COMPAT])
def test_state_ends_and_nothing_is_lost(spark, tmp_path, few_partitions, mode):
    batches = landed_rows(random.Random(11))
    landed, out, kept = (str(tmp_path / name) for name in ("landed", "out", "kept"))
    folded, held = None, []
    for day, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(landed)
        query = expiring.publish_expiring(
            spark.readStream.schema(SCHEMA).parquet(landed), ["f"], out, str(tmp_path / "progress"),
            ttl_ms=3_600_000, delay="0 seconds", mode=mode,
        )
        query.awaitTermination()
        held += [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
        if day in (1, 2):
            folded = expiring.fold(spark, out, kept, ["f"], folded)
    # The first batch holds its own functions; days later the store holds no more than one or two batches of them.
    assert max(held) <= 2 * max(held[:2]) and held[-1] <= max(held[:2])
    every = spark.createDataFrame([r for rows in batches for r in rows], SCHEMA)
    wanted = sorted(map(repr, outcome.spread_attempts(every, ["f"], mode=mode).collect()))
    assert sorted(map(repr, expiring.current(spark, out, ["f"], folded).collect())) == wanted
    assert sorted(map(repr, expiring.current(spark, out, ["f"]).collect())) == wanted
    assert folded[1] >= 2 and expiring.fold(spark, out, kept, ["f"], (folded[0], 10**6)) == (folded[0], 10**6)


def test_merged_facts_have_no_order(spark):
    schema = "f string, passed_1 boolean, kg_1 double, passed_2 boolean, kg_2 double, last_attempt int"
    rows = [("a", True, 2.0, None, None, 1), ("a", None, None, True, NAN, 2), ("a", False, 1.0, True, 3.0, 2), ("b", None, None, None, None, 1)]
    df = spark.createDataFrame(rows, schema)
    wanted = {"a": (False, 1.0, True, 3.0, 2), "b": (None, None, None, None, 1)}
    for given in (df, df.unionByName(df), df.orderBy(F.desc("last_attempt"))):
        assert {r.f: tuple(r)[1:] for r in expiring.merge(given, ["f"]).collect()} == wanted


def test_unknown_mode_is_refused(spark):
    with pytest.raises(ValueError):
        expiring.publish_expiring(spark.range(1), ["id"], "x", "y", mode="other")
