"""Attempt resolution: pinned edges and a plain-Python model over random attempts."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from thriftline.operators import measuring, outcome

NAN = float("nan")
BASE = "f string, baseline_kg double, baseline_passed boolean"
TRY = "f string, attempt int, test_passed boolean, emissions_kg double"


def resolve(spark, bases, tries, mode=outcome.STRICT, max_attempts=2):
    rows = outcome.resolve(
        spark.createDataFrame(bases, BASE), spark.createDataFrame(tries, TRY), ["f"], max_attempts, mode
    ).collect()
    return {
        r.f: (r.success, r.optimization_attempts, r.baseline_emissions_kg, r.optimized_emissions_kg, r.skip_reason) for r in rows
    }


def test_edges(spark):
    bases = [
        ("zero", 0.0, True), ("failed", 5.0, False), ("nan_base", NAN, True), ("null_base", None, True),
        ("win1", 5.0, True), ("win2", 5.0, True), ("tests1", 5.0, True), ("equal", 5.0, True), ("third", 5.0, True),
        ("none", 5.0, True), ("nan_try", 5.0, True), ("null_passed", 5.0, None), ("one_bad", 5.0, True),
    ]
    tries = [
        ("zero", 1, True, 1.0), ("failed", 1, True, 1.0), ("nan_base", 1, True, 1.0), ("null_base", 1, True, 1.0),
        ("win1", 1, True, 1.0), ("win1", 2, True, 0.5), ("win2", 1, True, 9.0), ("win2", 2, True, 4.0),
        ("tests1", 1, False, 1.0), ("tests1", 2, True, 2.0), ("equal", 1, True, 5.0), ("equal", 2, True, 5.0),
        ("third", 1, True, 6.0), ("third", 2, False, 1.0), ("third", 3, True, 1.0), ("nan_try", 1, True, NAN),
        ("nan_try", 2, None, 1.0), ("null_passed", 1, True, 1.0), ("one_bad", 1, False, 1.0),
    ]
    got = resolve(spark, bases, tries)
    skip = "baseline_measurement_failed"
    assert got["zero"] == (False, 0, 0.0, None, skip)
    assert got["failed"] == (False, 0, 0.0, None, skip)
    assert got["null_base"] == (False, 0, 0.0, None, skip)
    assert got["null_passed"] == (False, 0, 0.0, None, skip)
    assert got["nan_base"][:2] == (False, 1) and math.isnan(got["nan_base"][2])
    assert got["win1"] == (True, 1, 5.0, 1.0, None)
    assert got["win2"] == (True, 2, 5.0, 4.0, None)
    assert got["tests1"] == (True, 2, 5.0, 2.0, None)
    assert got["equal"] == (False, 2, 5.0, None, None)
    assert got["third"] == (False, 2, 5.0, None, None)
    assert got["none"] == (False, 0, 5.0, None, None)
    assert got["nan_try"] == (False, 2, 5.0, None, None)
    assert got["one_bad"] == (False, 1, 5.0, None, None)
    assert resolve(spark, bases, tries, max_attempts=3)["third"] == (True, 3, 5.0, 1.0, None)


def test_unparsed_measurement_counts_in_compat_mode_only(spark):
    bases, tries = [("f", 5.0, True)], [("f", 1, True, None), ("f", 2, True, 4.0)]
    assert resolve(spark, bases, tries) == {"f": (True, 2, 5.0, 4.0, None)}
    assert resolve(spark, bases, tries, outcome.COMPAT) == {"f": (True, 1, 5.0, 0.0, None)}
    with pytest.raises(ValueError):
        resolve(spark, bases, tries, "loose")


def model(base, passed, tries, limit):
    """The rule as a walk over attempts."""
    if not passed or base == 0.0:
        return False, 0, 0.0, None, "baseline_measurement_failed"
    last = 0
    for k in range(1, limit + 1):
        if k not in tries:
            continue
        last = k
        ok, kg = tries[k]
        if ok and kg < base:
            return True, k, base, kg, None
    return False, last, base, None, None


def test_random_attempts_agree_with_the_model(spark):
    rng = random.Random(7)
    bases, tries, want = [], [], {}
    for n in range(600):
        base, passed = rng.choice([0.0, 1.0, 2.0, 3.0]), rng.random() < 0.9
        own = {k: (rng.random() < 0.7, rng.choice([0.0, 0.5, 1.0, 2.0, 4.0, NAN])) for k in (1, 2, 3) if rng.random() < 0.8}
        bases.append((f"f{n}", base, passed))
        # Attempts may be delivered more than once.
        tries += [(f"f{n}", k, *v) for k, v in own.items() for _ in range(rng.choice([1, 1, 2]))]
        want[f"f{n}"] = model(base, passed, own, 2)
    assert resolve(spark, bases, tries) == want


def test_retry_reasons(spark):
    bases = spark.createDataFrame([("a", 2.0, True), ("b", 2.0, True), ("c", 0.0, True)], BASE)
    tries = spark.createDataFrame(
        [("a", 1, False, 1.0), ("a", 2, True, 3.0), ("b", 1, True, 3.0), ("b", 2, True, 1.0), ("b", 3, True, 1.0), ("c", 1, True, 1.0)], TRY
    )
    got = {(r.f, r.attempt): r.retry_reason for r in outcome.with_retry_reasons(tries, bases, ["f"]).collect()}
    assert got == {("a", 1): None, ("a", 2): "test suite failed", ("b", 1): None, ("b", 2): "50.0% worse emissions than baseline"}


def test_failure_reasons(column):
    rows = [(17.0, None), (17.5, "x"), (1.0, "boom"), (None, None)]
    got = column(rows, "s double, e string", outcome.failure_reason(F.col("s"), F.col("e")))
    assert got == [None, "timeout", "error: boom", None]


def test_winning_code_is_joined_for_winners_only(spark):
    bases = spark.createDataFrame([("a", 2.0, True), ("b", 2.0, True)], BASE).withColumn("function_code", F.lit("old"))
    tries = spark.createDataFrame([("a", 1, False, 1.0), ("a", 2, True, 1.0), ("b", 1, True, 3.0)], TRY)
    codes = spark.createDataFrame([("a", 1, "a1"), ("a", 2, "a2"), ("b", 1, "b1")], "f string, attempt int, code string")
    coded = outcome.with_winning_code(outcome.resolve(bases, tries, ["f"]), codes, ["f"])
    assert {r.f: r.optimized_function_code for r in coded.collect()} == {"a": "a2", "b": "old"}


LOG = "f string, run int, seq bigint, line string"


def test_last_usable_value_wins(spark):
    logs = {
        1: ["EMISSIONS:1.5", "EMISSIONS:oops", "EXIT_CODE:0"],
        2: ["EMISSIONS:oops", "EMISSIONS: 1e-9 ", "EXIT_CODE:1", "EXIT_CODE:2.0"],
        3: ["EMISSIONS:nan", "EXIT_CODE: 0 "],
        4: ["EMISSIONS:2.0"],
        5: ["noise EMISSIONS:1.0", "EXIT_CODE:0"],
        6: ["EMISSIONS:3:4", "EMISSIONS:7", "EXIT_CODE:1", "EXIT_CODE:0"],
    }
    rows = [("f", run, n, line) for run, lines in logs.items() for n, line in enumerate(lines)]
    got = {r.run: r for r in measuring.parse_runs(spark.createDataFrame(rows, LOG), ["f", "run"]).collect()}
    assert (got[1].emissions_kg, got[1].exit_code, got[1].parsed) == (1.5, 0, True)
    assert (got[2].emissions_kg, got[2].exit_code, got[2].parsed) == (1e-9, 1, True)
    assert math.isnan(got[3].emissions_kg) and got[3].parsed
    assert (got[4].exit_code, got[4].parsed) == (None, False)
    assert (got[5].emissions_kg, got[5].parsed) == (None, False)
    assert (got[6].emissions_kg, got[6].exit_code) == (7.0, 0)
    first = {r.run: (r.emissions_kg, r.reason) for r in measuring.first_measurement(spark.createDataFrame(rows, LOG), ["f", "run"]).collect()}
    assert first[1] == (1.5, None) and first[2] == (None, "unreadable emissions value") and first[5] == (None, "no emissions line")


def test_one_unparsed_run_spoils_the_group(spark):
    runs = spark.createDataFrame(
        [("a", 1.0, 0, True), ("a", 3.0, 0, True), ("b", 1.0, 0, True), ("b", None, 0, False), ("c", 1.0, 1, True)],
        "f string, emissions_kg double, exit_code bigint, parsed boolean",
    )
    functions = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "f string")
    got = {r.f: (r.runs, r.baseline_kg, r.baseline_passed) for r in measuring.baselines(functions, runs, ["f"]).collect()}
    assert got == {"a": (2, 2.0, True), "b": (2, 0.0, False), "c": (1, 1.0, False), "d": (0, 0.0, False)}
