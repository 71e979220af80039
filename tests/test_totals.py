"""Exact sums against rational arithmetic."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from thriftline.operators import totals

NAN, INF = float("nan"), float("inf")


def rounded(values):
    """The exact sum as a double; Python rounds a fraction once."""
    total = sum(map(Fraction, values), Fraction(0))
    try:
        return float(total)
    except OverflowError:
        return INF if total > 0 else -INF


def any_double(rng):
    return rng.choice([-1, 1]) * math.ldexp(rng.getrandbits(53), rng.randint(-1126, 970))


@pytest.mark.parametrize("pieces", [1, 7])
def test_sums_equal_rational_sums(spark, pieces):
    rng = random.Random(4)
    groups = {
        "all": [any_double(rng) for _ in range(400)],
        "near": [rng.uniform(-1e-25, 1e25) for _ in range(200)] + [rng.uniform(-1e-25, 1e-25) for _ in range(200)],
        "cancel": [x for _ in range(100) for v in [any_double(rng)] for x in (v, -v)] + [5e-324, 2.0**-1022],
        "tie": [2.0**53, 1.0, 2.0**-60], "even": [2.0**53, 1.0], "tiny": [5e-324] * 3, "huge": [1.7e308, 1.7e308], "back": [1.7e308, 1.7e308, -1.7e308],
        "powers": [2.0**e for e in range(-1074, 1024, 3)], "below": [math.nextafter(2.0**e, 0) for e in range(-1000, 1000, 7)],
        "plain": [0.1, 0.2, 0.3] * 100, "zero": [0.0, -0.0],
    }
    rows = [(g, v) for g, values in groups.items() for v in values]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(pieces)
    got = {r.g: r.total for r in totals.exact_sums(df, ["g"], {"total": F.col("v")}).collect()}
    assert got == {g: rounded(values) for g, values in groups.items()}


def test_nulls_nan_infinities_and_nothing(spark):
    rows = [("a", None), ("b", 1.0), ("b", NAN), ("c", INF), ("c", 1e308), ("d", -INF), ("d", None), ("e", INF), ("e", -INF), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.total for r in totals.exact_sums(df, ["g"], {"total": F.col("v")}).collect()}
    assert math.isnan(got.pop("b")) and math.isnan(got.pop("e"))
    assert got == {"a": 0.0, "c": INF, "d": -INF, None: 2.0}
    assert totals.exact_sums(df.limit(0), ["g"], {"total": F.col("v")}).collect() == []
    whole = totals.exact_sums(df.limit(0), [], {"total": F.col("v")}, {"n": totals.counted(F.count("v"))}).collect()
    assert [(r.total, r.n) for r in whole] == [(0.0, 0)]


def test_sums_go_with_other_aggregates(spark):
    rng = random.Random(8)
    rows = [(i % 3, any_double(rng), rng.uniform(0, 1), i % 5 > 0) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c boolean")
    others = {
        "n": totals.counted(F.count(F.lit(1))), "high": totals.highest(F.col("b")), "low": totals.lowest(F.col("b")),
        "each": totals.every(F.col("c")), "any": totals.some(F.col("c")),
    }
    for r in totals.exact_sums(df, ["g"], {"a": F.col("a"), "b": F.col("b")}, others).collect():
        mine = [x for x in rows if x[0] == r.g]
        assert (r.a, r.b) == (rounded([x[1] for x in mine]), math.fsum(x[2] for x in mine))
        assert (r.n, r.high, r.low, r["each"], r["any"]) == (100, max(x[2] for x in mine), min(x[2] for x in mine), False, True)
