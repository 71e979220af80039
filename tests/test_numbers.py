from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from thriftline.functions import numbers as nm

NAN, INF = float("nan"), float("inf")


def python_float(text):
    try:
        return float(text)
    except ValueError:
        return None


def python_int(text):
    try:
        return int(text)
    except ValueError:
        return None


NUMBERS = [
    "1", " 1e-9 ", "nan", "NaN", "-inf", "Infinity", "1_0", "1__0", "_1", "1_", "5.0", "5.", ".5", ".", "", "1.0f", "1d",
    "0x10", "0x1p3", "+7", "--7", "1e", "1e5", "1E+05", "1e1_0", "abc", "1 2", "\t3\n", "1,000", "1_0.5_0", "infinit",
]


def same(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


def test_to_float_takes_what_python_takes(column):
    got = column([(n,) for n in NUMBERS], "t string", nm.to_float(F.col("t")))
    assert [(n, g) for n, g in zip(NUMBERS, got) if not same(g, python_float(n))] == []


def test_to_int_takes_what_python_takes(column):
    got = column([(n,) for n in NUMBERS], "t string", nm.to_int(F.col("t")))
    assert got == [python_int(n) for n in NUMBERS]


def test_round_even_rounds_like_python(column):
    values = [2.675, 0.125, 0.375, 1.005, -2.5, 2.5, 3.5, 1e15 + 0.3, -0.001, 0.0, 33.333333, 99.995, 1234567.125]
    for decimals in (0, 1, 2):
        got = column([(v,) for v in values], "v double", nm.round_even(F.col("v"), decimals))
        assert got == [round(v, decimals) for v in values]
    odd = column([(NAN,), (INF,), (None,)], "v double", nm.round_even(F.col("v"), 2))
    assert math.isnan(odd[0]) and odd[1] == INF and odd[2] is None


def python_magnitude(n, d):
    if n >= 1_000_000:
        return f"{n / 1e6:,.{d}f}M"
    return f"{n / 1e3:,.{d}f}k" if n >= 1000 else f"{n:,.{d}f}"


def test_magnitude(column):
    values = [999.0, 1000.0, 999_999.96, 1_000_000.0, 0.25, -5.0, -12345.678, 0.05, 2.5, 1.25e12]
    for decimals in (0, 1):
        got = column([(v,) for v in values], "v double", nm.magnitude(F.col("v"), decimals))
        assert got == [python_magnitude(v, decimals) for v in values]


def test_is_less_is_false_for_nan(column):
    rows = [(1.0, 2.0), (2.0, 1.0), (1.0, 1.0), (1.0, NAN), (NAN, 1.0), (NAN, NAN), (1.0, INF)]
    assert column(rows, "a double, b double", nm.is_less(F.col("a"), F.col("b"))) == [True, False, False, False, False, False, True]


def test_reduction_pct(column):
    rows = [(True, 4.0, 1.0), (False, 4.0, 1.0), (True, 0.0, 1.0), (True, 4.0, None), (None, 4.0, 1.0), (True, -1.0, -2.0), (True, None, 1.0)]
    got = column(rows, "s boolean, b double, o double", nm.reduction_pct(F.col("s"), F.col("b"), F.col("o")))
    assert got == [75.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_retry_reason(column):
    rows = [(False, 2.0, 1.0), (True, 2.0, 1.0), (True, 2.0, 3.0), (True, 2.0, 2.0), (True, 8.0, 9000.0), (True, 2.0, NAN)]
    got = column(rows, "p boolean, b double, e double", nm.retry_reason(F.col("p"), F.col("b"), F.col("e")))
    assert got[:5] == [
        "test suite failed", None, "50.0% worse emissions than baseline", "0.0% worse emissions than baseline",
        "112400.0% worse emissions than baseline",
    ]


def test_unreadable_measurements_have_a_reason(column):
    rows = [(True, 2.0, None), (False, 2.0, None), (None, 2.0, 1.0)]
    strict = column(rows, "p boolean, b double, e double", nm.retry_reason(F.col("p"), F.col("b"), F.col("e")))
    assert strict == ["emissions could not be read", "test suite failed", "test suite failed"]
    compat = column(rows, "p boolean, b double, e double", nm.retry_reason(F.col("p"), F.col("b"), F.col("e"), True))
    assert compat == [None, "test suite failed", "test suite failed"]


def test_sanitize_reaches_every_depth(spark):
    schema = T.StructType(
        [
            T.StructField("a", T.DoubleType()),
            T.StructField("b", T.ArrayType(T.StructType([T.StructField("c", T.DoubleType()), T.StructField("d", T.StringType())]))),
            T.StructField("e", T.MapType(T.StringType(), T.FloatType())),
            T.StructField("f", T.StructType([T.StructField("g", T.ArrayType(T.DoubleType()))])),
            T.StructField("h", T.IntegerType()),
        ]
    )
    rows = [
        (NAN, [(INF, "x"), (1.0, None)], {"k": -INF, "m": 2.0}, ([NAN, 3.0],), 1),
        (1.5, None, None, None, None),
    ]
    first, second = nm.sanitize(spark.createDataFrame(rows, schema)).collect()
    assert first.asDict(recursive=True) == {
        "a": None, "b": [{"c": None, "d": "x"}, {"c": 1.0, "d": None}], "e": {"k": None, "m": 2.0}, "f": {"g": [None, 3.0]}, "h": 1,
    }
    assert second.asDict(recursive=True) == {"a": 1.5, "b": None, "e": None, "f": None, "h": None}
    assert nm.sanitize(spark.createDataFrame(rows, schema)).schema.simpleString() == schema.simpleString()
