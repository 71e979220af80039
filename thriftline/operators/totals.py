"""Sums of doubles that are exact until they are rounded once.

A double is a whole number of at most 53 bits times a power of two.  Cut at a grid of powers of ``2 ** 32`` it is
a window number and four digits of 24 bits, which add up as plain bigints.  Values are grouped by their windows together with
the group, so the sums combine before the shuffle and few rows cross it: amounts of one kind
lie in two or three windows, all doubles there are in under 70.  The windows of a group meet at the end, where
their digits become one whole number and that number one double, to the nearest, ties to even.

So a sum has no order, no scale and no smallest amount: 1e25, 1e-25 and -1e25 add up to 1e-25.  A window's digits may be
added 2 ** 39 times.  NaN and infinities are windows of their own and come out as IEEE addition gives them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DIGIT_BITS = 24
_DIGITS = 4
_WINDOW_BITS = 32
#: The lowest window, below the last bit of the smallest double.
_LOWEST = -37
_UP, _DOWN, _NAN = -1, -2, -3

#: How another aggregate of the rows is made in the first step and merged in the second.
Merged = tuple[Column, Callable[[Column], Column]]


def counted(count: Column) -> Merged:
    return count, lambda part: F.coalesce(F.sum(part), F.lit(0))


def highest(value: Column) -> Merged:
    return F.max(value), F.max


def lowest(value: Column) -> Merged:
    return F.min(value), F.min


def every(condition: Column) -> Merged:
    return F.bool_and(condition), F.bool_and


def some(condition: Column) -> Merged:
    return F.bool_or(condition), F.bool_or


def _window(value: Column) -> Column:
    """The window that holds all bits of a value; an estimate of the exponent that is one off does no harm."""
    exponent = F.floor(F.log2(F.abs(value)))
    window = F.floor((exponent - 54) / _WINDOW_BITS) - _LOWEST
    return (
        F.when(value.isNull(), F.lit(None))
        .when(F.isnan(value), _NAN)
        .when(value == float("inf"), _UP)
        .when(value == float("-inf"), _DOWN)
        .when(value == 0.0, 0)
        .otherwise(window)
        .cast("bigint")
    )


def _scaled(value: Column, window: Column) -> Column:
    """The value in units of its window: whole, below ``2 ** 88``.  Powers of two in two steps, as one might overflow."""
    bits = -(window + _LOWEST) * _WINDOW_BITS
    half = F.floor(bits / 2)
    by = lambda n: F.pow(F.lit(2.0), n.cast("double"))
    return F.when(window > 0, value * by(half) * by(bits - half)).otherwise(0.0)


def _sum_of(parts: np.ndarray) -> float:
    rows = parts.reshape(-1, _DIGITS + 1).tolist()
    odd = {row[0] for row in rows if row[0] < 0}
    if _NAN in odd or odd >= {_UP, _DOWN}:
        return float("nan")
    if odd:
        return float("inf") if _UP in odd else float("-inf")
    total = 0
    for window, *digits in rows:
        total += sum(d << _DIGIT_BITS * i for i, d in enumerate(digits)) << _WINDOW_BITS * window
    try:
        return total / (1 << -_LOWEST * _WINDOW_BITS)  # Python divides whole numbers with one rounding
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")


@F.arrow_udf(T.DoubleType())
def _joined(parts: pa.Array) -> pa.Array:
    # Arrow keeps NaN and NULL apart.
    return pa.array([_sum_of(part.values.to_numpy(zero_copy_only=False)) for part in parts], pa.float64())


def exact_sums(
    df: DataFrame, group: list[str], sums: dict[str, Column], others: dict[str, Merged] | None = None
) -> DataFrame:
    """A row for each group: the exact sum of each of ``sums`` (0.0 over nothing) and the ``others``.

    A group's last step has one entry for each combination of windows its rows have.
    """
    others = others or {}
    windows = {f"_w_{n}": _window(F.col(f"_v_{n}")) for n in sums}
    scaled = {f"_s_{n}": _scaled(F.col(f"_v_{n}"), F.col(f"_w_{n}")) for n in sums}
    given = df.withColumns({f"_v_{n}": value.cast("double") for n, value in sums.items()}).withColumns(windows).withColumns(scaled)
    parts = []
    for n in sums:
        left = F.abs(F.col(f"_s_{n}"))
        for i in reversed(range(_DIGITS)):
            unit = F.lit(2.0 ** (_DIGIT_BITS * i))
            digit = F.floor(left / unit)
            parts.append(F.sum(F.when(F.col(f"_s_{n}") < 0, -digit).otherwise(digit)).alias(f"_d{i}_{n}"))
            left = left - digit.cast("double") * unit
    first = [made.alias(f"_o_{n}") for n, (made, _) in others.items()]
    partly = given.groupBy(*group, *windows).agg(*parts, *first)

    def entries(n: str) -> Column:
        window = F.col(f"_w_{n}")
        entry = F.array(window, *[F.col(f"_d{i}_{n}") for i in range(_DIGITS)])
        return F.flatten(F.collect_list(F.when(window.isNotNull(), entry)))

    merged = [merge(F.col(f"_o_{n}")).alias(n) for n, (_, merge) in others.items()]
    whole = partly.groupBy(*group).agg(*merged, *[entries(n).alias(f"_e_{n}") for n in sums])
    return whole.select(*group, *others, *[_joined(f"_e_{n}").alias(n) for n in sums])
