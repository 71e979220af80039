"""Numeric expressions: comparisons, rounding, formats and text to number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thriftline import fixed_values as fixed
from thriftline.functions.text import strip

_FLOAT = (
    r"(?i)\A[+-]?(?:inf|infinity|nan|"
    r"(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+(?:_\d+)*)?)\z"
)
UNREADABLE = "emissions could not be read"
_INT = r"\A[+-]?\d+(?:_\d+)*\z"


def to_float(text: Column) -> Column:
    """Text to double, NULL when it is not a number.

    The pattern keeps out what a JVM cast would also take (``1.0f``, ``0x1p3``)
    and lets digit separators in.
    """
    bare = strip(text)
    return F.when(F.rlike(bare, F.lit(_FLOAT)), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double"))


def to_int(text: Column) -> Column:
    bare = strip(text)
    return F.when(F.rlike(bare, F.lit(_INT)), F.replace(bare, F.lit("_"), F.lit("")).try_cast("bigint"))


def after_prefix(line: Column, prefix: str) -> Column:
    """Rest of a line that starts with ``prefix``, else NULL."""
    return F.when(F.startswith(line, F.lit(prefix)), F.substring(line, len(prefix) + 1, 2147483647))


def is_less(left: Column, right: Column) -> Column:
    """``left < right`` with NaN never less and never more; Spark sorts NaN above all."""
    return ~F.isnan(left) & ~F.isnan(right) & (left < right)


def is_positive(value: Column) -> Column:
    return ~F.isnan(value) & (value > 0)


def reduction_pct(success: Column, baseline: Column, optimized: Column) -> Column:
    usable = F.coalesce(success, F.lit(False)) & optimized.isNotNull() & is_positive(baseline)
    return F.when(usable, (baseline - optimized) / baseline * 100).otherwise(F.lit(0.0))


def pct_worse(baseline: Column, measured: Column) -> Column:
    """How much worse than the baseline, 0.0 where the baseline cannot divide."""
    return F.when(is_positive(baseline), (measured - baseline) / baseline * 100).otherwise(F.lit(0.0))


def change_label(baseline: Column, measured: Column) -> Column:
    return F.when(is_less(measured, baseline), "better").otherwise("worse")


def saved_kg(baseline: Column, optimized: Column) -> Column:
    """NULL when either side is."""
    return baseline - optimized


def kg_to_g(kg: Column) -> Column:
    return kg * 1000


def kg_to_t(kg: Column) -> Column:
    return kg / 1000


def fixed_text(value: Column, decimals: int) -> Column:
    """Fixed-point text without separators, ties to even on the exact binary value."""
    return F.replace(F.format_number(value, decimals), F.lit(","), F.lit(""))


def round_even(value: Column, decimals: int) -> Column:
    """Round the exact binary value, ties to even: 2.675 gives 2.67 and 0.125 gives 0.12.

    ``F.round`` rounds the shortest decimal text half up instead.
    """
    # From 2 ** 53 on a double has no fraction to round.
    fractional = ~F.isnan(value) & (F.abs(value) < F.lit(2.0**53))
    return F.when(fractional, fixed_text(value, decimals).cast("double")).otherwise(value)


def magnitude(value: Column, decimals: int = 1) -> Column:
    """Short display form: millions as M, thousands as k."""
    return (
        F.when(value >= 1_000_000, F.concat(F.format_number(value / 1_000_000, decimals), F.lit("M")))
        .when(value >= 1_000, F.concat(F.format_number(value / 1_000, decimals), F.lit("k")))
        .otherwise(F.format_number(value, decimals))
    )


def retry_reason(test_passed: Column, baseline: Column, measured: Column, unreadable_as_zero: bool = False) -> Column:
    """Why an attempt is retried; NULL when it wins.

    A measurement that could not be read has a reason of its own, unless it is scored as 0.0.
    """
    spent = F.coalesce(measured, F.lit(0.0)) if unreadable_as_zero else measured
    worse = F.concat(fixed_text(pct_worse(baseline, spent), 1), F.lit(fixed.RETRY_EMISSIONS_SUFFIX))
    return (
        F.when(~F.coalesce(test_passed, F.lit(False)), fixed.RETRY_TESTS)
        .when(spent.isNull(), UNREADABLE)
        .when(~is_less(spent, baseline), worse)
    )


def _has_float(kind: T.DataType) -> bool:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_float(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_float(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_has_float(field.dataType) for field in kind.fields)
    return False


def finite_or_null(value: Column, kind: T.DataType) -> Column:
    """NaN and infinities become NULL at any depth of ``kind``."""
    if not _has_float(kind):
        return value
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        unusable = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
        return F.when(~unusable, value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: finite_or_null(item, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, item: finite_or_null(item, kind.valueType))
    fields = [finite_or_null(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
    return F.when(value.isNotNull(), F.struct(*fields))


def sanitize(df: DataFrame) -> DataFrame:
    """Apply :func:`finite_or_null` to every column of a table."""
    return df.select(*[finite_or_null(df[f.name], f.dataType).alias(f.name) for f in df.schema.fields])
