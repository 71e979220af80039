"""Which attempt, if any, is accepted for each function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thriftline import fixed_values as fixed
from thriftline.functions import numbers as nm

STRICT = "strict"
COMPAT = "compat"


def baseline_usable(passed: Column, kg: Column) -> Column:
    """Tests passed and the measurement is not zero."""
    return F.coalesce(passed, F.lit(False)) & (F.coalesce(kg, F.lit(0.0)) != 0.0)


def gate_baselines(baselines: DataFrame) -> DataFrame:
    """Add ``skip_reason`` to failed baselines and report them as 0.0."""
    usable = baseline_usable(F.col("baseline_passed"), F.col("baseline_kg"))
    return baselines.withColumns(
        {
            "skip_reason": F.when(~usable, fixed.SKIP_BASELINE),
            "baseline_emissions_kg": F.when(usable, F.col("baseline_kg")).otherwise(F.lit(0.0)),
        }
    )


def is_timeout(elapsed_s: Column, limit: float = fixed.TIMEOUT_SECONDS) -> Column:
    return F.coalesce(elapsed_s > limit, F.lit(False))


def failure_reason(elapsed_s: Column | None, error: Column | None) -> Column:
    """``timeout`` or ``error: ...`` for a function whose run did not end well, else NULL."""
    reason = F.lit(None).cast("string")
    if error is not None:
        reason = F.when(error.isNotNull(), F.concat(F.lit(fixed.ERROR_PREFIX), error))
    if elapsed_s is not None:
        reason = F.when(is_timeout(elapsed_s), fixed.SKIP_TIMEOUT).otherwise(reason)
    return reason


def attempt_facts(max_attempts: int = fixed.MAX_ATTEMPTS, mode: str = STRICT) -> list[Column]:
    """The aggregates ``passed_k``, ``kg_k`` and ``last_attempt``; numbers outside of 1 to ``max_attempts`` do not count."""
    if mode not in (STRICT, COMPAT):
        raise ValueError(f"unknown mode: {mode}")
    kg = F.coalesce("emissions_kg", F.lit(0.0)) if mode == COMPAT else F.col("emissions_kg")
    number = F.col("attempt")
    columns = []
    for k in range(1, max_attempts + 1):
        columns.append(F.bool_and(F.when(number == k, F.coalesce("test_passed", F.lit(False)))).alias(f"passed_{k}"))
        columns.append(F.min(F.when(number == k, kg)).alias(f"kg_{k}"))
    last = F.max(F.when((number >= 1) & (number <= max_attempts), number))
    return [*columns, last.cast("int").alias("last_attempt")]


def spread_attempts(
    attempts: DataFrame, keys: list[str], max_attempts: int = fixed.MAX_ATTEMPTS, mode: str = STRICT
) -> DataFrame:
    """One row per function with the attempts side by side: ``passed_k``, ``kg_k``, ``last_attempt``.

    ``attempts(keys, attempt, test_passed, emissions_kg)``; a NULL emission is a
    measurement that gave nothing.  ``compat`` scores it as 0.0, ``strict`` never
    accepts it.  Every output is a hash aggregate over numbers that combines
    before the shuffle, and rows delivered twice change nothing, so the same
    expression serves batches, streams and keys of any size.
    """
    number = F.col("attempt")
    counted = attempts.filter((number >= 1) & (number <= max_attempts))
    return counted.groupBy(*keys).agg(*attempt_facts(max_attempts, mode))


def decide(df: DataFrame, max_attempts: int = fixed.MAX_ATTEMPTS) -> DataFrame:
    """Outcome columns from a usable baseline and the attempts side by side.

    Expects ``baseline_emissions_kg``, ``skip_reason`` and the columns of
    :func:`spread_attempts`; the first attempt that passes and emits less wins.
    """
    baseline = F.col("baseline_emissions_kg")
    open_ = F.col("skip_reason").isNull()
    number: Column = F.lit(None).cast("int")
    kg: Column = F.lit(None).cast("double")
    for k in range(max_attempts, 0, -1):
        wins = F.coalesce(open_ & F.col(f"passed_{k}") & nm.is_less(F.col(f"kg_{k}"), baseline), F.lit(False))
        number = F.when(wins, F.lit(k)).otherwise(number)
        kg = F.when(wins, F.col(f"kg_{k}")).otherwise(kg)
    spent = F.when(open_, F.coalesce(F.col("last_attempt"), F.lit(0))).otherwise(F.lit(0))
    helpers = [f"{name}_{k}" for name in ("passed", "kg") for k in range(1, max_attempts + 1)]
    decided = df.withColumns({"_won": number, "optimized_emissions_kg": kg})
    return decided.withColumns(
        {
            "success": F.col("_won").isNotNull(),
            "optimization_attempts": F.coalesce(F.col("_won"), spent),
            "reduction_pct": nm.reduction_pct(
                F.col("_won").isNotNull(), F.col("baseline_emissions_kg"), F.col("optimized_emissions_kg")
            ),
        }
    ).drop("_won", "last_attempt", *helpers)


def resolve(
    baselines: DataFrame,
    attempts: DataFrame,
    keys: list[str],
    max_attempts: int = fixed.MAX_ATTEMPTS,
    mode: str = STRICT,
) -> DataFrame:
    """Outcome of every function in ``baselines(keys, baseline_kg, baseline_passed, ...)``.

    Attempts are reduced to one row per function before they meet the baselines;
    both sides then share the partitioning by ``keys``.
    """
    side_by_side = spread_attempts(attempts, keys, max_attempts, mode)
    return decide(gate_baselines(baselines).join(side_by_side, keys, "left"), max_attempts)


def outcome_label() -> Column:
    """Class of an outcome row, for counting."""
    return (
        F.when(F.col("skip_reason").isNotNull(), F.col("skip_reason"))
        .when(F.col("success"), F.concat(F.lit("win at "), F.col("optimization_attempts").cast("string")))
        .when(F.col("optimization_attempts") == 0, "no attempts")
        .otherwise("no improvement")
    )


def with_retry_reasons(
    attempts: DataFrame,
    baselines: DataFrame,
    keys: list[str],
    max_attempts: int = fixed.MAX_ATTEMPTS,
    mode: str = STRICT,
) -> DataFrame:
    """Attempts with the reason the one before was refused, NULL for the first.

    An unreadable measurement is refused as such in ``strict`` and scored as 0.0 in ``compat``,
    as :func:`resolve` does.

    ``attempts`` holds one row per function and number; with numbers capped at
    ``max_attempts`` a window group is at most that long.
    """
    counted = attempts.filter((F.col("attempt") >= 1) & (F.col("attempt") <= max_attempts))
    usable = gate_baselines(baselines).filter(F.col("skip_reason").isNull()).select(*keys, "baseline_kg")
    refused = nm.retry_reason(F.col("test_passed"), F.col("baseline_kg"), F.col("emissions_kg"), mode == COMPAT)
    in_order = Window.partitionBy(*keys).orderBy("attempt")
    judged = counted.join(usable, keys).withColumn("refused_because", refused)
    return judged.withColumn("retry_reason", F.lag("refused_because").over(in_order))


def with_winning_code(outcomes: DataFrame, codes: DataFrame, keys: list[str]) -> DataFrame:
    """Code of the winning attempt; the wide column is joined for winners only.

    ``codes(keys, attempt, code)``.  Other rows keep ``function_code``.
    """
    won = outcomes.filter(F.col("success")).select(*keys, F.col("optimization_attempts").alias("attempt"))
    winning = codes.join(won, [*keys, "attempt"]).select(*keys, F.col("code").alias("_code"))
    return outcomes.join(winning, keys, "left").withColumn(
        "optimized_function_code", F.when(F.col("success"), F.col("_code")).otherwise(F.col("function_code"))
    ).drop("_code")
