"""Measurement logs to runs, and runs to baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thriftline import fixed_values as fixed
from thriftline.functions import numbers as nm
from thriftline.functions import text as tx
from thriftline.operators import totals


def log_values(lines: DataFrame, text: str = "line") -> DataFrame:
    """Add what a log line says: ``emissions`` and ``exit_code``, NULL when it says nothing usable."""
    line = F.col(text)
    return lines.withColumns(
        {
            "emissions": nm.to_float(nm.after_prefix(line, fixed.EMISSIONS_PREFIX)),
            "exit_code": nm.to_int(nm.after_prefix(line, fixed.EXIT_CODE_PREFIX)),
        }
    )


def parse_runs(lines: DataFrame, keys: list[str], seq: str = "seq", text: str = "line") -> DataFrame:
    """One row per run: the last usable value of either kind wins.

    ``parsed`` is false when either is missing.  Values are narrowed to numbers
    before the shuffle; the text of the log stays behind.
    """
    values = log_values(lines, text).select(*keys, seq, "emissions", "exit_code")

    def last(name: str):
        return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), F.col(seq)))

    runs = values.groupBy(*keys).agg(last("emissions").alias("emissions_kg"), last("exit_code").alias("exit_code"))
    return runs.withColumn("parsed", F.col("emissions_kg").isNotNull() & F.col("exit_code").isNotNull())


def first_measurement(lines: DataFrame, keys: list[str], seq: str = "seq", text: str = "line") -> DataFrame:
    """Stricter reading: the first emissions line decides.

    ``reason`` says why a log has no value; a bad value is not skipped.
    """
    raw = nm.after_prefix(F.col(text), fixed.EMISSIONS_PREFIX)
    at = F.when(raw.isNotNull(), F.col(seq))
    narrow = lines.select(*keys, nm.to_float(raw).alias("_value"), at.alias("_at"))
    found = narrow.groupBy(*keys).agg(
        F.min("_at").alias("_first"), F.min_by("_value", "_at").alias("_first_value")
    )
    reason = F.when(F.col("_first").isNull(), "no emissions line").when(
        F.col("_first_value").isNull(), "unreadable emissions value"
    )
    return found.select(*keys, F.col("_first_value").alias("emissions_kg"), reason.alias("reason"))


def diagnose(lines_text: DataFrame, text: str) -> DataFrame:
    """Shortened log text for messages."""
    return lines_text.withColumn("diagnostic", tx.truncate(F.col(text), fixed.DIAGNOSTIC_CHARS))


def average_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean emissions and whether all runs passed.

    One unparsed run spoils its group: ``(0.0, false)``.
    """
    parsed = F.coalesce(F.col("parsed"), F.lit(False))
    found = totals.exact_sums(
        runs,
        keys,
        {"_kg": F.col("emissions_kg")},
        {
            "runs": totals.counted(F.count(F.lit(1))),
            "_spoiled": totals.some(~parsed),
            "passed": totals.every(parsed & F.coalesce(F.col("exit_code") == 0, F.lit(False))),
        },
    )
    mean = F.when(F.col("_spoiled"), F.lit(0.0)).otherwise(F.col("_kg") / F.col("runs"))
    return found.select(*keys, "runs", mean.alias("emissions_kg"), "passed")


def baselines(functions: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Baseline per function; no runs at all counts as a spoiled measurement."""
    measured = average_runs(runs, keys)
    return functions.join(measured, keys, "left").select(
        *functions.columns,
        F.coalesce("runs", F.lit(0)).alias("runs"),
        F.coalesce("emissions_kg", F.lit(0.0)).alias("baseline_kg"),
        F.coalesce("passed", F.lit(False)).alias("baseline_passed"),
    )
