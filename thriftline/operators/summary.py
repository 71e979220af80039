"""Savings of accepted rewrites, per project or over any other grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftline import fixed_values as fixed
from thriftline.functions import numbers as nm
from thriftline.functions import paths
from thriftline.operators import totals as exact
from thriftline.operators.numbering import numbered
from thriftline.operators.routing import is_measured, successes


def _grouped(df: DataFrame, group: list[str]):
    return df.groupBy(*group)


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole) * 100, F.lit(0.0))


def counts(results: DataFrame, group: list[str]) -> DataFrame:
    """Analysed, accepted and skipped functions with the success rate (one decimal)."""
    ok = F.count_if(F.col("success"))
    every = F.count(F.lit(1))
    return _grouped(results, group).agg(
        every.alias("total_functions_analyzed"),
        ok.alias("functions_optimized"),
        (every - ok).alias("functions_skipped"),
        nm.round_even(_share(ok, every), 1).alias("success_rate_pct"),
    )


def report_counts(results: DataFrame, group: list[str]) -> DataFrame:
    """The same for the report: rate not rounded, distinct files counted."""
    ok = F.count_if(F.col("success"))
    every = F.count(F.lit(1))
    return _grouped(results, group).agg(
        every.alias("total_functions"),
        ok.alias("optimised_functions"),
        (every - ok).alias("failed_functions"),
        _share(ok, every).alias("success_rate"),
        F.count_distinct(F.when(F.col("success"), F.col("file"))).alias("files_touched"),
    )


def success_line(results: DataFrame, group: list[str]) -> DataFrame:
    """``ok/all`` as shown at the end of a run."""
    ok = F.count_if(F.col("success"))
    every = F.count(F.lit(1))
    return _grouped(results, group).agg(
        ok.alias("successful"), every.alias("total"), F.concat_ws("/", ok, every).alias("label")
    )


def _measured_sums() -> tuple[dict[str, Column], dict[str, exact.Merged]]:
    """Sums and count over measured functions."""
    seen = is_measured()
    sums = {f"total_{when}_emissions_kg": F.when(seen, F.col(f"{when}_emissions_kg")) for when in ("baseline", "optimized")}
    return sums, {"functions_with_measurements": exact.counted(F.count_if(seen))}


def _saved() -> dict[str, Column]:
    saved = F.col("total_baseline_emissions_kg") - F.col("total_optimized_emissions_kg")
    return {"total_co2_saved_kg": saved, "total_co2_saved_g": nm.kg_to_g(saved)}


def _measured_pct() -> tuple[dict[str, Column], dict[str, exact.Merged]]:
    """What the mean, largest and smallest reduction are made of."""
    pct = F.when(is_measured(), F.col("reduction_pct"))
    return {"_pct": pct}, {"_n": exact.counted(F.count(pct)), "_max": exact.highest(pct), "_min": exact.lowest(pct)}


def _reductions() -> list[Column]:
    zero = F.lit(0.0)
    return [
        nm.round_even(F.coalesce(F.try_divide(F.col("_pct"), F.col("_n")), zero), 2).alias("avg_co2_reduction_pct"),
        nm.round_even(F.coalesce(F.col("_max"), zero), 2).alias("max_co2_reduction_pct"),
        nm.round_even(F.coalesce(F.col("_min"), zero), 2).alias("min_co2_reduction_pct"),
    ]


def totals(results: DataFrame, group: list[str]) -> DataFrame:
    """Emissions before and after, and what was saved, over measured functions."""
    sums, others = _measured_sums()
    return exact.exact_sums(results, group, sums, others).withColumns(_saved())


def reductions(results: DataFrame, group: list[str]) -> DataFrame:
    """Mean, largest and smallest reduction over measured functions, two decimals."""
    return exact.exact_sums(results, group, *_measured_pct()).select(*group, *_reductions())


def files_optimized(results: DataFrame, group: list[str]) -> DataFrame:
    """Distinct touched files as rows; a project may have any number of them."""
    return successes(results).select(*group, "file").distinct()


def files_optimized_in_order(results: DataFrame, group: list[str]) -> DataFrame:
    return numbered(files_optimized(results, group), group, [F.col("file")])


def project_summary(results: DataFrame, group: list[str]) -> DataFrame:
    """All scalars of the savings summary in one pass over the records."""
    sums, others = _measured_sums()
    pct, parts = _measured_pct()
    more = {
        "total_functions_analyzed": exact.counted(F.count(F.lit(1))),
        "functions_optimized": exact.counted(F.count_if(F.col("success"))),
    }
    found = exact.exact_sums(results, group, sums | pct, more | others | parts)
    every, ok = F.col("total_functions_analyzed"), F.col("functions_optimized")
    return found.select(
        *group,
        *more,
        (every - ok).alias("functions_skipped"),
        nm.round_even(_share(ok, every), 1).alias("success_rate_pct"),
        *others,
        *_reductions(),
        *sums,
    ).withColumns(_saved())


def _savings_order() -> list[Column]:
    return [F.col("reduction_pct").desc_nulls_last(), F.col("file"), F.col("line"), F.col("id")]


def function_savings(results: DataFrame, keep: list[str]) -> DataFrame:
    """What each accepted function saved, best first when written or ranked."""
    return successes(results).select(
        *keep,
        "id",
        "name",
        "file",
        "line",
        "baseline_emissions_kg",
        "optimized_emissions_kg",
        nm.saved_kg(F.col("baseline_emissions_kg"), F.col("optimized_emissions_kg")).alias("co2_saved_kg"),
        F.coalesce("reduction_pct", F.lit(0.0)).alias("reduction_pct"),
        F.coalesce("optimization_attempts", F.lit(0)).alias("optimization_attempts"),
    )


def ranked_savings(results: DataFrame, group: list[str]) -> DataFrame:
    return numbered(function_savings(results, group), group, _savings_order(), position="rank")


def top_savings(results: DataFrame, keep: list[str], k: int) -> DataFrame:
    """The ``k`` best over all groups; each task keeps its own ``k`` only."""
    return function_savings(results, keep).orderBy(*_savings_order(), *keep).limit(k)


def report_rows(results: DataFrame, keep: list[str]) -> DataFrame:
    """Name, file and status of accepted functions; a missing name becomes the file's stem."""
    return successes(results).select(
        *keep,
        F.coalesce(F.col("name"), paths.stem(F.col("file"))).alias("name"),
        "file",
        F.lit(fixed.REPORT_STATUS).alias("status"),
    )
