"""Routing of functions and the records that come out of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftline import fixed_values as fixed, schemas
from thriftline.functions import paths
from thriftline.functions import text as tx
from thriftline.operators.outcome import failure_reason


def with_source_flag(functions: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``has_source``: is the function's file part of the tree?"""
    present = files.select(*keys).distinct().withColumn("_present", F.lit(True))
    return functions.join(present, keys, "left").withColumn(
        "has_source", F.coalesce("_present", F.lit(False))
    ).drop("_present")


def skip_reason(status: Column, spec: Column, has_source: Column) -> Column:
    """First reason that applies, NULL for functions to work on."""
    no_spec = ~status.eqNullSafe(F.lit(fixed.STATUS_GENERATED)) | (F.coalesce(spec, F.lit("")) == "")
    return F.when(no_spec, fixed.SKIP_NO_SPEC).when(~has_source, fixed.SKIP_NO_SOURCE)


def route(functions: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Functions with ``skip_reason``; eligible ones have none."""
    return routed(with_source_flag(functions, files, keys))


def routed(flagged: DataFrame) -> DataFrame:
    """The same for functions that have ``has_source`` already."""
    here = F.coalesce("has_source", F.lit(False))
    return flagged.withColumn("skip_reason", skip_reason(F.col("status"), F.col("spec_code"), here))


def with_failures(routed: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Add the reasons of runs that timed out or raised, from ``runs(keys, elapsed_s, error_text)``.

    A reason that is there already stays.
    """
    reason = failure_reason(F.col("elapsed_s"), F.col("error_text"))
    failed = runs.select(*keys, reason.alias("_failure"))
    return routed.join(failed, keys, "left").withColumn("skip_reason", F.coalesce("skip_reason", "_failure")).drop("_failure")


def eligible(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("skip_reason").isNull())


def _text_or_empty(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")


def skipped_records(routed: DataFrame, keep: list[str]) -> DataFrame:
    """Result records of skipped functions: original code, no emissions, no attempts."""
    skipped = routed.filter(F.col("skip_reason").isNotNull())
    own = {name: _text_or_empty(skipped, name) for name in schemas.RESULT.names[:6]}
    own["optimized_function_code"] = own["function_code"]
    own["optimized_test_code"] = own["spec_code"]
    own["baseline_emissions_kg"] = F.lit(None).cast("double")
    own["optimized_emissions_kg"] = F.lit(None).cast("double")
    own["reduction_pct"] = F.lit(0.0)
    own["success"] = F.lit(False)
    own["optimization_attempts"] = F.lit(0)
    own["skip_reason"] = F.col("skip_reason")
    return skipped.select(*keep, *[own[name].alias(name) for name in schemas.RESULT.names])


def final_records(outcomes: DataFrame, keep: list[str]) -> DataFrame:
    """Result records of functions that were worked on.

    The rewrite and its emissions show only where it was accepted.
    """
    success = F.coalesce(F.col("success"), F.lit(False))
    own = {name: _text_or_empty(outcomes, name) for name in schemas.RESULT.names[:6]}
    own["optimized_function_code"] = F.when(success, F.col("optimized_function_code")).otherwise(own["function_code"])
    own["optimized_test_code"] = own["spec_code"]
    own["optimized_emissions_kg"] = F.when(success, F.col("optimized_emissions_kg"))
    own["success"] = success
    rest = {name: F.col(name) for name in schemas.RESULT.names if name not in own}
    own.update(rest)
    return outcomes.select(*keep, *[own[name].alias(name) for name in schemas.RESULT.names])


def all_records(skipped: DataFrame, processed: DataFrame) -> DataFrame:
    """Skipped and processed records as one table; either side may be empty."""
    return skipped.unionByName(processed)


def is_success() -> Column:
    return F.coalesce(F.col("success"), F.lit(False))


def successes(results: DataFrame) -> DataFrame:
    return results.filter(is_success())


def non_successes(results: DataFrame) -> DataFrame:
    """Exact complement of :func:`successes`; a missing flag counts here."""
    return results.filter(~is_success())


def is_measured() -> Column:
    """Accepted with both emissions known."""
    return is_success() & F.col("baseline_emissions_kg").isNotNull() & F.col("optimized_emissions_kg").isNotNull()


def measured(results: DataFrame) -> DataFrame:
    return results.filter(is_measured())


def skipped_summary(results: DataFrame, keep: list[str]) -> DataFrame:
    """``id, name, file, reason`` of what was not accepted."""
    return non_successes(results).select(*keep, "id", "name", "file", F.col("skip_reason").alias("reason"))


def rewrites(results: DataFrame, code: str = "optimized_function_code") -> DataFrame:
    """Accepted records with a non-blank replacement."""
    return successes(results).filter(F.length(tx.strip(F.coalesce(F.col(code), F.lit("")))) > 0)


def with_source(functions: DataFrame, files: DataFrame, project_rel: Column | None = None) -> DataFrame:
    """Functions with the text of their file, by path below the archive root.

    ``found`` is false where the tree has no such file.
    """
    target = paths.rebase(project_rel, F.col("file")) if project_rel is not None else F.col("file")
    texts = files.select("project", F.col("file").alias("target_file"), "text", F.lit(True).alias("found"))
    return (
        functions.withColumn("target_file", target)
        .join(texts, ["project", "target_file"], "left")
        .withColumn("found", F.coalesce("found", F.lit(False)))
    )


def missing_targets(functions: DataFrame, files: DataFrame, project_rel: Column | None = None) -> DataFrame:
    """Functions whose file is not in the tree, with the reason; no text is read."""
    target = paths.rebase(project_rel, F.col("file")) if project_rel is not None else F.col("file")
    known = files.select("project", F.col("file").alias("target_file"))
    return (
        functions.withColumn("target_file", target)
        .join(known, ["project", "target_file"], "left_anti")
        .withColumn("reason", F.lit("file not found"))
    )
