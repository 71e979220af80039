"""Generated tests: syntax gate, status, and attaching them to functions."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thriftline import fixed_values as fixed
from thriftline.functions import text as tx
from thriftline.operators.numbering import numbered


def _syntax_error(code: str | None) -> str | None:
    if code is None:
        return "no code"
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(code)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
            return f"syntax error: {error}"
    return None


@F.pandas_udf(T.StringType())
def syntax_error(code: pd.Series) -> pd.Series:
    """NULL for code that parses, else the reason."""
    return code.map(_syntax_error, na_action=None).astype(object)


def check_generated(responses: DataFrame, raw: str = "raw", failure: str | None = None) -> DataFrame:
    """Add ``spec_code``, ``status`` and ``error`` to model responses.

    ``failure`` names a column with the text of a call that failed; it wins.
    """
    code = tx.extract_code(F.col(raw))
    checked = responses.withColumn("_code", code).withColumn(
        "_problem",
        F.when(F.coalesce(F.col("_code"), F.lit("")) == "", "empty response").otherwise(syntax_error(F.col("_code"))),
    )
    problem = F.coalesce(F.col(failure), F.col("_problem")) if failure else F.col("_problem")
    return checked.select(
        *responses.columns,
        F.when(problem.isNull(), F.col("_code")).otherwise(F.lit("")).alias("spec_code"),
        F.when(problem.isNull(), fixed.STATUS_GENERATED).otherwise(fixed.STATUS_FAILED).alias("status"),
        F.coalesce(problem, F.lit("")).alias("error"),
    )


def attach_specs(functions: DataFrame, specs: DataFrame, keys: list[str]) -> DataFrame:
    """Every function with its spec; a function without one counts as failed."""
    narrow = specs.select(*keys, "spec_code", "status", "error")
    return functions.join(narrow, keys, "left").withColumns(
        {
            "spec_code": F.coalesce("spec_code", F.lit("")),
            "status": F.coalesce("status", F.lit(fixed.STATUS_FAILED)),
            "error": F.coalesce("error", F.lit("")),
        }
    )


def count_statuses(results: DataFrame, group: list[str]) -> DataFrame:
    status = F.col("status")
    return results.groupBy(*group).agg(
        F.count_if(status == fixed.STATUS_GENERATED).alias("generated"),
        F.count_if(status == fixed.STATUS_FAILED).alias("failed"),
        F.count(F.lit(1)).alias("total"),
    )


def passes_phase_gate(status: Column, code: Column, spec: Column) -> Column:
    """Usable input of the rewrite phase."""
    return (
        F.coalesce(status.isin(fixed.STATUS_PASSED_EXISTING, fixed.STATUS_GENERATED), F.lit(False))
        & (F.coalesce(code, F.lit("")) != "")
        & (F.coalesce(spec, F.lit("")) != "")
    )


def progress_labels(functions: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``i/n`` of every row within its group, in the given order."""
    ranked = numbered(functions, group, [F.col(c) for c in order], position="i", size="n")
    return ranked.withColumn("label", F.concat_ws("/", F.col("i"), F.col("n")))
