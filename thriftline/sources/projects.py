"""Where the Python project starts inside an archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thriftline import fixed_values as fixed
from thriftline.functions import paths


def candidate_folders(files: DataFrame) -> DataFrame:
    """Top folders of ``files(archive, file)`` with what decides between them."""
    file = F.col("file")
    parts = paths.parts(file)
    nested = F.size(parts) > 1
    top = F.when(nested, F.get(parts, F.lit(0))).otherwise(F.lit(""))
    return (
        files.withColumn("folder", top)
        .groupBy("archive", "folder")
        .agg(
            F.bool_or(paths.is_python(file)).alias("has_python"),
            F.bool_or(file == F.concat_ws("/", F.col("folder"), F.lit(fixed.REQUIREMENTS_NAME))).alias("has_requirements"),
        )
        .withColumn("hidden", paths.is_hidden(F.col("folder")))
    )


def find_project_roots(files: DataFrame) -> DataFrame:
    """``(archive, root)``: the top if it holds Python files, else the first folder with
    requirements, else the first folder with Python files, else the top.

    Folders come first as one row each, so a hot archive is reduced before the
    final step.
    """
    folder = F.col("folder")
    inside = (folder != "") & ~F.col("hidden")
    picked = candidate_folders(files).groupBy("archive").agg(
        F.bool_or((folder == "") & F.col("has_python")).alias("top"),
        F.min(F.when(inside & F.col("has_requirements"), folder)).alias("by_requirements"),
        F.min(F.when(inside & F.col("has_python"), folder)).alias("by_python"),
    )
    root = F.when(F.col("top"), F.lit("")).otherwise(F.coalesce("by_requirements", "by_python", F.lit("")))
    return picked.select("archive", root.alias("root"))
