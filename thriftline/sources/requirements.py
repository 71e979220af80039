"""Requirement files: which one applies, its lines, and the tools it lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftline import fixed_values as fixed
from thriftline.functions import text as tx


def requirement_lines(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Numbered lines of requirement files."""
    return files.select(*keys, F.posexplode(tx.split_lines(F.col(text))).alias("pos", "line")).select(
        *keys, (F.col("pos") + 1).alias("line_no"), "line"
    )


def requirements_of_tree(tree: DataFrame) -> DataFrame:
    """Numbered lines of every requirements file of ``tree(project, file, text)``."""
    named = F.substring_index("file", "/", -1) == fixed.REQUIREMENTS_NAME
    return requirement_lines(tree.filter(named), ["project", "file"])


def clean_requirements(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Requirements without comments, blanks and installer lines."""
    kept = lines.withColumn("spec", tx.requirement_of(F.col("line")))
    return kept.filter(tx.is_requirement(F.col("spec"))).select(*keys, "line_no", "spec")


def missing_tools(requirements: DataFrame, projects: DataFrame, keys: list[str]) -> DataFrame:
    """Required tools that no requirement of the project starts with.

    One flag per tool and project, so the work is one small aggregate and no
    pairing of requirements with tools.
    """
    lowered = F.lower("spec")
    listed = requirements.groupBy(*keys).agg(
        *[F.bool_or(F.startswith(lowered, F.lit(tool))).alias(f"has_{n}") for n, tool in enumerate(fixed.REQUIRED_TOOLS)]
    )

    def if_missing(n: int, tool: str) -> Column:
        return F.when(~F.coalesce(F.col(f"has_{n}"), F.lit(False)), F.lit(tool))

    wanted = F.array_compact(F.array(*[if_missing(n, tool) for n, tool in enumerate(fixed.REQUIRED_TOOLS)]))
    return projects.select(*keys).distinct().join(listed, keys, "left").select(*keys, F.explode(wanted).alias("spec"))


def with_required_tools(requirements: DataFrame, projects: DataFrame, keys: list[str]) -> DataFrame:
    """Requirements followed by the tools that had to be added."""
    own = requirements.select(*keys, "spec", F.lit(False).alias("added"))
    return own.unionByName(missing_tools(requirements, projects, keys).withColumn("added", F.lit(True)))


def find_requirements(projects: DataFrame, files: DataFrame) -> DataFrame:
    """Requirements file of each ``projects(archive, root)``: in the root, else in its parent.

    ``requirements_file`` is NULL when neither folder has one.
    """
    name = F.lit(fixed.REQUIREMENTS_NAME)
    root = F.col("root")
    parent = F.when(F.contains(root, F.lit("/")), F.regexp_replace(root, r"/[^/]*\z", "")).when(root != "", F.lit(""))

    def below(folder: Column) -> Column:
        return F.when(folder == "", name).otherwise(F.concat_ws("/", folder, name))

    places = F.array(
        F.struct(F.lit(0).alias("rank"), below(root).alias("file")),
        F.struct(F.lit(1).alias("rank"), F.when(parent.isNotNull(), below(parent)).alias("file")),
    )
    named = files.filter(F.substring_index("file", "/", -1) == fixed.REQUIREMENTS_NAME).select("archive", "file").distinct()
    candidates = projects.select("archive", "root", F.inline(places)).filter(F.col("file").isNotNull())
    hits = candidates.join(named, ["archive", "file"]).groupBy("archive", "root").agg(F.min("rank").alias("rank"))
    chosen = F.when(F.col("rank") == 0, below(root)).when(F.col("rank") == 1, below(parent))
    return projects.join(hits, ["archive", "root"], "left").select("archive", "root", chosen.alias("requirements_file"))


def project_requirements(projects: DataFrame, files: DataFrame) -> DataFrame:
    """What to install for each ``projects(archive, root)``: the requirements of the one file that applies, then the tools it lacks.

    ``files(archive, file, text)``; only the chosen files' text is read on.
    """
    keys = ["archive", "root"]
    chosen = find_requirements(projects.select(*keys).distinct(), files)
    texts = files.select("archive", F.col("file").alias("requirements_file"), "text")
    lines = requirement_lines(chosen.join(texts, ["archive", "requirements_file"]), keys)
    return with_required_tools(clean_requirements(lines, keys), chosen, keys)
