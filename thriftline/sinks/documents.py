"""JSON documents written by many tasks.

A document of one project may be larger than a task can hold, so documents are kept as a
table of lines, ``project, section, is_list, place, line``, in the order of ``place``: ranges of
the sort order, each sorted by one task.  Lines cross the network once and are written
once, projects share files, and every record has a line of its own.
:func:`document_texts` adds the commas and :func:`export_documents` writes JSON files.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftline import schemas
from thriftline.functions.numbers import sanitize
from thriftline.operators import impact, summary
from thriftline.operators.routing import skipped_summary
from thriftline.session import written
from thriftline.sinks import assembled

_JSON = {"ignoreNullFields": "false"}

#: Scalars of a savings summary, before and after its list of files.
SUMMARY_HEAD = ["total_functions_analyzed", "functions_optimized", "functions_skipped", "success_rate_pct"]
SUMMARY_TAIL = [
    "functions_with_measurements", "avg_co2_reduction_pct", "max_co2_reduction_pct", "min_co2_reduction_pct",
    "total_baseline_emissions_kg", "total_optimized_emissions_kg", "total_co2_saved_kg", "total_co2_saved_g",
]


@dataclass(frozen=True)
class Section:
    """Lines of a document: one per project, or one per record where a sort key is given.

    Records are sorted by ``number``, then ``text``, ``at`` and ``tie``; NULL numbers
    come last.
    """

    name: str
    rows: DataFrame
    line: Column
    number: Column | None = None
    text: Column | None = None
    at: Column | None = None
    tie: Column | None = None

    @property
    def is_list(self) -> bool:
        return any(key is not None for key in (self.number, self.text, self.at, self.tie))


_KEYS = {"number": "double", "text": "string", "at": "bigint", "tie": "string"}


def json_of(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), _JSON)


def quoted(value: Column) -> Column:
    """JSON string of a text column, ``null`` for NULL."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v")), _JSON), r'(?s)\A\{"v":(.*)\}\z', 1)


def _lines(section: Section, number: int) -> DataFrame:
    """One section as ``project, section, is_list, line`` and its sort keys."""
    keys = []
    for name, kind in _KEYS.items():
        key = getattr(section, name)
        keys.append((F.lit(None) if key is None else key).cast(kind).alias(name))
    return section.rows.select(
        "project",
        F.lit(f"{number}-{section.name}").alias("section"),
        F.lit(section.is_list).alias("is_list"),
        section.line.alias("line"),
        *keys,
    )


def write_document(sections: list[Section], path: str) -> None:
    """Write the sections in order, all lines in one sort; a list may be of any length."""
    lines = functools.reduce(DataFrame.unionByName, [_lines(s, n) for n, s in enumerate(sections)])
    order = ["project", "section", F.col("number").asc_nulls_last(), "text", "at", "tie", "line"]
    placed = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = placed.select("project", "section", "is_list", F.monotonically_increasing_id().alias("place"), "line")
    kept.write.mode("overwrite").parquet(path)


def document_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(project, place, value)``: lines that give each project's JSON document when joined in order."""
    rows = spark.read.parquet(path)
    # Met by place, which is a row's own: by project, all lines of a project would go to one task.
    first = rows.filter("is_list").groupBy("project", "section").agg(F.min("place").alias("place"))
    met = rows.join(first.select("place", F.lit(True).alias("_first")), "place", "left")
    comma = F.when(F.col("is_list") & F.col("_first").isNull(), F.lit(",")).otherwise(F.lit(""))
    return met.select("project", "place", F.concat(comma, "line").alias("value"))


def export_documents(spark: SparkSession, path: str, folder: str, part: int = assembled.PART) -> DataFrame:
    """One JSON file for each project below ``folder``, however long: ``(project, uri, n_bytes)``."""
    lines = document_texts(spark, path).withColumnRenamed("project", "name")
    return assembled.write_files(lines, folder, ".json", part).withColumnRenamed("name", "project")


def _opening(generated_at: str) -> Column:
    return F.concat(
        F.lit('{"project_root":'),
        quoted(F.col("project")),
        F.lit(f',"generated_at":"{generated_at}","functions":['),
    )


def _function_document(records: DataFrame, columns: list[str], at: str | None, generated_at: str, path: str) -> None:
    own = [*columns, at] if at and at not in columns else columns
    kept = written(records.select("project", *own), "records")
    projects = kept.select("project").distinct()
    write_document(
        [
            Section("open", projects, _opening(generated_at)),
            Section(
                "functions", kept, json_of(columns), text=F.col("file"), at=F.col(at) if at else None, tie=F.col("id")
            ),
            Section("close", projects, F.lit("]}")),
        ],
        path,
    )


def write_spec_documents(specs: DataFrame, path: str, generated_at: str) -> None:
    """Spec results as one document per project, functions in file and line order."""
    _function_document(specs, schemas.SPEC_RESULT.names, "line", generated_at, path)


def write_result_documents(results: DataFrame, path: str, generated_at: str) -> None:
    """Result records as one document per project; NaN and infinities become null."""
    clean = sanitize(results)
    _function_document(clean, schemas.RESULT.names, "line" if "line" in clean.columns else None, generated_at, path)


def write_savings_documents(results: DataFrame, path: str, generated_at: str) -> None:
    """Savings summary as one document per project.

    Scalars come from one aggregate; the three lists are written row by row.  The
    narrow records are written out once, since every section reads them.
    """
    narrow = results.select(
        "project", "id", "name", "file", "line", "baseline_emissions_kg", "optimized_emissions_kg",
        "reduction_pct", "success", "optimization_attempts", "skip_reason",
    )
    results = written(narrow, "records")
    scalars = written(sanitize(summary.project_summary(results, ["project"])), "scalars")
    head, tail = SUMMARY_HEAD, SUMMARY_TAIL
    opening = F.concat(
        F.lit(f'{{"generated_at":"{generated_at}","project_root":'),
        quoted(F.col("project")),
        F.lit(',"summary":'),
        F.regexp_replace(json_of(head), r"\}\z", ""),
        F.lit(',"files_optimized":['),
    )
    middle = F.concat(
        F.lit("],"),
        F.regexp_replace(json_of(tail), r"\A\{", ""),
        F.lit(',"cost_estimates":'),
        F.to_json(impact.cost_estimates(F.col("total_co2_saved_kg")), _JSON),
        F.lit(',"optimized_functions":['),
    )
    saved = sanitize(summary.function_savings(results, ["project"]))
    saved_names = [c for c in saved.columns if c not in ("project", "line")]
    skipped = skipped_summary(results, ["project", "line"])
    write_document(
        [
            Section("open", scalars, opening),
            Section("files", summary.files_optimized(results, ["project"]), quoted(F.col("file")), text=F.col("file")),
            Section("costs", scalars, middle),
            Section(
                "optimized",
                saved,
                json_of(saved_names),
                number=-F.col("reduction_pct"),
                text=F.col("file"),
                at=F.col("line"),
                tie=F.col("id"),
            ),
            Section("between", scalars, F.lit('],"skipped_functions":[')),
            Section(
                "skipped",
                skipped,
                json_of(["id", "name", "file", "reason"]),
                text=F.col("file"),
                at=F.col("line"),
                tie=F.col("id"),
            ),
            Section("close", scalars, F.lit("]}")),
        ],
        path,
    )
