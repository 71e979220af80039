"""Readers for spec and result documents (nested JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thriftline import schemas


def _flatten(documents: DataFrame) -> DataFrame:
    return documents.select("project_root", "generated_at", F.inline("functions"))


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row per function of whole-file JSON documents; an absent path raises."""
    return _flatten(spark.read.schema(schema).json(path, multiLine=True))


def read_document_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The same for files that hold one document per line; these can be split."""
    return _flatten(spark.read.schema(schema).json(path))


def parse_documents(table: DataFrame, column: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """One row per function of documents held as text in a column."""
    parsed = table.select(*keys, F.from_json(column, schema).alias("document"))
    return parsed.select(*keys, F.col("document.project_root"), F.inline("document.functions"))


def read_section(spark: SparkSession, path: str, section: str, schema: T.StructType | str) -> DataFrame:
    """Records of one section of documents written by ``sinks.documents``, with their ``place``.

    Every record is a row of its own, so even one huge document is read by many tasks.
    """
    rows = spark.read.parquet(path).filter(F.col("section") == section)
    parsed = F.from_json(F.when(F.startswith("line", F.lit("{")), F.col("line")), schema)
    return rows.select("project", "place", parsed.alias("r"), F.col("line").alias("raw")).select(
        "project", "place", "r.*", "raw"
    )


def read_savings(spark: SparkSession, path: str, names: tuple[list[str], list[str]], costs: T.DataType) -> DataFrame:
    """One row a project: when it was made, every scalar of its summary and its ``cost_estimates``.

    ``names`` are the scalars before and after the file list.
    """
    head, tail = (T.StructType([T.StructField(n, T.DoubleType()) for n in part]) for part in names)
    text = T.StringType()
    opening = T.StructType([T.StructField("generated_at", text), T.StructField("project_root", text), T.StructField("summary", head)])
    middle = T.StructType([T.StructField("summary", tail), T.StructField("cost_estimates", costs)])
    rows = spark.read.parquet(path)
    first = rows.filter(F.col("section") == "0-open").select(
        F.col("project").alias("_project"), F.from_json(F.concat("line", F.lit("]}}")), opening).alias("a")
    )
    second = rows.filter(F.col("section") == "2-costs").select(
        "project",
        F.from_json(F.concat(F.lit('{"summary":{'), F.substring(F.col("line"), 3, 2147483647), F.lit("]}")), middle).alias("b"),
    )
    return second.join(first, F.col("project").eqNullSafe(F.col("_project"))).select(
        "project", "a.generated_at", "a.project_root", "a.summary.*", "b.summary.*", "b.cost_estimates"
    )


def spec_documents(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark, path, schemas.SPEC_DOCUMENT)


def result_documents(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark, path, schemas.RESULT_DOCUMENT)
