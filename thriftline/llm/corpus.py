"""What the corpus operators share: reading tables and running Python over columns of text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_bytes(text: str = "text") -> Column:
    """UTF-8 of a text; NULL counts as empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def each_text(
    docs: DataFrame,
    keep: list[Column],
    measure: Callable[[Iterable[bytes]], dict[str, list]],
    schema: str,
    text: str = "text",
) -> DataFrame:
    """Columns ``keep`` of every document and what ``measure`` makes of its text.

    ``measure`` gets the UTF-8 texts of one Arrow batch and returns a list for each
    new column of ``schema``, which lists the kept columns first.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column(batch.num_columns - 1).to_pylist())
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            made = [found[n] if isinstance(found[n], pa.Array) else pa.array(found[n]) for n in names[len(kept) :]]
            yield pa.RecordBatch.from_arrays([*kept, *made], names)

    return docs.select(*keep, text_bytes(text).alias("_text")).mapInArrow(run, schema)


def words(text: bytes) -> list[bytes]:
    """Runs of anything but ASCII white space, with A-Z in lower case."""
    return text.lower().split()
