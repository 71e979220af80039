"""Recursive scan of source trees, listed and read by the executors.

The built-in file sources skip names that start with ``_`` and so lose every
``__init__.py``; here folders are listed inside tasks instead.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftline import schemas
from thriftline.functions import paths
from thriftline.session import slots
from thriftline.sources import files

#: Rows of a frame of names, bytes of a frame of contents.
_ROWS, _BYTES = 10_000, 8 << 20
_LEVEL = "project string, file string, n_bytes bigint, uri string, is_dir boolean"


# Of an entry's name, is-folder and size: is it listed, and entered if it is a folder?
Wanted = Callable[[str, bool, int], bool]


def _everything(name: str, is_folder: bool, n_bytes: int) -> bool:
    return True


def _list_level(frames: Iterator[pd.DataFrame], wanted: Wanted = _everything) -> Iterator[pd.DataFrame]:
    """Replace each folder by its entries; files pass through."""

    def rows() -> Iterator[tuple]:
        for frame in frames:
            for project, file, n_bytes, uri, is_dir in frame.itertuples(index=False):
                if not is_dir:
                    yield project, file, n_bytes, uri, False
                    continue
                for name, folder, size in files.children(uri):
                    if wanted(name, folder, size):
                        below = f"{file}/{name}" if file else name
                        yield project, below, size, f"{uri}/{name}", folder

    found = rows()
    while held := list(itertools.islice(found, _ROWS)):
        yield pd.DataFrame(held, columns=["project", "file", "n_bytes", "uri", "is_dir"])


def _walk(frames: Iterator[pd.DataFrame], wanted: Wanted = _everything) -> Iterator[pd.DataFrame]:
    """Files below each folder, whatever the depth."""

    def below(project: str, at: str, where: str) -> Iterator[tuple]:
        # Folders wait by name; files are not held.
        pending = [(at, where)]
        while pending:
            at, where = pending.pop()
            for name, is_folder, size in files.children(where):
                if not wanted(name, is_folder, size):
                    continue
                path, uri = f"{at}/{name}" if at else name, f"{where}/{name}"
                if is_folder:
                    pending.append((path, uri))
                else:
                    yield project, path, size, uri

    def rows() -> Iterator[tuple]:
        for frame in frames:
            for project, file, n_bytes, uri, is_dir in frame.itertuples(index=False):
                if is_dir:
                    yield from below(project, file, uri)
                else:
                    yield project, file, n_bytes, uri

    found = rows()
    while held := list(itertools.islice(found, _ROWS)):
        yield pd.DataFrame(held, columns=["project", "file", "n_bytes", "uri"])


def list_tree(spark: SparkSession, roots: DataFrame, spread_levels: int = 2, wanted: Wanted = _everything) -> DataFrame:
    """Every file below the folders in ``roots(project, uri)``; entries that are not ``wanted`` are left out, folders among them never listed.

    The first ``spread_levels`` levels are listed one at a time and re-spread, so
    a single large root is walked by many tasks.
    """
    level = roots.select(
        "project",
        F.lit("").alias("file"),
        F.lit(0).cast("bigint").alias("n_bytes"),
        F.rtrim(F.col("uri"), F.lit("/")).alias("uri"),
        F.lit(True).alias("is_dir"),
    )
    for _ in range(spread_levels):
        level = level.mapInPandas(lambda frames: _list_level(frames, wanted), schema=_LEVEL).repartition(
            slots(spark), "project", "file"
        )
    return level.mapInPandas(lambda frames: _walk(frames, wanted), schema=schemas.TREE_FILE)


def read_files(listed: DataFrame, batch_bytes: int = _BYTES) -> DataFrame:
    """Bytes of the listed files, in frames of bounded size.

    Files are dealt out by a hash of their path, so neighbours in one large
    project land in different tasks.
    """

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = schemas.SOURCE_FILE.names
        for frame in frames:
            rows, held = [], 0
            for project, file, n_bytes, uri in frame.itertuples(index=False):
                content = files.read_bytes(uri)
                rows.append((project, file, len(content), content))
                held += len(content)
                if held >= batch_bytes:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    narrow = listed.select("project", "file", "n_bytes", "uri")
    dealt = narrow.repartition(slots(listed.sparkSession), "project", "file")
    return dealt.mapInPandas(fetch, schema=schemas.SOURCE_FILE)


def keep_source_files(files_: DataFrame) -> DataFrame:
    """Python files that are neither excluded nor tests."""
    file = F.col("file")
    return files_.filter(paths.is_python(file) & ~paths.is_excluded(file) & ~paths.is_test_file(file))


def keep_test_files(files_: DataFrame) -> DataFrame:
    file = F.col("file")
    return files_.filter(paths.is_python(file) & ~paths.is_excluded(file) & paths.is_test_file(file))


def scan_sources(spark: SparkSession, roots: DataFrame) -> DataFrame:
    """Source files with their bytes; names are filtered before anything is read."""
    return read_files(keep_source_files(list_tree(spark, roots)))


def scan_tests(spark: SparkSession, roots: DataFrame) -> DataFrame:
    return read_files(keep_test_files(list_tree(spark, roots)))


def count_files(files_: DataFrame, group: list[str]) -> DataFrame:
    """Source and test files per group."""
    file = F.col("file")
    kept = paths.is_python(file) & ~paths.is_excluded(file)
    return files_.groupBy(*group).agg(
        F.count_if(kept & ~paths.is_test_file(file)).alias("source_files"),
        F.count_if(kept & paths.is_test_file(file)).alias("test_files"),
    )
