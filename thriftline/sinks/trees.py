"""Writing file tables back as trees of files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thriftline.sources import files as storage


def write_tree(table: DataFrame, root: str, content: str = "content") -> None:
    """Write ``table(project, file, content)`` to ``root/project/file``.

    Tasks write their own files, each under a pending name first; running a task
    again only replaces equal files.
    """
    root = root.rstrip("/")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = f"pending-{uuid.uuid4().hex}"
        for frame in frames:
            for project, file, blob in frame.itertuples(index=False):
                inside = "/".join(p for p in f"{project}/{file}".split("/") if p not in ("", ".", ".."))
                storage.write_bytes(f"{root}/{inside}", bytes(blob), attempt)
            yield pd.DataFrame({"n": [len(frame)]})

    narrow = table.select(F.col("project").cast("string"), "file", F.col(content).cast("binary"))
    narrow.mapInPandas(write, schema="n bigint").write.format("noop").mode("overwrite").save()


def write_table(table: DataFrame, path: str, cluster: str = "project") -> None:
    """The table of record, in Parquet, clustered by project.

    A project's rows lie together, a large one's in several files of about the advised
    size, small ones share files; the name stays in the rows, so any name survives.
    """
    table.hint("rebalance", cluster).sortWithinPartitions(cluster).write.mode("overwrite").parquet(path)
