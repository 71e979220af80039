"""Files of any size written by many tasks, one file for each name.

Lines have an order and so a byte offset, the sum of the lengths before them.  Stretches of lines are parts; a part knows
where in its file it belongs.  On a file system with folders (``file:``, a mounted share) every task writes its parts straight
into place.  Elsewhere parts are objects, and one task for each file then streams them into the file in order, a few
megabytes at a time.  Files get their name when they are whole.  A part that is written twice is the same bytes in the same place, so
tasks may be run again.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftline.operators.running import running_total
from thriftline.session import written
from thriftline.sources import files

#: Bytes of a part; a longer line is a part of its own.
PART = 32 << 20
_COPY = 8 << 20


def file_name(name: Column, suffix: str) -> Column:
    """A file name for any text: distinct for distinct texts, NULL and empty ones too."""
    quoted = F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))
    short = F.when(F.length(quoted) <= 200, F.concat(F.lit("n-"), quoted)).otherwise(F.concat(F.lit("h-"), F.sha2(name, 256)))
    return F.concat(F.coalesce(short, F.lit("null")), F.lit(suffix))


def _in_place(uri: str) -> str | None:
    """Path of a file that tasks can write into at any place."""
    system, path = files.locate(uri)
    return path if isinstance(system, fs.LocalFileSystem) else None


def _put(uri: str, start: int, data: bytes, attempt: int) -> None:
    path = _in_place(uri)
    if path is None:
        files.write_bytes(f"{uri}.parts/{start:020}", data, str(attempt))
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    handle = os.open(f"{path}.pending", os.O_CREAT | os.O_WRONLY, 0o644)
    try:
        done = 0
        while done < len(data):
            done += os.pwrite(handle, memoryview(data)[done : done + _COPY], start + done)
    finally:
        os.close(handle)


def _finish(uri: str, n_bytes: int) -> None:
    path = _in_place(uri)
    if path is not None:
        if not os.path.exists(f"{path}.pending") and os.path.exists(path) and os.path.getsize(path) == n_bytes:
            return  # this task has run before
        if os.path.getsize(f"{path}.pending") != n_bytes:
            raise OSError(f"{uri}: {os.path.getsize(f'{path}.pending')} bytes of {n_bytes} written")
        os.replace(f"{path}.pending", path)
        return
    system, target = files.locate(uri)
    with system.open_output_stream(target) as out:
        for name, _, _ in sorted(files.children(f"{uri}.parts")):
            with system.open_input_stream(f"{target}.parts/{name}") as part:
                shutil.copyfileobj(part, out, _COPY)


def write_files(lines: DataFrame, folder: str, suffix: str = "", part: int = PART) -> DataFrame:
    """Write ``lines(name, place, value)`` as one file for each name below ``folder``; gives ``(name, uri, n_bytes)``.

    ``place`` tells all lines apart and orders them; each value is a line.  No two jobs may write one folder at a time.
    """
    narrow = lines.select("name", "place", (F.octet_length("value") + 1).cast("bigint").alias("size"))
    offsets = written(running_total(narrow, ["name"], [F.col("place")], F.col("size"), "start", "n_bytes"), "offsets")
    stretch = F.floor(F.col("start") / part)
    uri = F.concat(F.lit(folder.rstrip("/") + "/"), file_name(F.col("name"), suffix))
    placed = lines.select(F.col("place"), "value").join(offsets, "place").withColumns({"uri": uri, "part": stretch})
    dealt = placed.repartition("uri", "part").sortWithinPartitions("uri", "part", "place").select("uri", "part", "start", "value")

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, open_part, first, attempt = [], None, 0, os.getpid()
        parts = 0
        for frame in frames:
            for target, number, start, value in frame.itertuples(index=False):
                if (target, number) != open_part:
                    if held:
                        _put(open_part[0], first, b"".join(held), attempt)
                        parts += 1
                    held, open_part, first = [], (target, number), int(start)
                held.append(value.encode() + b"\n")
        if held:
            _put(open_part[0], first, b"".join(held), attempt)
            parts += 1
        yield pd.DataFrame({"parts": [parts]})

    dealt.mapInPandas(put, "parts bigint").write.format("noop").mode("overwrite").save()
    whole = written(offsets.groupBy("name").agg(F.max("n_bytes").alias("n_bytes")).withColumn("uri", uri), "files")

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for target, n_bytes in frame.itertuples(index=False):
                _finish(target, int(n_bytes))
            yield pd.DataFrame({"files": [len(frame)]})

    whole.select("uri", "n_bytes").mapInPandas(finish, "files bigint").write.format("noop").mode("overwrite").save()
    return whole.select("name", "uri", "n_bytes")
