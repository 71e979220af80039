"""One JSON document read by many tasks.

A file is cut into byte ranges anywhere.  What a range means depends on what comes before it: whether it begins within
a string, right behind a backslash, and at which depth.  So each range is first summed up for every way in which it
could begin (three), the summaries are put together in order, and then every range is read knowing how it begins.  A record,
an object that is an item of a list directly below the document, belongs to the range it starts in; the task reads on
until it ends.  What lies outside of all lists and objects below the document is kept as a frame, a small document with the
scalars and, in order, the names of the lists.

A task holds one range and the record that runs over its end.  White space and line ends mean nothing.  Files that are not one
JSON object give an error; empty files are passed over, as Spark does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thriftline.session import spread, written
from thriftline.sources import files

#: Bytes of a range.
RANGE = 8 << 20
_QUOTE, _BACKSLASH = ord('"'), ord("\\")
#: Within the document, within a list or object of it, within a record.
_TOP, _INSIDE, _RECORD = 1, 2, 3

# How a range begins: outside of strings, within one, within one and right behind a backslash.
_STARTS = ((False, False), (True, False), (True, True))


def _escaped_at(data: np.ndarray, at: np.ndarray, escaped: bool) -> np.ndarray:
    """Whether an odd number of backslashes stands right before each place."""
    slashes = np.flatnonzero(data == _BACKSLASH)
    if not len(slashes):
        return (at == 0) & escaped
    # Backslashes in a row are numbered from the first of the row.
    new = np.concatenate([[True], np.diff(slashes) != 1])
    heads = np.maximum.accumulate(np.where(new, np.arange(len(slashes)), 0))
    length = np.arange(len(slashes)) - heads + 1 + (escaped & (slashes[heads] == 0))
    before = np.searchsorted(slashes, at) - 1
    there = (before >= 0) & (slashes[np.maximum(before, 0)] == at - 1)
    return np.where(there, length[np.maximum(before, 0)] % 2 == 1, (at == 0) & escaped)


class Range:
    """The marks of a byte range that begins as told."""

    def __init__(self, data: bytes, in_string: bool, escaped: bool):
        bytes_ = np.frombuffer(data, dtype=np.uint8)
        quotes = np.flatnonzero(bytes_ == _QUOTE)
        quotes = quotes[~_escaped_at(bytes_, quotes, escaped)]
        folded = bytes_ | 0x20  # [ and { differ in this bit only, ] and } too
        places = np.flatnonzero((folded == ord("{")) | (folded == ord("}")))
        outside = (np.searchsorted(quotes, places) + in_string) % 2 == 0
        self.places = places[outside]
        self.opens = folded[self.places] == ord("{")
        self.curly = bytes_[self.places] >= ord("{")
        self.steps = np.where(self.opens, 1, -1)
        self.in_string = bool((len(quotes) + in_string) % 2)
        end = _escaped_at(bytes_, np.array([len(bytes_)]), escaped)[0] if len(bytes_) else escaped
        self.escaped = bool(end and self.in_string)

    def depths(self, depth: int) -> np.ndarray:
        """The depth behind each bracket."""
        return depth + np.cumsum(self.steps)


def summed_up(data: bytes) -> list[tuple[int, int]]:
    """For each way to begin: the way the range ends, and by how much it is deeper then."""
    found = []
    for in_string, escaped in _STARTS:
        read = Range(data, in_string, escaped)
        found.append((_STARTS.index((read.in_string, read.escaped)), int(read.steps.sum())))
    return found


def _read(uri: str, start: int, size: int) -> bytes:
    system, path = files.locate(uri)
    with system.open_input_file(path) as source:
        return source.read_at(size, start)


def _rest_of_record(uri: str, at: int, way: int, depth: int, size: int) -> bytes:
    """Bytes from ``at`` to the end of the record that is open there."""
    parts = []
    while data := _read(uri, at, size):
        read = Range(data, *_STARTS[way])
        depths = read.depths(depth)
        ends = np.flatnonzero((depths == _INSIDE) & ~read.opens)
        if len(ends):
            parts.append(data[: int(read.places[ends[0]]) + 1])
            return b"".join(parts)
        parts.append(data)
        way, depth, at = _STARTS.index((read.in_string, read.escaped)), depth + int(read.steps.sum()), at + len(data)
    raise ValueError(f"{uri}: a record does not end")


def cut(uri: str, start: int, data: bytes, way: int, depth: int, ahead: int = 1 << 16) -> tuple[bytes, int, list[tuple[int, int, bytes]]]:
    """The frame's bytes of a range, how many lists and objects begin in it, and ``(lists before, place, record)`` of its records."""
    read = Range(data, *_STARTS[way])
    depths = read.depths(depth)
    came_in = (depths == _INSIDE) & read.opens
    left = (depths == _TOP) & ~read.opens
    frame, at, inside = [], 0, depth >= _INSIDE
    for i in np.flatnonzero(came_in | left).tolist():
        place = int(read.places[i])
        if came_in[i]:
            frame.append(data[at : place + 1])
        at, inside = place, bool(came_in[i])
    if not inside:
        frame.append(data[at:])
    starts = np.flatnonzero((depths == _RECORD) & read.opens & read.curly)
    ends = np.flatnonzero((depths == _INSIDE) & ~read.opens)
    lists = np.cumsum(came_in)
    following = np.searchsorted(ends, starts)
    records = []
    for i, nth in zip(starts.tolist(), following.tolist()):
        place = int(read.places[i])
        if nth < len(ends):
            text = data[place : int(read.places[ends[nth]]) + 1]
        else:
            end = _STARTS.index((read.in_string, read.escaped))
            deep = depth + int(read.steps.sum())
            text = data[place:] + _rest_of_record(uri, start + len(data), end, deep, ahead)
        records.append((int(lists[i]), start + place, text))
    return b"".join(frame), int(came_in.sum()), records


def _ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    found = spark.read.format("binaryFile").load(path).select(F.col("path").alias("uri"), "length")
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("bigint"))
    each = found.select("uri", F.explode(starts).alias("start"), F.lit(size).alias("size"))
    return spread(each, "uri", "start")


def _begins(frame: pd.DataFrame) -> pd.DataFrame:
    """Put the summaries of one file together: how each of its ranges begins."""
    way, depth, rows = 0, 0, []
    for row in frame.sort_values("start").itertuples(index=False):
        rows.append((row.uri, row.start, way, depth))
        way, deeper = ((row.way_0, row.deep_0), (row.way_1, row.deep_1), (row.way_2, row.deep_2))[way]
        depth += deeper
    if (way, depth) != (0, 0):
        raise ValueError(f"{rows[0][0]}: not a whole JSON document")
    return pd.DataFrame(rows, columns=["uri", "start", "way", "depth"])


_PIECES = "uri string, start bigint, place bigint, lists bigint, text binary"


def split_documents(spark: SparkSession, path: str, size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Frames ``(uri, frame)`` and records ``(uri, section, place, record)`` of the JSON files at ``path``.

    ``section`` is the name of the record's list, ``place`` its byte offset.  Scalars come from a file's frame with the lists left empty.
    """
    ranges = written(_ranges(spark, path, size), "ranges")

    def sum_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(uri, start, *sum(summed_up(_read(uri, start, n)), ())) for uri, start, n in frame[["uri", "start", "size"]].itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["uri", "start", "way_0", "deep_0", "way_1", "deep_1", "way_2", "deep_2"])

    summaries = ranges.mapInPandas(
        sum_up, "uri string, start bigint, way_0 int, deep_0 bigint, way_1 int, deep_1 bigint, way_2 int, deep_2 bigint"
    )
    # A file of a terabyte has 131,072 ranges of 8 MB here, some dozen bytes each.
    begins = summaries.groupBy("uri").applyInPandas(_begins, "uri string, start bigint, way int, depth bigint")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri, start, n, way, depth in frame[["uri", "start", "size", "way", "depth"]].itertuples(index=False):
                kept, lists, records = cut(uri, start, _read(uri, start, n), way, depth)
                yield pd.DataFrame([(uri, start, None, lists, kept)], columns=["uri", "start", "place", "lists", "text"]).astype({"place": "Int64"})
                for at in range(0, len(records), 1000):
                    rows = [(uri, start, place, before, text) for before, place, text in records[at : at + 1000]]
                    yield pd.DataFrame(rows, columns=["uri", "start", "place", "lists", "text"]).astype({"place": "Int64"})

    pieces = written(spread(ranges.join(begins, ["uri", "start"]), "uri", "start").mapInPandas(read, _PIECES), "pieces")

    def framed(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values("start")
        text = b"".join(ordered["text"]).decode()
        pairs = json.loads(text, object_pairs_hook=tuple)
        if not isinstance(pairs, tuple):
            raise ValueError(f"{frame['uri'].iloc[0]}: not a JSON object")
        # Objects are counted as well, but what is in them is no record.
        names = [name if isinstance(value, list) else None for name, value in pairs if isinstance(value, (list, tuple))]
        before = ordered["lists"].cumsum() - ordered["lists"]
        return pd.DataFrame({"uri": ordered["uri"], "start": ordered["start"], "before": before, "frame": text, "names": [names] * len(ordered)})

    shapes = written(
        pieces.where(F.col("place").isNull()).groupBy("uri").applyInPandas(framed, "uri string, start bigint, before bigint, frame string, names array<string>"),
        "frames",
    )
    found = pieces.where(F.col("place").isNotNull()).join(shapes.select("uri", "start", "before", "names"), ["uri", "start"])
    section = F.element_at("names", (F.col("before") + F.col("lists")).cast("int"))
    records = found.select("uri", section.alias("section"), "place", F.decode("text", "UTF-8").alias("record"))
    return shapes.where("start = 0").select("uri", "frame"), records


def read_split_documents(
    spark: SparkSession, path: str, schema: T.StructType, section: str = "functions", size: int = RANGE, places: bool = False
) -> DataFrame:
    """What ``documents.read_documents`` gives of the same files: scalars of the document and the fields of each record.

    With ``places`` the record's ``uri`` and ``place`` too.
    """
    scalars = T.StructType([f for f in schema if f.name != section])
    frames, records = split_documents(spark, path, size)
    heads = frames.select("uri", F.from_json("frame", scalars, {"mode": "FAILFAST"}).alias("_head"))
    items = records.where(F.col("section") == section).select(
        "uri", "place", F.from_json("record", schema[section].dataType.elementType, {"mode": "FAILFAST"}).alias("_item")
    )
    own = ["uri", "place"] if places else []
    return items.join(heads, "uri").select(*own, "_head.*", "_item.*")
