"""Zip archives of projects, expanded into their members.

``read_archives`` lists members from the central directories first and then
spreads the members over tasks by their bytes, so one huge archive is read by many tasks and
all of them have about as much to read.  ``read_pieces`` cuts large members as well.
``expand_archives`` works on a table that already holds the archive bytes.
"""

from __future__ import annotations

import io
import itertools
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thriftline import schemas
from thriftline.operators.running import running_total
from thriftline.session import slots, spread
from thriftline.sources import files, tree

_BATCH_BYTES = 64 << 20
#: Bytes of a frame of members, and what a row takes besides its content.
_FRAME_BYTES, _ROW_BYTES = 8 << 20, 500

# Faults of an archive itself.  Failures of the storage are not among them: those
# fail the task, which is then run again.
_BAD_ARCHIVE = (zipfile.BadZipFile, ValueError, RuntimeError, NotImplementedError, EOFError, zlib.error)


def _safe_name(name: str) -> str:
    """Member name as a relative path that cannot leave the target folder."""
    return "/".join(part for part in name.split("/") if part not in ("", ".", ".."))


def _members(archive: zipfile.ZipFile) -> Iterator[tuple[int, str, zipfile.ZipInfo]]:
    for position, info in enumerate(archive.infolist()):
        if not info.is_dir():
            yield position, _safe_name(info.filename), info


def _in_batches(rows: Iterator[tuple], columns: list[str], weight: int) -> Iterator[pd.DataFrame]:
    """Group rows into frames of bounded size; ``weight`` is the index of a bytes column."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight] or b"") + _ROW_BYTES
        if size >= _FRAME_BYTES:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def _by_archive(frame: pd.DataFrame, columns: list[str], order: list[str]) -> Iterator[tuple[str, list[tuple]]]:
    """Archives of a frame and what of ``columns`` their rows hold, in ``order``; sorted once, as frames may hold thousands of archives."""
    rows = frame.sort_values(["archive", *order])[["archive", *columns]].itertuples(index=False, name=None)
    for uri, group in itertools.groupby(rows, key=lambda row: row[0]):
        yield uri, [row[1:] for row in group]


def expand_archives(archives: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Members of archives held as bytes; a bad archive gives one row with ``error``.

    Of members with the same name the last one wins, as it would on disk.
    """
    columns = schemas.ARCHIVE_MEMBER.names

    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for frame in frames:
                for name, blob in zip(frame["path"], frame["content"]):
                    try:
                        with zipfile.ZipFile(io.BytesIO(blob)) as archive:
                            last = {member: info for _, member, info in _members(archive)}
                            for member, info in last.items():
                                data = archive.read(info)
                                yield name, member, len(data), data, None
                    except _BAD_ARCHIVE as error:
                        yield name, None, None, None, str(error)

        yield from _in_batches(rows(), columns, 3)

    narrow = archives.select(F.col(path).alias("path"), F.col(content).alias("content"))
    return narrow.mapInPandas(expand, schema=schemas.ARCHIVE_MEMBER)


def list_members(archives: DataFrame) -> DataFrame:
    """Central directories of the archives named in column ``path``; no member is read.

    Of members with the same name the last position stays, as it would on disk.
    """
    columns = ["archive", "position", "file", "n_bytes", "stored", "error"]

    def listing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for frame in frames:
                for uri in frame["path"]:
                    try:
                        system, path = files.locate(uri)
                        with system.open_input_file(path) as stream, zipfile.ZipFile(stream) as archive:
                            for position, member, info in _members(archive):
                                plain = info.compress_type == zipfile.ZIP_STORED and not info.flag_bits & 1
                                yield uri, position, member, info.file_size, plain, None
                    except _BAD_ARCHIVE as error:
                        yield uri, None, None, None, None, str(error)

        found = rows()
        while held := list(itertools.islice(found, 50_000)):
            yield pd.DataFrame(held, columns=columns).astype(
                {"position": "Int64", "n_bytes": "Int64", "stored": "boolean"}
            )

    schema = "archive string, position bigint, file string, n_bytes bigint, stored boolean, error string"
    listed = archives.select("path").mapInPandas(listing, schema=schema)
    return listed.groupBy("archive", "file").agg(
        F.max("position").alias("position"),
        F.max_by("n_bytes", "position").alias("n_bytes"),
        F.max_by("stored", "position").alias("stored"),
        F.max("error").alias("error"),
    )


def _is_wanted(name: str, is_folder: bool, n_bytes: int) -> bool:
    """Archives with bytes in them, and folders; not what Spark's readers hide."""
    hidden = name.startswith(".") or (name.startswith("_") and "=" not in name)
    if is_folder:
        return not (hidden or name.endswith("._COPYING_")) or name.startswith(("_metadata", "_common_metadata"))
    return name.endswith(".zip") and n_bytes > 0 and not hidden


def _named(spark: SparkSession, path: str) -> list[tuple[str, str, bool, int]]:
    """What a path, or a pattern of paths, names: URI as Spark spells it, name, is-folder and size."""
    given = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = given.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    where = store.makeQualified(given)
    found = store.globStatus(where)
    if not found:
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {where.toString()}.")
    return [(e.getPath().toString(), e.getPath().getName(), e.isDirectory(), e.getLen()) for e in found]


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """Members of every archive below ``path``.

    Tasks list the folders, as ``binaryFile`` would keep every name in the driver; then a fixed number of them opens the archives.
    """
    named = _named(spark, path)
    folders = spark.createDataFrame([("", uri) for uri, _, is_folder, _ in named if is_folder], "project string, uri string")
    alone = [(uri,) for uri, *entry in named if not entry[1] and _is_wanted(*entry)]
    below = tree.list_tree(spark, folders, wanted=_is_wanted).select(F.col("uri").alias("path"))
    return list_members(spread(below.unionByName(spark.createDataFrame(alone, "path string")), "path"))


#: What opening a member costs, in bytes read.
MEMBER_COST = 512


def with_loads(units: DataFrame, tasks: int, order: list[str], n_bytes: str = "n_bytes") -> DataFrame:
    """Add ``load``: units in order, cut into ``tasks`` stretches of about the same number of bytes.

    A load has at most the mean and the unit that begins in it.
    """
    weight = F.coalesce(F.col(n_bytes), F.lit(0)) + MEMBER_COST
    placed = running_total(units, [], [F.col(c) for c in order], weight, "_before", "_total")
    share = F.ceil(F.col("_total").cast("decimal(20,0)") / tasks).cast("bigint")
    return placed.withColumn("load", F.floor(F.col("_before") / share).cast("int")).drop("_before", "_total")


def fetch_members(listed: DataFrame, tasks: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Content of listed members; columns in ``keep`` (text) come along, ``load`` too if it is among them.

    Members are dealt out by their bytes in the order of archive and position, so the members of one
    large archive are read by many tasks.  Filter ``listed`` first: what is not in
    it is never read.
    """
    tasks = tasks or slots(listed.sparkSession)
    keep = keep or []
    own = schemas.ARCHIVE_MEMBER.names

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for frame in frames:
                for uri, group in _by_archive(frame, ["error", "position", "file", *keep], ["position"]):
                    for error in (row[0] for row in group if not pd.isna(row[0])):
                        yield uri, None, None, None, error, *[None] * len(keep)
                    good = [row[1:] for row in group if pd.isna(row[0])]
                    if not good:
                        continue
                    system, inner = files.locate(uri)
                    with system.open_input_file(inner) as stream, zipfile.ZipFile(stream) as archive:
                        infos = archive.infolist()
                        for position, member, *kept in good:
                            try:
                                data = archive.read(infos[int(position)])
                                yield uri, member, len(data), data, None, *kept
                            except _BAD_ARCHIVE as error:
                                yield uri, member, None, None, str(error), *kept

        yield from _in_batches(rows(), [*own, *keep], 3)

    carried = [name for name in keep if name != "load"]
    narrow = listed.select("archive", "position", "file", "n_bytes", "error", *carried)
    loaded = with_loads(narrow, tasks, ["archive", "position", "file"])
    dealt = loaded.repartitionById(tasks, "load").withColumn("load", F.col("load").cast("string"))
    schema = T.StructType([*schemas.ARCHIVE_MEMBER.fields, *[T.StructField(name, T.StringType()) for name in keep]])
    return dealt.mapInPandas(fetch, schema=schema)


_PIECE = T.StructType(
    [
        T.StructField("archive", T.StringType()), T.StructField("file", T.StringType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("start", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType()),
    ]
)


def fetch_pieces(listed: DataFrame, tasks: int | None = None, piece: int = _BATCH_BYTES) -> DataFrame:
    """Content of listed members in pieces of at most ``piece`` bytes: ``archive, file, n_bytes, start, content, error``.

    A member that is stored as it is can be read anywhere, so its pieces go to different tasks (and its checksum is
    not looked at); a compressed one has to be read from its start and is one task's, piece by piece.  Either way no
    task holds more than a piece.  An empty member is one empty piece.
    """
    tasks = tasks or slots(listed.sparkSession)
    whole = F.coalesce(F.col("n_bytes"), F.lit(0))
    starts = F.when(F.col("stored") & (whole > piece), F.sequence(F.lit(0).cast("bigint"), whole - 1, F.lit(piece).cast("bigint")))
    units = listed.select("archive", "position", "file", "n_bytes", "error", F.explode(F.coalesce(starts, F.array(F.lit(-1).cast("bigint")))).alias("from"))
    size = F.when(F.col("from") < 0, whole).otherwise(F.least(F.lit(piece).cast("bigint"), whole - F.col("from")))
    order = ["archive", "position", "file", "from"]
    dealt = with_loads(units.withColumn("size", size), tasks, order, "size").repartitionById(tasks, "load")

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for frame in frames:
                for uri, group in _by_archive(frame, ["error", "position", "file", "from"], ["position", "from"]):
                    for error in (row[0] for row in group if not pd.isna(row[0])):
                        yield uri, None, None, None, None, error
                    good = [row[1:] for row in group if pd.isna(row[0])]
                    if not good:
                        continue
                    system, inner = files.locate(uri)
                    with system.open_input_file(inner) as stream, zipfile.ZipFile(stream) as archive:
                        infos = archive.infolist()
                        for position, member, first in good:
                            info = infos[int(position)]
                            try:
                                with archive.open(info) as source:
                                    at = max(int(first), 0)
                                    source.seek(at)
                                    while (data := source.read(piece)) or at == 0:
                                        yield uri, member, info.file_size, at, data, None
                                        at += len(data)
                                        if first >= 0 or not data:
                                            break
                            except _BAD_ARCHIVE as error:
                                yield uri, member, info.file_size, None, None, str(error)

        yield from _in_batches(rows(), _PIECE.names, 4)

    return dealt.select("archive", "position", "file", "from", "error").mapInPandas(fetch, schema=_PIECE)


def read_pieces(spark: SparkSession, path: str, tasks: int | None = None, piece: int = _BATCH_BYTES) -> DataFrame:
    """Members of every archive below ``path`` in pieces; see :func:`fetch_pieces`."""
    return fetch_pieces(list_archives(spark, path), tasks, piece)


def read_archives(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """Members of every archive below ``path``, read in parallel within each archive."""
    return fetch_members(list_archives(spark, path), tasks)
