"""Source trees as a Spark data source: ``spark.read.format("source_tree").load(root)``.

The folders right below ``root`` are projects, every file below them is a row.  The options ``projects``, ``ends`` and
those named like the three flags narrow the scan: folders that they rule out are never listed, files that they rule out are never
opened.  They are options and not pushed filters because Spark 4.1 keeps a source's first reader with the DataFrame: a
filter taken by ``pushFilters`` went on acting on later queries over the same DataFrame, which lost rows.

The reader itself lists the first ``levels`` levels of each project and deals what it finds out to ``tasks`` chunks,
which walk on; so the driver holds the names of those levels only.  Where even these are too many, ``tree.list_tree`` lists in tasks
from the first level on.  Columns are not pushed down, so a scan of names sets ``content`` to ``false``.

Defined results: a missing root or one without folders has no rows; files right below ``root`` belong to no project and
are left out; names are bytes as stored, so ``__init__.py`` and ``_private.py`` are rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from thriftline import fixed_values as fixed
from thriftline.sources import files

FORMAT = "source_tree"
FLAGS = ("is_python", "excluded", "is_test")
BATCH_BYTES = 8 << 20
BATCH_ROWS = 10_000

# project, path in it, URI, is a folder, bytes
Entry = tuple[str, str, str, bool, int]


def flags_of(file: str) -> dict[str, bool]:
    """``FLAGS`` of a path, by the rules of ``functions.paths``."""
    lowered = file.lower()
    name = lowered.rsplit("/", 1)[-1]
    return {
        "is_python": file.endswith(".py"),
        "excluded": not set(fixed.EXCLUDED_PARTS).isdisjoint(file.split("/")),
        "is_test": not set(fixed.TEST_PARTS).isdisjoint(lowered.split("/"))
        or name.startswith(tuple(fixed.TEST_PREFIXES))
        or name.endswith(tuple(fixed.TEST_SUFFIXES)),
    }


class TreeReader(DataSourceReader):
    def __init__(
        self, root: str, levels: int, tasks: int, content: bool, projects: list[str] | None, ends: str, wanted: dict[str, bool]
    ):
        self.root, self.levels, self.tasks, self.content = root.rstrip("/"), levels, tasks, content
        self.projects, self.ends, self.wanted = projects, ends, wanted

    def _enters(self, name: str) -> bool:
        """Can anything below a folder of this name be wanted?"""
        return not (
            (self.wanted.get("excluded") is False and name in fixed.EXCLUDED_PARTS)
            or (self.wanted.get("is_test") is False and name.lower() in fixed.TEST_PARTS)
        )

    def _keeps(self, file: str) -> bool:
        found = flags_of(file)
        return file.endswith(self.ends) and all(found[flag] == value for flag, value in self.wanted.items())

    def _entries(self, project: str, file: str, uri: str) -> Iterator[Entry]:
        for name, folder, size in files.children(uri):
            below = f"{file}/{name}" if file else name
            if self._enters(name) if folder else self._keeps(below):
                yield project, below, f"{uri}/{name}", folder, size

    def partitions(self) -> list[InputPartition]:
        level: list[Entry] = [
            (name, "", f"{self.root}/{name}", True, 0)
            for name, folder, _ in sorted(files.children(self.root))
            if folder and (self.projects is None or name in self.projects)
        ]
        for _ in range(self.levels):
            level = [below for e in level for below in (self._entries(*e[:3]) if e[3] else (e,))]
        # Folders first, then files by size, so that dealing them in turn evens chunks out.
        level.sort(key=lambda e: (not e[3], -e[4]))
        return [InputPartition(level[n :: self.tasks]) for n in range(min(self.tasks, len(level)))] or [InputPartition([])]

    def _walk(self, entries: list[Entry]) -> Iterator[Entry]:
        # Folders wait by name; files are not held.
        pending = list(entries)
        while pending:
            entry = pending.pop()
            if not entry[3]:
                yield entry
                continue
            for below in self._entries(*entry[:3]):
                if below[3]:
                    pending.append(below)
                else:
                    yield below

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("project", pa.string()), ("file", pa.string()), ("n_bytes", pa.int64()), *((f, pa.bool_()) for f in FLAGS)]
            + ([("content", pa.binary())] if self.content else [])
        )
        rows, held = [], 0
        for project, file, uri, _, size in self._walk(partition.value):
            row = {"project": project, "file": file, "n_bytes": size, **flags_of(file)}
            if self.content:
                row["content"] = files.read_bytes(uri)
                row["n_bytes"] = len(row["content"])
                held += row["n_bytes"]
            rows.append(row)
            if held >= BATCH_BYTES or len(rows) == BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class SourceTree(DataSource):
    """Options: ``path`` (the root), ``levels`` listed by the reader (1), ``tasks`` (64), ``content`` (true), and what narrows
    the scan: ``projects`` (a JSON list), ``ends`` (the end of the path), ``is_python``, ``excluded``, ``is_test``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _content(self) -> bool:
        return _truth(self.options.get("content", "true"))

    def schema(self) -> str:
        flags = ", ".join(f"{f} boolean" for f in FLAGS)
        return f"project string, file string, n_bytes bigint, {flags}" + (", content binary" if self._content() else "")

    def reader(self, schema) -> TreeReader:
        levels, tasks = int(self.options.get("levels", 1)), int(self.options.get("tasks", 64))
        if "path" not in self.options or levels < 0 or tasks < 1:
            raise ValueError(f"{FORMAT} needs a path, levels of 0 or more and tasks of 1 or more")
        projects = json.loads(self.options["projects"]) if "projects" in self.options else None
        wanted = {flag: _truth(self.options[flag]) for flag in FLAGS if flag in self.options}
        return TreeReader(self.options["path"], levels, tasks, self._content(), projects, self.options.get("ends", ""), wanted)


def _truth(word: str) -> bool:
    if word.lower() not in ("true", "false"):
        raise ValueError(f"{FORMAT}: {word!r} is neither true nor false")
    return word.lower() == "true"


def open_tree(spark: SparkSession, root: str, projects: list[str] | None = None, **options: object) -> DataFrame:
    """Register the format with the session and open a tree."""
    spark.dataSource.register(SourceTree)
    named = {} if projects is None else {"projects": json.dumps(projects)}
    return spark.read.format(FORMAT).options(**options, **named).load(root)
