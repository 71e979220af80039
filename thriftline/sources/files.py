"""Opening storage URIs inside tasks (local, HDFS and object stores)."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyarrow import fs

# Schemes that Spark and Arrow spell differently.
_SAME_STORE = {"s3a": "s3", "s3n": "s3"}


_OPENED: dict[str, tuple[fs.FileSystem, str]] = {}


def _store(root: str) -> tuple[fs.FileSystem, str]:
    """File system behind ``scheme://authority``, opened once per worker."""
    if root not in _OPENED:
        _OPENED[root] = fs.FileSystem.from_uri(root)
    return _OPENED[root]


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI as Spark prints it; a bare path is local.

    Only scheme and authority are read as a URI: names may hold ``%``, ``#`` and blanks.
    """
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    scheme, found, rest = uri.partition("://")
    if not found:
        return fs.LocalFileSystem(), uri
    authority, _, key = rest.partition("/")
    system, base = _store(f"{_SAME_STORE.get(scheme, scheme)}://{authority}")
    return system, f"{base.rstrip('/')}/{key}"


def children(uri: str) -> Iterator[tuple[str, bool, int]]:
    """Name, is-folder and size of the entries of one folder, in no order; of a local folder they are not held."""
    system, path = locate(uri)
    if not isinstance(system, fs.LocalFileSystem):
        found = system.get_file_info(fs.FileSelector(path, recursive=False, allow_not_found=True))
        yield from ((e.base_name, e.type == fs.FileType.Directory, e.size or 0) for e in found)
    elif os.path.exists(path):
        with os.scandir(path) as folder:
            for e in folder:
                is_dir = e.is_dir()
                yield e.name, is_dir, e.stat().st_size if not is_dir and e.is_file() else 0


def read_bytes(uri: str) -> bytes:
    system, path = locate(uri)
    with system.open_input_stream(path) as stream:
        return stream.read()


def write_bytes(uri: str, content: bytes, attempt: str) -> None:
    """Write under a name of this attempt, then move into place.

    A task that is run twice leaves one whole file.
    """
    system, path = locate(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    pending = f"{path}.{attempt}"
    with system.open_output_stream(pending) as stream:
        stream.write(content)
    system.move(pending, path)
