"""Function catalogue: one row per function of every source file.

The Python grammar is a per-file helper inside ``mapInPandas``; the spread over
tasks, the joins and the numbering are Spark's.  Corpus code is parsed, never run.
"""

from __future__ import annotations

import ast
import concurrent.futures
import sys
import threading
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thriftline import schemas
from thriftline.functions import paths

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_PARSE_ERRORS = (SyntaxError, ValueError, RecursionError, MemoryError)


def _parse(text: str) -> tuple[ast.Module | None, str | None]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(text), None
        except _PARSE_ERRORS as error:
            return None, f"{type(error).__name__}: {error}"


def _positional_count(function: ast.AST) -> int:
    """Positional parameters of the first plain ``def`` of that name, breadth first; else 1."""
    for node in ast.walk(function):
        if isinstance(node, ast.FunctionDef) and node.name == function.name:
            return len(node.args.args)
    return 1


def _definitions(module: ast.Module) -> Iterator[tuple[str, ast.AST]]:
    """Qualified name and node of functions reached through class and function bodies."""
    pending = [("", child) for child in reversed(list(ast.iter_child_nodes(module)))]
    while pending:
        prefix, node = pending.pop()
        if isinstance(node, (ast.ClassDef, *_FUNCTIONS)):
            name = f"{prefix}{node.name}"
            if isinstance(node, _FUNCTIONS):
                yield name, node
            below = reversed(list(ast.iter_child_nodes(node)))
            pending.extend((f"{name}.", child) for child in below)


_DEEP = 100_000


class _Writer(ast._Unparser):
    """What ``ast.unparse`` writes, with a chain of operators as a loop and methods looked up once for each kind of node."""

    #: Kind of operator to its text, its own precedence and those of its sides.
    _sides = {
        getattr(ast, kind): (
            f" {sign} ", own, own.next() if sign in ast._Unparser.binop_rassoc else own,
            own if sign in ast._Unparser.binop_rassoc else own.next(),
        )
        for kind, sign in ast._Unparser.binop.items()
        for own in [ast._Unparser.binop_precedence[sign]]
    }

    def __init__(self):
        super().__init__()
        self._visitors = {}

    def traverse(self, node):
        if isinstance(node, list):
            for item in node:
                self.traverse(item)
            return
        visitor = self._visitors.get(node.__class__)
        if visitor is None:
            visitor = self._visitors[node.__class__] = getattr(self, f"visit_{node.__class__.__name__}", self.generic_visit)
        visitor(node)

    def visit_BinOp(self, node):
        pending = []
        above = self.get_precedence(node)
        while node.__class__ is ast.BinOp:
            sign, own, left, right = self._sides[node.op.__class__]
            if above > own:
                self._source.append("(")
            pending.append((sign, node.right, right, above > own))
            node, above = node.left, left
        self.set_precedence(above, node)
        self.traverse(node)
        for sign, node, above, closed in reversed(pending):
            self._source.append(sign)
            if node.__class__ is ast.Name:
                self._source.append(node.id)
            else:
                self.set_precedence(above, node)
                self.traverse(node)
            if closed:
                self._source.append(")")


def _unparse(function: ast.AST) -> tuple[str | None, str | None]:
    """Code of a function, or why it cannot be written out."""
    limit = sys.getrecursionlimit()
    try:
        sys.setrecursionlimit(max(limit, _DEEP))
        return _Writer().visit(function), None
    except (RecursionError, MemoryError, ValueError) as error:
        return None, f"{type(error).__name__}: {error}"
    finally:
        sys.setrecursionlimit(limit)


def _on_deep_stack(work: Callable[[], list[tuple]]) -> list[tuple]:
    """Run ``work`` where deep expressions fit on the stack."""
    before = threading.stack_size(512 << 20)
    try:
        with concurrent.futures.ThreadPoolExecutor(1) as pool:
            return pool.submit(work).result()
    finally:
        threading.stack_size(before)


def _texts(files: DataFrame) -> DataFrame:
    """The columns the parser needs."""
    return files.select("project", "file", "text")


#: Characters of text whose catalogue is held as rows.
_SLICE = 4 << 20


def _slices(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A frame in stretches of about ``_SLICE`` characters of text; catalogues may be larger than the text they come from."""
    stretch = (frame["text"].str.len().fillna(0).add(100).cumsum() // _SLICE).to_numpy()
    for _, part in frame.groupby(stretch, sort=False):
        yield part


def _catalogue_rows(frame: pd.DataFrame) -> list[tuple]:
    rows = []
    for project, file, text in frame.itertuples(index=False):
        module, error = _parse(text)
        if module is None:
            rows.append((project, file, None, None, None, None, None, None, None, error))
            continue
        for qualified, node in _definitions(module):
            code, error = _unparse(node)
            rows.append(
                (
                    project, file, node.name, qualified, node.lineno, node.end_lineno or node.lineno,
                    qualified.count("."), _positional_count(node), code, error,
                )
            )
    return rows


def extract_functions(files: DataFrame) -> DataFrame:
    """Catalogue of ``files(project, file, text)``.

    A file that does not parse gives one row with ``error`` and no function, a function
    that cannot be written out one with its name and ``error``; see :func:`catalogue` and
    :func:`unparsable`.  A ``def`` below ``if``, ``try`` or
    ``with`` is not part of the catalogue.
    """
    columns = ["project", "file", "name", "qualified_name", "line", "end_line", "depth", "n_args", "function_code", "error"]

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (part for frame in frames for part in _slices(frame)):
            rows = _on_deep_stack(lambda part=part: _catalogue_rows(part))
            yield _typed(pd.DataFrame(rows, columns=columns), ["line", "end_line", "depth", "n_args"])

    schema = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in (schemas.FUNCTION[c] for c in columns)
    )
    rows = _texts(files).mapInPandas(extract, schema=schema)
    named = F.when(
        F.col("qualified_name").isNotNull(),
        paths.function_id(paths.module_name(F.col("file")), F.col("qualified_name")),
    )
    return rows.withColumn("id", named).select(*schemas.FUNCTION.names)


def _typed(frame: pd.DataFrame, integers: list[str]) -> pd.DataFrame:
    return frame.astype({name: "Int32" for name in integers})


def catalogue(extracted: DataFrame) -> DataFrame:
    return extracted.filter(F.col("error").isNull()).drop("error")


def unparsable(extracted: DataFrame) -> DataFrame:
    """Files and functions that are not in the catalogue, with the reason."""
    return extracted.filter(F.col("error").isNotNull()).select("project", "file", "qualified_name", "error")


def _lookup_rows(module: ast.Module) -> Iterator[tuple[str, bool, int, int]]:
    """First node per lookup name, once for any depth and once for direct members only."""
    anywhere: dict[str, ast.AST] = {}
    direct: dict[str, ast.AST] = {}
    for node in ast.walk(module):
        if isinstance(node, _FUNCTIONS):
            anywhere.setdefault(node.name, node)
        elif isinstance(node, ast.ClassDef):
            for inner in ast.walk(node):
                if isinstance(inner, _FUNCTIONS):
                    anywhere.setdefault(f"{node.name}.{inner.name}", inner)
    for node in module.body:
        if isinstance(node, _FUNCTIONS):
            direct.setdefault(node.name, node)
        elif isinstance(node, ast.ClassDef):
            for inner in node.body:
                if isinstance(inner, _FUNCTIONS):
                    direct.setdefault(f"{node.name}.{inner.name}", inner)
    for is_direct, found in ((False, anywhere), (True, direct)):
        for name, node in found.items():
            yield name, is_direct, node.lineno, node.end_lineno or node.lineno


def locator_index(files: DataFrame) -> DataFrame:
    """Line range per name that a request may use: ``f`` or ``Class.f``.

    ``direct`` rows hold top-level functions and direct class members only; the
    others the first match at any depth, breadth first.
    """
    columns = schemas.LOCATOR.names

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (part for frame in frames for part in _slices(frame)):
            rows = []
            for project, file, text in part.itertuples(index=False):
                module, error = _parse(text)
                if module is None:
                    rows.append((project, file, None, None, None, None, error))
                    continue
                rows.extend((project, file, *row, None) for row in _lookup_rows(module))
            yield _typed(pd.DataFrame(rows, columns=columns), ["line", "end_line"])

    return _texts(files).mapInPandas(index, schema=schemas.LOCATOR)


def locate(requests: DataFrame, files: DataFrame, how: str = "any") -> DataFrame:
    """Line range of each ``requests(project, file, qualified_name)``.

    ``how``: ``any`` takes the first match at any depth, ``direct`` top-level
    functions and direct class members, ``exact`` the catalogue entry of that
    qualified name (three and more name parts too): the one on the requested
    ``line`` if requests have that column, else the earliest.  Unmatched requests
    have a NULL ``end_line``.  Only requested files are parsed.
    """
    asked = requests.select("project", "file").distinct()
    wanted = files.join(asked, ["project", "file"], "left_semi")
    keys = ["project", "file", "qualified_name"]
    if how == "exact" and "line" in requests.columns:
        entries = catalogue(extract_functions(wanted))
        ends = entries.groupBy(*keys, "line").agg(F.max("end_line").alias("end_line"))
        return requests.drop("end_line").join(ends, [*keys, "line"], "left")
    if how == "exact":
        ranges = (
            catalogue(extract_functions(wanted))
            .groupBy(*keys)
            .agg(F.min("line").alias("line"), F.min_by("end_line", "line").alias("end_line"))
        )
    elif how in ("any", "direct"):
        ranges = (
            locator_index(wanted)
            .filter(F.col("lookup_name").isNotNull() & (F.col("direct") == F.lit(how == "direct")))
            .select("project", "file", F.col("lookup_name").alias("qualified_name"), "line", "end_line")
        )
    else:
        raise ValueError(f"unknown way to locate functions: {how}")
    return requests.drop("line", "end_line").join(ranges, keys, "left")


def locate_known(requests: DataFrame, functions: DataFrame) -> DataFrame:
    """Line range of each ``requests(project, file, qualified_name, line)`` from a catalogue that is there already.

    Numbers and names are joined; no text is read or parsed.
    """
    keys = ["project", "file", "qualified_name", "line"]
    ends = functions.groupBy(*keys).agg(F.max("end_line").alias("end_line"))
    return requests.drop("end_line").join(ends, keys, "left")


def located(matches: DataFrame) -> DataFrame:
    return matches.filter(F.col("end_line").isNotNull())


def not_located(matches: DataFrame) -> DataFrame:
    """Requests without a line range, with the reason."""
    return matches.filter(F.col("end_line").isNull()).drop("line", "end_line").withColumn(
        "reason", F.lit("function not found in file")
    )
