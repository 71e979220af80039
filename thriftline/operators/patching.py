"""Splicing accepted rewrites into file text by line range."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thriftline.functions import paths
from thriftline.functions import text as tx
from thriftline.functions.text import let
from thriftline.operators import overlaps
from thriftline.sources import decode

FILE = ["project", "file"]

Shift = Callable[[Column, Column], Column]


def by_first_line(code: Column, indent: Column) -> Column:
    """Move code to ``indent``, measured from its first non-blank line."""
    return tx.reindent(code, indent)


def by_common_margin(code: Column, indent: Column) -> Column:
    """Move code to as many blanks as ``indent`` is long, measured from its common margin."""
    return tx.dedent_indent(code, F.length(indent))


def by_file(results: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Accepted functions with their place in their file and the file's count.

    A group is one file's functions, so a plain window is enough.
    """
    whole = Window.partitionBy(*keys)
    place = F.row_number().over(whole.orderBy(*order)).cast("bigint")
    return results.withColumns({"position": place, "in_file": F.count(F.lit(1)).over(whole)})


def single_patches(patches: DataFrame, keys: list[str] = FILE) -> DataFrame:
    """One patch per line range: of several the one with the highest ``seq`` stays.

    After this a file has no more patches than functions, however often the same
    patch was sent.
    """
    return patches.groupBy(*keys, "start_line", "end_line").agg(
        F.max("seq").alias("seq"), F.max_by("code", "seq").alias("code")
    )


def with_overlap_flag(patches: DataFrame, keys: list[str] = FILE) -> DataFrame:
    """Add ``inner``: the patch overlaps one that stands, which is wider or starts earlier.

    A patch that overlaps only patches which do not stand is kept.  Ranges are unique
    per file here.
    """
    return overlaps.overlap_flags(patches, keys)


def outermost(patches: DataFrame, keys: list[str] = FILE) -> DataFrame:
    return with_overlap_flag(patches, keys).filter(~F.col("inner")).drop("inner")


def overlapped(patches: DataFrame, keys: list[str] = FILE) -> DataFrame:
    """Patches that are not applied, with the reason."""
    flagged = with_overlap_flag(single_patches(patches, keys), keys)
    return flagged.filter("inner").drop("inner").withColumn("reason", F.lit("overlaps a patch that stands"))


def uncovered_lines(lines: DataFrame, patches: DataFrame, keys: list[str], line: str = "line_no") -> DataFrame:
    """Lines that no patch replaces.

    Lines meet 64-line bins of their file, each with one mask of what is covered in it, so a file with very many lines or
    patches is dealt to many tasks and a line is compared once.
    """
    bins = overlaps.covered_lines(patches, keys).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("bin").alias("_bin"), "mask")
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    in_bin = F.floor(F.col(line).cast("bigint") / 64) == F.col("_bin")
    return lines.join(bins, [*same, in_bin, overlaps.is_covered(F.col(line), F.col("mask"))], "left_anti")


def splice(text: Column, patches: Column, shift: Shift = by_first_line) -> Column:
    """``text`` with the ranges of ``patches`` replaced.

    ``patches`` is an array of ``(start_line, end_line, code)``, sorted and without
    overlaps.  A replacement is moved by ``shift`` to the indent of the line it
    starts on; each of its lines ends with ``\\n``, kept lines stay as they are.
    """

    def pieces(bound: Column) -> Column:
        lines, found = bound["lines"], bound["patches"]

        def piece(patch: Column, at: Column) -> Column:
            done = F.coalesce(F.get(found, at - 1)["end_line"], F.lit(0))
            before = F.slice(lines, done + 1, F.greatest(patch["start_line"] - done - 1, F.lit(0)))
            indent = tx.leading_space(F.regexp_replace(F.get(lines, patch["start_line"] - 1), "\n", ""))
            body = let(shift(patch["code"], F.coalesce(indent, F.lit(""))), tx.split_lines)
            return F.concat(before, F.transform(body, lambda line: F.concat(line, F.lit("\n"))))

        end = F.get(found, F.size(found) - 1)["end_line"]
        rest = F.slice(lines, end + 1, F.size(lines))
        return F.array_join(F.concat(F.flatten(F.transform(found, piece)), rest), "")

    return let(F.struct(tx.keep_line_ends(text).alias("lines"), patches.alias("patches")), pieces)


def patches_per_file(patches: DataFrame, keys: list[str] = FILE) -> DataFrame:
    """Sorted patches of each file as one array, without repeats and inner ranges.

    They go into the row that holds the file's text, so which of them stand is found in that row.
    """
    in_order = F.sort_array(F.collect_list(F.struct("start_line", (-F.col("end_line")).alias("wider"), "end_line", "code")))
    grouped = single_patches(patches, keys).groupBy(*keys).agg(in_order.alias("_all"))
    flagged = grouped.withColumn("_stands", overlaps.stands_in_row("_all.start_line", "_all.end_line"))
    kept = F.filter("_all", lambda _, at: F.get("_stands", at))
    listed = F.transform(kept, lambda p: F.struct(p["start_line"].alias("start_line"), p["end_line"].alias("end_line"), p["code"].alias("code")))
    return flagged.select(*keys, listed.alias("patches"))


def patched_files(
    files: DataFrame, patches: DataFrame, keys: list[str] = FILE, shift: Shift = by_first_line
) -> DataFrame:
    """Files that have patches, with their new text.

    File text is shuffled once, by file, and never taken apart into line rows.
    """
    return files.join(patches_per_file(patches, keys), keys).withColumn(
        "text", splice(F.col("text"), F.col("patches"), shift)
    ).drop("patches")


def mirror(files: DataFrame, patches: DataFrame, keys: list[str] = FILE) -> DataFrame:
    """The whole tree without version-control folders, patched where there are patches."""
    kept = files.filter(paths.in_mirror(F.col("file")))
    joined = kept.join(patches_per_file(patches, keys), keys, "left")
    changed = F.col("patches").isNotNull()
    return joined.withColumns(
        {
            "text": F.when(changed, splice(F.col("text"), F.col("patches"))).otherwise(F.col("text")),
            "patched": changed,
        }
    ).drop("patches")


def mirror_content(files: DataFrame, patches: DataFrame, keys: list[str] = FILE) -> DataFrame:
    """:func:`mirror` over ``files(project, file, content)`` in bytes: only patched files are decoded, after the join.

    A patched file that is no text stays as it is.
    """
    kept = files.filter(paths.in_mirror(F.col("file")))
    joined = kept.join(patches_per_file(patches, keys), keys, "left")
    touched = joined.withColumn("_touched", F.when(F.col("patches").isNotNull(), F.col("content")))
    text = decode.decode(touched, "_touched")
    patched = F.col("patches").isNotNull() & F.col("text").isNotNull()
    changed = F.when(patched, F.encode(splice(F.col("text"), F.col("patches")), "UTF-8")).otherwise(F.col("content"))
    return text.select(*keys, changed.alias("content"), patched.alias("patched"))


def patch_rows(located: DataFrame, file: Column, code: str = "optimized_function_code", seq: str = "id") -> DataFrame:
    """Patches from located rewrites; of two for one range the higher ``seq`` will stand."""
    return located.select(
        "project",
        file.alias("file"),
        F.col("line").alias("start_line"),
        "end_line",
        F.col(code).alias("code"),
        F.col(seq).alias("seq"),
    )
