"""The three phases over any number of projects at once.

The phases hand tables to each other.  Pass each through ``session.written`` (or
save it where it belongs) when more than one later step reads it.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftline.functions import paths
from thriftline.operators import catalog, generated, measuring, outcome, patching, routing
from thriftline.session import written
from thriftline.sources import archives, decode, projects, tree

KEYS = ["project", "id", "line"]


def open_projects(spark: SparkSession, path: str) -> DataFrame:
    """Files of every archive below ``path``, placed as by :func:`project_files`.

    Roots are found from the listings, so no content is shuffled.
    """
    listed = written(archives.list_archives(spark, path), "listing")
    roots = written(projects.find_project_roots(listed.filter(F.col("error").isNull())), "roots")
    # Both sides are tables, so Spark can split an archive that holds much of the corpus.
    rooted = listed.join(roots, "archive", "left")
    members = archives.fetch_members(rooted, keep=["root"]).filter(F.col("error").isNull())
    return _placed(members.withColumnRenamed("file", "archive_file"))


def project_files(members: DataFrame) -> DataFrame:
    """Files of expanded archives: ``project`` is the archive, ``file`` relative to its project root.

    ``project_rel`` is that root and ``archive_file`` the path in the archive.
    """
    whole = members.filter(F.col("error").isNull()).select("archive", F.col("file").alias("archive_file"), "content")
    roots = written(projects.find_project_roots(whole.select("archive", F.col("archive_file").alias("file"))), "roots")
    return _placed(whole.join(roots, "archive"))


def _placed(placed: DataFrame) -> DataFrame:
    prefix = F.concat(F.col("root"), F.lit("/"))
    inside = (F.col("root") == "") | F.startswith(F.col("archive_file"), prefix)
    relative = F.when(F.col("root") == "", F.col("archive_file")).when(
        inside, F.substring(F.col("archive_file"), F.length("root") + 2, F.length("archive_file"))
    )
    return placed.select(
        F.col("archive").alias("project"),
        F.col("root").alias("project_rel"),
        "archive_file",
        relative.alias("file"),
        "content",
    )


def extracted_of(files: DataFrame) -> DataFrame:
    """Phase one: functions of decoded source files, and error rows for what does not parse."""
    sources = tree.keep_source_files(files.filter(F.col("file").isNotNull()))
    return catalog.extract_functions(decode.accepted(decode.decode(sources)))


def functions_of(files: DataFrame) -> DataFrame:
    """The function catalogue of decoded source files."""
    return catalog.catalogue(extracted_of(files))


def results_of(
    functions: DataFrame,
    files: DataFrame,
    responses: DataFrame,
    baseline_log: DataFrame,
    attempts: DataFrame,
    codes: DataFrame,
    run_ends: DataFrame | None = None,
    mode: str = outcome.STRICT,
) -> DataFrame:
    """Phases one and two: specs, routing, baselines, attempts, result records.

    All inputs but ``files`` are keyed by ``project, id, line``; ``baseline_log``
    has ``run_id, seq, log_line`` besides, ``run_ends`` has ``elapsed_s, error_text``.
    """
    specs = generated.check_generated(responses)
    # Whether a file is there is found out on narrow keys; the wide rows stay partitioned by KEYS throughout.
    present = routing.with_source_flag(functions.select(*KEYS, "file"), files, ["project", "file"])
    flags = present.groupBy(*KEYS).agg(F.bool_or("has_source").alias("has_source"))
    routed = routing.routed(generated.attach_specs(functions, specs, KEYS).join(flags, KEYS, "left"))
    if run_ends is not None:
        routed = routing.with_failures(routed, run_ends, KEYS)
    skipped = routing.skipped_records(routed, ["project", "line"])
    work = routing.eligible(routed).drop("skip_reason")
    runs = measuring.parse_runs(baseline_log, [*KEYS, "run_id"], text="log_line")
    measured = measuring.baselines(work, runs, KEYS)
    decided = outcome.resolve(measured, attempts, KEYS, mode=mode)
    coded = outcome.with_winning_code(decided, codes, KEYS)
    return routing.all_records(skipped, routing.final_records(coded, ["project", "line"]))


_WIN = ["project", "file", "id", "line", "qualified_name", "optimized_function_code"]


def _rewrites(results: DataFrame, texts: DataFrame, how: str) -> DataFrame:
    """Accepted rewrites with their line ranges in decoded files."""
    return catalog.located(catalog.locate(routing.rewrites(results).select(*_WIN), texts, how))


def _ranges(results: DataFrame, files: DataFrame, functions: DataFrame | None, how: str) -> DataFrame:
    """Accepted rewrites with line ranges, NULL where there is none."""
    wins = routing.rewrites(results).select(*_WIN)
    if functions is not None and how == "exact":
        return catalog.locate_known(wins, functions)
    texts = decode.decode(files).filter(F.col("text").isNotNull() & F.col("file").isNotNull())
    return catalog.locate(wins, texts.select("project", "file", "text"), how)


def mirrored(results: DataFrame, files: DataFrame, how: str = "exact", functions: DataFrame | None = None) -> DataFrame:
    """Phase three: the archive's tree with accepted rewrites spliced in.

    With the catalogue of phase one in ``functions`` nothing is parsed again; contents cross the
    network once and only patched files are decoded.
    """
    roots = written(files.select("project", "project_rel").distinct(), "roots")
    placed = catalog.located(_ranges(results, files, functions, how)).join(roots, "project")
    patches = patching.patch_rows(placed, paths.rebase(F.col("project_rel"), F.col("file")))
    whole = files.select("project", F.col("archive_file").alias("file"), "content")
    return patching.mirror_content(whole, patches)


def rejects(
    results: DataFrame, files: DataFrame, extracted: DataFrame, members: DataFrame | None = None, how: str = "exact"
) -> DataFrame:
    """``(project, file, name, reason)`` of everything the phases left out.

    Archives and members that cannot be read (of ``members``), source files that are no text, files and
    functions that do not parse (of ``extracted``, the output of ``catalog.extract_functions``), accepted rewrites
    whose file is not there or in which they were not found, and rewrites that overlap others.
    """
    none = F.lit(None).cast("string")
    sources = tree.keep_source_files(files.filter(F.col("file").isNotNull()))
    undecoded = decode.rejected(decode.decode(sources), ["project", "file"]).withColumn("name", none)
    unparsed = catalog.unparsable(extracted).select("project", "file", F.col("qualified_name").alias("name"), F.col("error").alias("reason"))
    wins = routing.rewrites(results).select(*_WIN)
    lost = routing.missing_targets(wins, files.filter(F.col("file").isNotNull()))
    here = wins.join(files.select("project", "file"), ["project", "file"], "left_semi")
    ranges = catalog.locate_known(here, catalog.catalogue(extracted)) if how == "exact" else _ranges(here, files, None, how)
    unfound = catalog.not_located(ranges)
    patches = patching.patch_rows(catalog.located(ranges), F.col("file"))
    inner = patching.overlapped(patches).select("project", "file", F.col("seq").alias("name"), "reason")
    parts = [undecoded, unparsed, inner, *(d.select("project", "file", F.col("qualified_name").alias("name"), "reason") for d in (lost, unfound))]
    if members is not None:
        bad = members.filter(F.col("error").isNotNull())
        parts.append(bad.select(F.col("archive").alias("project"), "file", none.alias("name"), F.col("error").alias("reason")))
    return functools.reduce(DataFrame.unionByName, [p.select("project", "file", "name", "reason") for p in parts])


def rewritten_in_place(results: DataFrame, files: DataFrame) -> DataFrame:
    """The other way of phase three: only the changed files, below their project root.

    Finds top-level functions and direct class members only and moves code by its
    common margin.
    """
    texts = decode.accepted(decode.decode(files.filter(F.col("file").isNotNull())))
    source = texts.select("project", "file", "text")
    patches = patching.patch_rows(_rewrites(results, source, "direct"), F.col("file"))
    return patching.patched_files(source, patches, shift=patching.by_common_margin)
