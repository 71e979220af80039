"""Queries over sources, sinks, predicates and routing (S and P operators)."""

from __future__ import annotations

import functools
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thriftline import schemas
from thriftline.functions import paths
from thriftline.operators import generated, outcome, patching, routing, summary
from thriftline.operators.numbering import numbered
from thriftline.plans import lifecycle, savings_queries, views
from thriftline.plans.registry import TWINS, query
from thriftline.session import scratch_path, written
from thriftline.sinks import documents as document_sink
from thriftline.sinks import trees
from thriftline.sources import archives, decode, documents, requirements, split_json, tree, tree_format

_STAMP = "2024-01-01T00:00:00"

# --- S: sources and sinks ----------------------------------------------------


@query("s1_archive_members", views.ARCHIVE_SQL)
def s1_archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = archives.expand_archives(views.archives(spark, sf_dir))
    return members.select("archive", "file", "n_bytes", F.md5("content").alias("digest"))


@query("s1_archive_scan", views.ARCHIVE_SQL)
def s1_archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same archives as files, read member by member."""
    root = scratch_path(spark, "archives")
    packed = views.archives(spark, sf_dir).select(F.lit("in").alias("project"), F.col("path").alias("file"), "content")
    trees.write_tree(packed, root)
    members = archives.read_archives(spark, root)
    return members.select(
        F.substring_index("archive", "/", -1).alias("archive"), "file", "n_bytes", F.md5("content").alias("digest")
    )


def _uneven_archives(spark: SparkSession, sf_dir: str) -> str:
    """Archives of one member and of 21, the text compressed and copies of it stored; gives their folder."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for number, text in frame.itertuples(index=False):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as archive:
                    archive.writestr("m.py", text, zipfile.ZIP_DEFLATED)
                    for n in range(20 if number % 7 == 0 else 0):
                        archive.writestr(f"copy{n}.py", text, zipfile.ZIP_STORED)
                rows.append(("in", f"a{number}.zip", held.getvalue()))
            yield pd.DataFrame(rows, columns=["project", "file", "content"])

    root = scratch_path(spark, "archives")
    docs = views.texts(spark, sf_dir).select("doc_id", "text")
    trees.write_tree(docs.mapInPandas(pack, "project string, file string, content binary"), root)
    return root


_UNEVEN_SQL = """
    WITH m AS (
      SELECT 'a' || doc_id || '.zip' AS archive, 0 AS position, 'm.py' AS file, text FROM documents
      UNION ALL SELECT 'a' || doc_id || '.zip', n + 1, 'copy' || n || '.py', text FROM documents, range(20) AS c(n) WHERE doc_id % 7 = 0)
"""


@query(
    "s1_uneven_archives",
    _UNEVEN_SQL
    + """
    , p AS (
      SELECT *, CAST(strlen(text) AS BIGINT) AS n_bytes, sum(strlen(text) + 512) OVER () AS whole,
             coalesce(sum(strlen(text) + 512) OVER (ORDER BY archive, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m)
    SELECT archive, file, n_bytes, md5(text) AS digest, CAST(before // ((whole + 15) // 16) AS INTEGER) AS load FROM p
    """,
)
def s1_uneven_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen tasks, each with about as many bytes, however they lie in archives and members."""
    listed = archives.list_archives(spark, _uneven_archives(spark, sf_dir))
    members = archives.fetch_members(listed, tasks=16, keep=["load"])
    return members.select(
        F.substring_index("archive", "/", -1).alias("archive"), "file", "n_bytes", F.md5("content").alias("digest"), F.col("load").cast("int")
    )


@query(
    "s1_member_pieces",
    _UNEVEN_SQL
    + """
    , b AS (SELECT archive, file, CAST(strlen(text) AS BIGINT) AS n_bytes, hex(encode(text)) AS h FROM m)
    SELECT archive, file, n_bytes, CAST(i * 1024 AS BIGINT) AS start, md5(unhex(substr(h, CAST(i * 2048 + 1 AS BIGINT), 2048))) AS digest
    FROM (SELECT *, unnest(range(greatest(1, (n_bytes + 1023) // 1024))) AS i FROM b)
    """,
)
def s1_member_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = archives.read_pieces(spark, _uneven_archives(spark, sf_dir), piece=1024)
    return pieces.select(F.substring_index("archive", "/", -1).alias("archive"), "file", "n_bytes", "start", F.md5("content").alias("digest"))


def _tree_folder(spark: SparkSession, sf_dir: str) -> str:
    """Write the documents as a tree of files; gives its folder."""
    root = scratch_path(spark, "tree")
    docs = views.table(spark, sf_dir, "documents")
    named = docs.select(
        F.col("source").alias("project"),
        views.path_of(F.col("doc_id"), F.col("lang")).alias("file"),
        F.col("text").alias("content"),
    )
    trees.write_tree(named, root)
    return root


def _written_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project folders of that tree."""
    root = _tree_folder(spark, sf_dir)
    return views.table(spark, sf_dir, "documents").select(F.col("source").alias("project")).distinct().withColumn(
        "uri", F.concat(F.lit(f"{root}/"), F.col("project"))
    )


_SCAN_COLUMNS = "project, file, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS digest"


@query("s2_source_scan", views.PATH_SQL + f"SELECT {_SCAN_COLUMNS} FROM v_class WHERE is_python AND NOT excluded AND NOT is_test")
def s2_source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tree.scan_sources(spark, _written_tree(spark, sf_dir))
    return found.select("project", "file", "n_bytes", F.md5("content").alias("digest"))


@query("s3_test_scan", views.PATH_SQL + f"SELECT {_SCAN_COLUMNS} FROM v_class WHERE is_python AND NOT excluded AND is_test")
def s3_test_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tree.scan_tests(spark, _written_tree(spark, sf_dir))
    return found.select("project", "file", "n_bytes", F.md5("content").alias("digest"))


@query("s2_tree_format", TWINS["s2_source_scan"])
def s2_tree_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scan as a data source; excluded and test folders are not listed."""
    found = tree_format.open_tree(spark, _tree_folder(spark, sf_dir), is_python=True, excluded=False, is_test=False)
    return found.select("project", "file", "n_bytes", F.md5("content").alias("digest"))


@query("s3_tree_format", TWINS["s3_test_scan"])
def s3_tree_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tree_format.open_tree(spark, _tree_folder(spark, sf_dir), ends=".py", excluded=False, is_test=True)
    return found.select("project", "file", "n_bytes", F.md5("content").alias("digest"))


@query(
    "a12_tree_counts",
    views.PATH_SQL
    + """
    SELECT project, count(*) FILTER (WHERE NOT is_test) AS source_files, count(*) FILTER (WHERE is_test) AS test_files
    FROM v_class WHERE is_python AND NOT excluded GROUP BY project
    """,
)
def a12_tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts from names alone."""
    listed = tree_format.open_tree(spark, _tree_folder(spark, sf_dir), content=False, levels=2, excluded=False)
    return tree.count_files(listed, ["project"])


@query(
    "s4_decoded_text",
    """
    SELECT doc_id,
           CASE doc_id % 5 WHEN 1 THEN 'not valid UTF-8' WHEN 2 THEN 'byte-order mark' WHEN 3 THEN 'NUL character' END AS reject_reason,
           CASE WHEN doc_id % 5 IN (0, 4) THEN md5(text) END AS digest
    FROM documents
    """,
)
def s4_decoded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape, text = F.col("doc_id") % 5, F.encode("text", "UTF-8")
    content = (
        F.when(shape == 1, F.concat(text, F.lit(b"\xff")))
        .when(shape == 2, F.concat(F.lit(b"\xef\xbb\xbf"), text))
        .when(shape == 3, F.concat(text, F.lit(b"\x00")))
        .when(shape == 4, F.encode(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), "UTF-8"))
        .otherwise(text)
    )
    files = views.texts(spark, sf_dir).select("doc_id", content.alias("content"))
    return decode.decode(files).select("doc_id", "reject_reason", F.md5("text").alias("digest"))


@query(
    "s5_result_document",
    """
    WITH t AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS l,
                      unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
    SELECT '/in/' || source AS project_root, '2024-01-01T00:00:00' AS generated_at, doc_id || '.' || i AS id, l AS function_code,
           CASE WHEN i % 2 = 0 THEN length(l) / 4.0 END AS baseline_emissions_kg, i % 2 = 0 AS success,
           CASE WHEN i % 2 <> 0 THEN 'no_spec' END AS skip_reason
    FROM t
    """,
)
def s5_result_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    def record(line, at):
        even = at % 2 == 0
        return F.struct(
            F.concat_ws(".", F.col("doc_id"), at).alias("id"),
            line.alias("function_code"),
            F.when(even, F.length(line) / 4.0).alias("baseline_emissions_kg"),
            even.alias("success"),
            F.when(~even, F.lit("no_spec")).alias("skip_reason"),
        )

    root = scratch_path(spark, "documents")
    views.texts(spark, sf_dir).select(
        F.concat(F.lit("/in/"), F.col("source")).alias("project_root"),
        F.lit(_STAMP).alias("generated_at"),
        F.transform(F.split("text", "\n", -1), record).alias("functions"),
    ).write.json(root)
    read = documents.read_document_lines(spark, root, schemas.RESULT_DOCUMENT)
    return read.select(
        "project_root", "generated_at", "id", "function_code", "baseline_emissions_kg", "success", "skip_reason"
    )


@query(
    "s5_split_document",
    """
    WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
                      unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
    SELECT 'all' AS project_root, '2024-01-01T00:00:00' AS generated_at, doc_id || '.' || i AS id, l AS function_code,
           CASE WHEN i % 2 = 0 THEN length(l) / 4.0 END AS baseline_emissions_kg, i % 2 = 0 AS success,
           CASE WHEN i % 2 <> 0 THEN 'no_spec' END AS skip_reason
    FROM t
    """,
)
def s5_split_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents as records of one JSON file, written by many tasks and read in ranges of 256 KB."""
    lines = views.texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "l"))
    even = F.col("at") % 2 == 0
    own = {
        "id": F.concat_ws(".", "doc_id", "at"), "function_code": F.col("l"), "baseline_emissions_kg": F.when(even, F.length("l") / 4.0),
        "success": even, "skip_reason": F.when(~even, F.lit("no_spec")),
    }
    columns = [own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.RESULT]
    root, folder = scratch_path(spark, "document"), scratch_path(spark, "exported")
    document_sink.write_result_documents(lines.select(F.lit("all").alias("project"), *columns), root, _STAMP)
    document_sink.export_documents(spark, root, folder, part=1 << 20)
    read = split_json.read_split_documents(spark, folder, schemas.RESULT_DOCUMENT, size=1 << 18)
    return read.select("project_root", "generated_at", *own)


def _odd_name(project):
    """Names that look like numbers or dates, hold a line separator, or are empty."""
    odd = {"src1": "007", "src2": "1e3", "src3": "2024-01-01", "src4": "a\u2028b", "src5": ""}
    name = project
    for plain, other in odd.items():
        name = F.when(project == plain, F.lit(other)).otherwise(name)
    return name


@query(
    "s6_spec_documents",
    views.SPEC_SQL
    + """
    SELECT CASE project WHEN 'src1' THEN '007' WHEN 'src2' THEN '1e3' WHEN 'src3' THEN '2024-01-01' WHEN 'src4' THEN 'a' || chr(8232) || 'b' WHEN 'src5' THEN '' ELSE project END AS project, id, name, qualified_name, file, line, end_line, function_code,
           coalesce(spec_code, '') AS spec_code, coalesce(status, 'failed') AS status, coalesce(error, '') AS error FROM v_spec
    """,
)
def s6_spec_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = generated.attach_specs(
        views.functions_of_documents(spark, sf_dir), views.specs_of_labels(spark, sf_dir), ["doc_id"]
    )
    root = scratch_path(spark, "spec-documents")
    document_sink.write_spec_documents(specs.withColumn("project", _odd_name(F.col("project"))), root, _STAMP)
    read = documents.read_section(spark, root, "1-functions", schemas.SPEC_RESULT)
    return read.select(
        "project", "id", "name", "qualified_name", "file", "line", "end_line", "function_code", "spec_code", "status", "error"
    )


@query(
    "s7_result_documents",
    views.RESULTS_SQL
    + """
    SELECT project, id, coalesce(name, '') AS name, file, function_code, spec_code,
           CASE WHEN success THEN optimized_function_code ELSE function_code END AS optimized_function_code,
           CASE WHEN function_id % 10 <> 0 THEN baseline_emissions_kg END AS baseline_emissions_kg, optimized_emissions_kg, success, optimization_attempts, skip_reason FROM v_result
    """,
)
def s7_result_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    unclean = F.when(F.col("function_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("baseline_emissions_kg"))
    results = views.results(spark, sf_dir)
    records = routing.final_records(results, ["project", "function_id"]).withColumn("baseline_emissions_kg", unclean)
    root = scratch_path(spark, "result-documents")
    document_sink.write_result_documents(records.drop("function_id"), root, _STAMP)
    read = documents.read_section(spark, root, "1-functions", schemas.RESULT)
    return read.select(
        "project", "id", "name", "file", "function_code", "spec_code", "optimized_function_code", "baseline_emissions_kg",
        "optimized_emissions_kg", "success", "optimization_attempts", "skip_reason",
    )


@query(
    "s7_exported_documents",
    views.RESULTS_SQL
    + """
    SELECT project AS project_root, '2024-01-01T00:00:00' AS generated_at, id, file, function_code,
           row_number() OVER (PARTITION BY project ORDER BY file, id) - 1 AS position FROM v_result
    """,
)
def s7_exported_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON file for each project, read back in byte ranges; records stand in order."""
    results = views.results(spark, sf_dir)
    root, folder = scratch_path(spark, "result-documents"), scratch_path(spark, "exported")
    document_sink.write_result_documents(routing.final_records(results, ["project"]), root, _STAMP)
    document_sink.export_documents(spark, root, folder)
    read = split_json.read_split_documents(spark, folder, schemas.RESULT_DOCUMENT, places=True)
    each = numbered(read.select("uri", "place", "project_root", "generated_at", "id", "file", "function_code"), ["uri"], [F.col("place")])
    return each.select("project_root", "generated_at", "id", "file", "function_code", (F.col("position") - 1).alias("position"))


_S8_ORDERED = """
    SELECT project, 'optimized' AS section, row_number() OVER (PARTITION BY project ORDER BY -reduction_pct NULLS LAST, file, line, id) AS position,
           id, name, file, baseline_emissions_kg - optimized_emissions_kg AS co2_saved_kg, NULL AS reason FROM v_result WHERE success
    UNION ALL
    SELECT project, 'skipped', row_number() OVER (PARTITION BY project ORDER BY file, line, id), id, name, file, NULL, skip_reason
    FROM v_result WHERE NOT success
    UNION ALL
    SELECT project, 'files', row_number() OVER (PARTITION BY project ORDER BY file), NULL, NULL, file, NULL, NULL
    FROM (SELECT DISTINCT project, file FROM v_result WHERE success)
    UNION ALL
    SELECT project, 'summary', total_functions_analyzed, NULL, NULL, NULL, total_co2_saved_kg, NULL
    FROM v_total JOIN (SELECT project, count(*) AS total_functions_analyzed FROM v_result GROUP BY project) USING (project)
    UNION ALL
    SELECT project, 'credit', functions_with_measurements, NULL, NULL, NULL, total_co2_saved_kg / 1000 * CAST(65.0 AS DOUBLE), NULL FROM v_total
"""


@query("s8_savings_documents", savings_queries.TOTALS_SQL + _S8_ORDERED)
def s8_savings_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, then read back: both lists and the files with their order, the summary and the costs."""
    root = scratch_path(spark, "savings-documents")
    document_sink.write_savings_documents(views.results(spark, sf_dir), root, _STAMP)
    record = "id string, name string, file string, co2_saved_kg double, reason string"
    within = Window.partitionBy("project").orderBy("place")

    def listed(section: str, name: str) -> DataFrame:
        found = documents.read_section(spark, root, section, record).withColumn("position", F.row_number().over(within).cast("bigint"))
        file = F.coalesce("file", F.from_json(F.concat(F.lit('{"f":'), "raw", F.lit("}")), "f string")["f"])
        return found.select(
            "project", F.lit(name).alias("section"), "position", "id", "name", file.alias("file"), "co2_saved_kg", "reason"
        )

    money = T.StructType([T.StructField("eu_ets_carbon_credit_value_usd", T.DoubleType())])
    costs = T.StructType([T.StructField("per_benchmark_run", money)])
    head = documents.read_savings(spark, root, (document_sink.SUMMARY_HEAD, document_sink.SUMMARY_TAIL), costs)
    none = F.lit(None).cast("string")

    def scalar(name: str, number: str, value) -> DataFrame:
        return head.select(
            "project", F.lit(name).alias("section"), F.col(number).cast("bigint").alias("position"), none.alias("id"), none.alias("name"),
            none.alias("file"), value.alias("co2_saved_kg"), none.alias("reason"),
        )

    parts = [
        listed("3-optimized", "optimized"), listed("5-skipped", "skipped"), listed("1-files", "files"),
        scalar("summary", "total_functions_analyzed", F.col("total_co2_saved_kg")),
        scalar("credit", "functions_with_measurements", F.col("cost_estimates.per_benchmark_run.eu_ets_carbon_credit_value_usd")),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


@query(
    "s9_mirrored_tree",
    views.PATCH_SQL + "SELECT project, file, patched, md5(text) AS digest FROM v_patched WHERE doc_id % 10 <> 9",
)
def s9_mirrored_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    mirrored = patching.mirror(views.indented_files(spark, sf_dir), views.file_patches(spark, sf_dir))
    return mirrored.select("project", "file", "patched", F.md5("text").alias("digest"))


_S9_SHAPE = """
    WITH v_doc AS (SELECT doc_id, 'a' || doc_id || '.zip' AS project, n_chars FROM documents),
    v_code AS (
      SELECT *, 'x = ' || n_chars || chr(10) || 'def f():' || chr(10) || '    return ' || n_chars || chr(10) AS old,
             'x = ' || n_chars || chr(10) || 'def f():' || chr(10) || '    return -' || doc_id || chr(10) AS new FROM v_doc)
"""


def _opened(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Archives of a module, a broken module and a note; accepted rewrites, some of functions or files that are not there."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for number, size in frame.itertuples(index=False):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as archive:
                    archive.writestr("app/m.py", f"x = {size}\ndef f():\n    return {size}\n")
                    archive.writestr("app/bad.py", f"def {number}(")
                    archive.writestr("app/latin.py", b"# \xff")
                    archive.writestr("NOTE.md", str(number))
                rows.append((f"a{number}.zip", held.getvalue() if number % 10 != 9 else b"no archive"))
            yield pd.DataFrame(rows, columns=["path", "content"])

    docs = views.texts(spark, sf_dir).select("doc_id", "n_chars")
    members = written(archives.expand_archives(docs.mapInPandas(pack, "path string, content binary")), "members")
    files = written(lifecycle.project_files(members), "files")
    extracted = written(lifecycle.extracted_of(files), "functions")
    number = F.col("doc_id").cast("string")

    def win(name: str, file: str, line: int, code):
        return F.struct(
            F.lit(name).alias("qualified_name"), F.lit(file).alias("file"), F.lit(line).alias("line"), code.alias("optimized_function_code")
        )

    wins = F.array(
        win("f", "m.py", 2, F.concat(F.lit("def f():\n    return -"), number)), win("g", "m.py", 9, F.lit("def g(): pass")),
        win("h", "gone.py", 1, F.lit("def h(): pass")),
    )
    results = docs.filter("doc_id % 10 != 9").select(
        F.concat(F.lit("a"), number, F.lit(".zip")).alias("project"), F.lit(True).alias("success"), F.inline(wins)
    )
    return members, files, extracted, results.withColumn("id", F.concat(F.lit("m."), "qualified_name"))


@query(
    "s9_lifecycle_tree",
    _S9_SHAPE
    + """
    SELECT project, 'app/m.py' AS file, true AS patched, md5(new) AS digest FROM v_code WHERE doc_id % 10 <> 9
    UNION ALL SELECT project, 'app/bad.py', false, md5('def ' || doc_id || '(') FROM v_code WHERE doc_id % 10 <> 9
    UNION ALL SELECT project, 'app/latin.py', false, md5('\\x23\\x20\\xFF'::BLOB) FROM v_code WHERE doc_id % 10 <> 9
    UNION ALL SELECT project, 'NOTE.md', false, md5(CAST(doc_id AS VARCHAR)) FROM v_code WHERE doc_id % 10 <> 9
    """,
)
def s9_lifecycle_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From archives to the patched tree, with the catalogue of phase one."""
    _, files, extracted, results = _opened(spark, sf_dir)
    tree_ = lifecycle.mirrored(results, files, functions=extracted.filter("error IS NULL"))
    return tree_.select("project", "file", "patched", F.md5("content").alias("digest"))


@query(
    "s9_lifecycle_rejects",
    _S9_SHAPE
    + """
    SELECT project, 'latin.py' AS file, NULL AS name, 'not valid UTF-8' AS reason FROM v_doc WHERE doc_id % 10 <> 9
    UNION ALL SELECT project, 'bad.py', NULL, 'SyntaxError' FROM v_doc WHERE doc_id % 10 <> 9
    UNION ALL SELECT project, 'm.py', 'g', 'function not found in file' FROM v_doc WHERE doc_id % 10 <> 9
    UNION ALL SELECT project, 'gone.py', 'h', 'file not found' FROM v_doc WHERE doc_id % 10 <> 9
    UNION ALL SELECT project, NULL, NULL, 'File is not a zip file' FROM v_doc WHERE doc_id % 10 = 9
    """,
)
def s9_lifecycle_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the same run leaves out, each with its reason."""
    members, files, extracted, results = _opened(spark, sf_dir)
    found = lifecycle.rejects(results, files, extracted, members)
    return found.withColumn("reason", F.substring_index("reason", ":", 1))


@query("s10_requirement_lines", views.REQUIREMENT_SQL + "SELECT project, line_no, line FROM v_req")
def s10_requirement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requirements.requirements_of_tree(views.requirement_files(spark, sf_dir)).drop("file")


@query(
    "s11_report_rows",
    views.RESULTS_SQL
    + """
    SELECT CASE project WHEN '2-HIGH' THEN '007' WHEN '3-MEDIUM' THEN '1e3' WHEN '5-LOW' THEN '' ELSE '2024-01-01' END AS project,
           coalesce(name, 'm' || file_id) AS name, file, 'optimised' AS status FROM v_result WHERE success
    """,
)
def s11_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "report")
    rows = summary.report_rows(views.results(spark, sf_dir), ["project"])
    odd = F.when(F.col("project") == "2-HIGH", "007").when(F.col("project") == "3-MEDIUM", "1e3").when(F.col("project") == "5-LOW", "")
    trees.write_table(rows.withColumn("project", odd.otherwise("2024-01-01")), root)
    return spark.read.parquet(root).select("project", "name", "file", "status")


# --- P: predicates and routing -----------------------------------------------


@query("p1_excluded_path", views.PATH_SQL + "SELECT doc_id, file, excluded FROM v_class")
def p1_excluded_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.paths_table(spark, sf_dir).select("doc_id", "file", paths.is_excluded(F.col("file")).alias("excluded"))


@query("p2_test_file", views.PATH_SQL + "SELECT doc_id, file, is_test FROM v_class")
def p2_test_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.paths_table(spark, sf_dir).select("doc_id", "file", paths.is_test_file(F.col("file")).alias("is_test"))


@query("p3_clean_requirements", views.REQUIREMENT_SQL + "SELECT project, line_no, spec FROM v_kept")
def p3_clean_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = requirements.requirements_of_tree(views.requirement_files(spark, sf_dir))
    return requirements.clean_requirements(lines, ["project"])


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(views.unrouted(spark, sf_dir), views.page_files(spark, sf_dir), ["file"])


@query("p4_route", views.SPEC_SQL + "SELECT doc_id, id, skip_reason FROM v_routed")
def p4_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("doc_id", "id", "skip_reason")


@query(
    "p5_skipped_record",
    views.SPEC_SQL
    + """
    SELECT project, id, name, qualified_name, file, function_code, coalesce(spec_code, '') AS spec_code,
           function_code AS optimized_function_code, coalesce(spec_code, '') AS optimized_test_code,
           CAST(NULL AS DOUBLE) AS baseline_emissions_kg, CAST(NULL AS DOUBLE) AS optimized_emissions_kg,
           CAST(0.0 AS DOUBLE) AS reduction_pct, false AS success, 0 AS optimization_attempts, skip_reason
    FROM v_routed WHERE skip_reason IS NOT NULL
    """,
)
def p5_skipped_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.skipped_records(_routed(spark, sf_dir), ["project"])


_FINAL_SQL = """
    SELECT project, id, coalesce(name, '') AS name, qualified_name, file, function_code, spec_code,
           CASE WHEN success THEN optimized_function_code ELSE function_code END AS optimized_function_code,
           spec_code AS optimized_test_code, baseline_emissions_kg, optimized_emissions_kg, reduction_pct,
           success, optimization_attempts, skip_reason
    FROM v_result
"""


@query("p6_final_record", views.RESULTS_SQL + _FINAL_SQL)
def p6_final_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.final_records(views.results(spark, sf_dir), ["project"])


@query(
    "p7_baseline_gate",
    views.RESULTS_SQL + "SELECT function_id, baseline_emissions_kg, skip_reason FROM v_outcome",
)
def p7_baseline_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = outcome.gate_baselines(views.baselines(spark, sf_dir))
    return gated.select("function_id", "baseline_emissions_kg", "skip_reason")


@query(
    "p8_success_split",
    views.RESULTS_SQL
    + "SELECT project, CASE WHEN success THEN 'success' ELSE 'other' END AS part, count(*) AS n FROM v_result GROUP BY ALL",
)
def p8_success_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(routing.is_success(), "success").otherwise("other")
    return views.results(spark, sf_dir).groupBy("project", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p9_measured",
    views.RESULTS_SQL + "SELECT project, id, baseline_emissions_kg, optimized_emissions_kg FROM v_measured",
)
def p9_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = routing.measured(views.results(spark, sf_dir))
    return measured.select("project", "id", "baseline_emissions_kg", "optimized_emissions_kg")


@query(
    "p10_timeout",
    """
    SELECT l_orderkey AS function_id, sum(l_quantity) AS elapsed_s, CASE WHEN sum(l_quantity) > 17 THEN 'timeout' END AS skip_reason
    FROM lineitem GROUP BY l_orderkey
    """,
)
def p10_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("function_id")).agg(
        F.sum("l_quantity").alias("elapsed_s")
    )
    return spent.withColumn("skip_reason", outcome.failure_reason(F.col("elapsed_s"), None))


@query(
    "p11_error_reason",
    """
    SELECT event_id, CASE WHEN value > 17 THEN 'timeout' WHEN event_type = 'error' THEN 'error: ' || props END AS skip_reason
    FROM events
    """,
)
def p11_error_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.when(F.col("event_type") == "error", F.col("props"))
    return views.table(spark, sf_dir, "events").select(
        "event_id", outcome.failure_reason(F.col("value"), failed).alias("skip_reason")
    )


@query(
    "p12_skipped_summary",
    views.RESULTS_SQL + "SELECT project, id, name, file, skip_reason AS reason FROM v_result WHERE NOT success",
)
def p12_skipped_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.skipped_summary(views.results(spark, sf_dir), ["project"])


@query(
    "p13_phase_gate",
    views.SPEC_SQL
    + """
    SELECT doc_id, coalesce(status IN ('passed_existing', 'generated') AND function_code <> '' AND spec_code <> '', false) AS passes
    FROM v_spec
    """,
)
def p13_phase_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    passes = generated.passes_phase_gate(F.col("status"), F.col("function_code"), F.col("spec_code"))
    return views.unrouted(spark, sf_dir).select("doc_id", passes.alias("passes"))


@query(
    "p14_rewrite_gate",
    views.RESULTS_SQL
    + "SELECT project, id, optimized_function_code FROM v_result WHERE success AND function_id % 4 <> 0",
)
def p14_rewrite_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.rewrites(views.results(spark, sf_dir)).select("project", "id", "optimized_function_code")


_REBASE_SQL = (
    views.SPEC_SQL
    + """
    , v_target AS (
      SELECT f.doc_id, CASE WHEN doc_id % 2 = 0 THEN f.file ELSE 'app/' || f.file END AS target_file FROM v_function f),
    v_known AS (SELECT CASE WHEN page_id % 3 = 0 THEN 'app/' || file ELSE file END AS target_file FROM v_file)
    """
)


@query(
    "p15_rebased_path",
    _REBASE_SQL
    + """
    SELECT doc_id, target_file, 'file not found' AS reason FROM v_target t
    WHERE NOT EXISTS (SELECT 1 FROM v_known k WHERE k.target_file = t.target_file)
    """,
)
def p15_rebased_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions whose file is missing below the archive root."""
    all_ = F.lit("all").alias("project")
    functions = views.functions_of_documents(spark, sf_dir).select("doc_id", "file", all_)
    nested = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("app/"), F.col("file"))).otherwise(F.col("file"))
    files = views.page_files(spark, sf_dir).select(nested.alias("file"), all_)
    project_rel = F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.lit("app"))
    return routing.missing_targets(functions, files, project_rel).select("doc_id", "target_file", "reason")
