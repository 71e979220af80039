"""Queries over the function catalogue, source text and joins (C and J operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thriftline import fixed_values as fixed
from thriftline.functions import numbers as nm
from thriftline.functions import paths
from thriftline.functions import text as tx
from thriftline.operators import catalog, generated, patching, routing
from thriftline.plans import views
from thriftline.plans.registry import query
from thriftline.sources import projects, requirements

# --- C: catalogue and text ---------------------------------------------------


@query(
    "c1_function_catalogue",
    views.MODULE_SQL
    + """
    SELECT project, 'src.m_' || doc_id || '.' || qualified_name AS id, name, qualified_name, 'src/m-' || doc_id || '.py' AS file,
           CAST(line AS INTEGER) AS line, CAST(end_line AS INTEGER) AS end_line, function_code FROM v_def
    """,
)
def c1_function_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.catalogue(catalog.extract_functions(views.module_files(spark, sf_dir)))
    return found.select("project", "id", "name", "qualified_name", "file", "line", "end_line", "function_code")


@query(
    "c1_long_expressions",
    """
    SELECT source AS project, 'src/long' || doc_id || '.py' AS file, 'g' || n AS name,
           'def g' || n || '(x):' || chr(10) || '    return x' || repeat(' + x', 400 + n) AS function_code, false AS failed
    FROM documents, (SELECT unnest([0, 1]) AS n)
    UNION ALL
    SELECT source, 'src/vast' || doc_id || '.py', NULL, NULL, true FROM documents WHERE n_chars > 2000
    """,
)
def c1_long_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sums of over 400 terms in a file of every document; one of 20,000 in a file of the longer ones."""

    def code(name: str, terms: int):
        return F.concat(F.lit(f"def {name}(x):\n    return x"), F.repeat(F.lit(" + x"), F.lit(terms)), F.lit("\n"))

    docs = views.texts(spark, sf_dir).select("doc_id", F.col("source").alias("project"), "n_chars")
    file = lambda kind: F.concat(F.lit(f"src/{kind}"), "doc_id", F.lit(".py")).alias("file")
    long = docs.select("project", file("long"), F.concat(code("g0", 400), code("g1", 401)).alias("text"))
    vast = docs.filter("n_chars > 2000").select("project", file("vast"), code("v", 20_000).alias("text"))
    found = catalog.extract_functions(long.unionByName(vast))
    return found.select("project", "file", "name", "function_code", F.col("error").isNotNull().alias("failed"))


@query(
    "c2_module_name",
    views.PATH_SQL
    + r"SELECT doc_id, replace(replace(regexp_replace(file, '([^/])\.[^./]+$', '\1'), '/', '.'), '-', '_') AS module FROM v_path",
)
def c2_module_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.paths_table(spark, sf_dir).select("doc_id", paths.module_name(F.col("file")).alias("module"))


@query("c3_function_id", views.RESULTS_SQL + "SELECT function_id, 'src.m' || file_id || '.' || qualified_name AS id FROM v_result")
def c3_function_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = views.named(views.baselines(spark, sf_dir))
    return named.select(
        "function_id", paths.function_id(paths.module_name(F.col("file")), F.col("qualified_name")).alias("id")
    )


@query(
    "c4_line_slice",
    """
    SELECT doc_id, array_to_string(string_split(text, chr(10))[2:3 + doc_id % 40], chr(10)) AS code FROM documents
    """,
)
def c4_line_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = 3 + F.col("doc_id") % 40
    return views.texts(spark, sf_dir).select(
        "doc_id", tx.slice_lines(F.col("text"), F.lit(2), last).alias("code")
    )


@query(
    "c5_line_indent",
    r"""
    SELECT doc_id, coalesce(regexp_extract(string_split(replace(text, chr(10), chr(10) || '    '), chr(10))[doc_id % 7 + 1], '^(\s*)', 1), '') AS indent
    FROM documents
    """,
)
def c5_line_indent(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = views.indented_text(F.col("text"))
    return views.texts(spark, sf_dir).select(
        "doc_id", tx.indent_of(text, F.col("doc_id") % 7 + 1).alias("indent")
    )


@query(
    "c6_applied_indent",
    """
    SELECT doc_id, CASE doc_id % 3
        WHEN 0 THEN text WHEN 1 THEN '  ' || text
        ELSE array_to_string(list_transform(string_split(text, chr(10)), lambda x: '  ' || x), chr(10)) END AS code
    FROM documents
    """,
)
def c6_applied_indent(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.col("doc_id") % 3
    indent = F.when(shape == 0, F.lit("")).otherwise(F.lit("  "))
    code = F.when(shape == 1, F.concat(F.lit("  "), F.col("text"))).otherwise(F.col("text"))
    return views.texts(spark, sf_dir).select("doc_id", tx.apply_indent(code, indent).alias("code"))


@query(
    "c7_reindented",
    """
    WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
    SELECT doc_id, array_to_string(list_concat(['', '  ' || lines[1]],
             list_transform(lines[2:], lambda x: CASE WHEN trim(x) = '' THEN '' ELSE
               CASE WHEN doc_id % 2 = 0 THEN '    ' || x ELSE '  ' || ltrim(x, ' ' || chr(160) || chr(9)) END END)), chr(10)) AS code
    FROM t
    """,
)
def c7_reindented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as deep as the first keep their own depth; shallower ones are stripped first."""
    deep = F.replace(F.col("text"), F.lit("\n"), F.lit("\n      "))
    code = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n    "), deep)).otherwise(
        F.concat(F.lit("\n    "), F.col("text"))
    )
    return views.texts(spark, sf_dir).select("doc_id", tx.reindent(code, F.lit("  ")).alias("code"))


@query(
    "c8_dedented",
    """
    WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
    SELECT doc_id, array_to_string(list_concat(
             ['   ' || '  ' || lines[1]],
             list_transform(lines[2:], lambda x: CASE WHEN trim(x) = '' THEN '' ELSE '   ' || x END)), chr(10)) AS code
    FROM t
    """,
)
def c8_dedented(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(
        F.lit("      "),
        F.replace(F.col("text"), F.lit("\n"), F.lit("\n    ")),
        F.lit("\n    -"),
    )
    shifted = tx.dedent_indent(code, F.lit(3))
    # The last line only pins the margin; it is taken off again.
    return views.texts(spark, sf_dir).select(
        "doc_id", F.regexp_replace(shifted, r"\n   -\z", "").alias("code")
    )


_EXPECTED_RANGES = """
    SELECT project, file, qualified_name,
           CAST(CASE WHEN {cases} END AS INTEGER) AS line, CAST(CASE WHEN {ends} END AS INTEGER) AS end_line
    FROM v_request
"""


def _ranges_sql(rows: list[tuple[str, int, int, int]]) -> str:
    """Expected ranges: name, lines of text needed, first and last line."""
    cases = " WHEN ".join(f"qualified_name = '{name}' AND n >= {n} THEN {first}" for name, n, first, _ in rows)
    ends = " WHEN ".join(f"qualified_name = '{name}' AND n >= {n} THEN {last}" for name, n, _, last in rows)
    return views.REQUEST_SQL + _EXPECTED_RANGES.format(cases=cases, ends=ends)


@query(
    "c9_located_any_depth",
    _ranges_sql([("f0", 1, 1, 3), ("C1.m", 2, 6, 7), ("h2", 3, 10, 10), ("m", 2, 6, 7), ("inner", 4, 14, 14)]),
)
def c9_located_any_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.locate(views.locate_requests(spark, sf_dir), views.module_files(spark, sf_dir), "any")


@query("c10_located_direct", _ranges_sql([("f0", 1, 1, 3), ("C1.m", 2, 6, 7)]))
def c10_located_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.locate(views.locate_requests(spark, sf_dir), views.module_files(spark, sf_dir), "direct")


@query(
    "c11_extracted_code",
    views.RESPONSE_SQL
    + r"""
    SELECT conv_id, turn, CASE WHEN conv_id % 4 = 2 THEN 'def f():' || chr(10) || trim(text, chr(10) || ' ' || chr(9) || chr(13))
                               WHEN conv_id % 4 < 2 OR NOT regexp_matches(raw, '(?m)^\s*(import |from |def |class |#)')
                               THEN trim(text, chr(10) || ' ' || chr(9) || chr(13))
                               ELSE trim(regexp_extract(raw, '(?sm)^\s*(import |from |def |class |#).*\z', 0), chr(10) || ' ' || chr(9) || chr(13)) END AS code
    FROM v_response
    """,
)
def c11_extracted_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.responses(spark, sf_dir).select("conv_id", "turn", tx.extract_code(F.col("raw")).alias("code"))


@query(
    "c12_tagged_code",
    views.RESPONSE_SQL
    + """
    SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN rtrim(ltrim(text, ' ' || chr(10)), chr(10))
                               ELSE trim(raw, chr(10) || ' ' || chr(9) || chr(13)) END AS code
    FROM v_response
    """,
)
def c12_tagged_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.responses(spark, sf_dir).select("conv_id", "turn", tx.extract_tagged_code(F.col("raw")).alias("code"))


@query(
    "c13_checked_code",
    """
    WITH t AS (SELECT doc_id, 'x = 1' || chr(10) || '# ' || replace(text, chr(10), chr(10) || '# ') AS body FROM documents)
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'generated' WHEN 3 THEN 'generated' ELSE 'failed' END AS status,
           CASE WHEN doc_id % 4 IN (0, 3) THEN md5(trim(body)) ELSE md5('') END AS digest, doc_id % 4 IN (1, 2) AS has_error
    FROM t
    """,
)
def c13_checked_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that hold a whole document as comments, good, broken, empty and failed."""
    body = F.concat(F.lit("x = 1\n# "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n# ")))
    raw = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("```python\n"), body, F.lit("\n```")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("```python\ndef f(:\n"), body, F.lit("\n```")))
        .when(F.col("doc_id") % 4 == 2, F.lit(" \n "))
        .otherwise(F.concat(F.lit("```\n"), body, F.lit("\n```")))
    )
    checked = generated.check_generated(views.texts(spark, sf_dir).select("doc_id", raw.alias("raw")))
    return checked.select("doc_id", "status", F.md5("spec_code").alias("digest"), (F.col("error") != "").alias("has_error"))


@query(
    "c14_benchmark_call",
    views.MODULE_SQL
    + """
    SELECT doc_id, qualified_name, name || CASE n_args WHEN 2 THEN '(97, 97)' ELSE '(97)' END AS call FROM v_def
    """,
)
def c14_benchmark_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.catalogue(catalog.extract_functions(views.module_files(spark, sf_dir)))
    number = F.regexp_extract("file", r"(\d+)", 1).cast("bigint")
    return found.select(number.alias("doc_id"), "qualified_name", tx.benchmark_call(F.col("name"), F.col("n_args")).alias("call"))


@query(
    "c15_request_text",
    """
    WITH t AS (SELECT doc_id, text, doc_id % 3 AS attempt, 'def f(): return ' || n_chars AS code, 'm' || doc_id || '.f' AS id FROM documents)
    SELECT doc_id, 'Tests wanted for ' || id || ' in src/m.py:' || chr(10) || '```python' || chr(10) || code || chr(10) || '```' AS spec_request,
           'Cheaper rewrite wanted:' || chr(10) || '```python' || chr(10) || code || chr(10) || '```' ||
           CASE WHEN attempt > 1 AND text <> '' THEN chr(10) || 'The last try was refused: test suite failed' || chr(10) || 'Test output:' || chr(10)
             || substr(text, 1, 2000) || chr(10) || 'Tests to pass:' || chr(10) || '```python' || chr(10) || 'pass' || chr(10) || '```' ELSE '' END AS rewrite_request
    FROM t
    """,
)
def c15_request_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("def f(): return "), F.col("n_chars"))
    id_ = F.concat(F.lit("m"), F.col("doc_id"), F.lit(".f"))
    return views.texts(spark, sf_dir).select(
        "doc_id",
        tx.spec_request(id_, F.lit("src/m.py"), code).alias("spec_request"),
        tx.rewrite_request(
            code, F.col("doc_id") % 3, F.lit(fixed.RETRY_TESTS), F.col("text"), F.lit("pass")
        ).alias("rewrite_request"),
    )


@query(
    "c16_truncated_text",
    "SELECT doc_id, substr(text, 1, 2000) AS test_output, substr(text, 1, 400) AS diagnostic FROM documents",
)
def c16_truncated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.texts(spark, sf_dir).select(
        "doc_id",
        tx.truncate(F.col("text"), fixed.TEST_OUTPUT_CHARS).alias("test_output"),
        tx.truncate(F.col("text"), fixed.DIAGNOSTIC_CHARS).alias("diagnostic"),
    )


@query(
    "c17_line_count",
    """
    SELECT doc_id, CAST(len(string_split(text, chr(10))) - CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END AS INTEGER) AS n_lines
    FROM documents
    """,
)
def c17_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.texts(spark, sf_dir).select("doc_id", tx.count_lines(F.col("text")).alias("n_lines"))


@query("c18_patched_files", views.PATCH_SQL + "SELECT project, file, text FROM v_patched WHERE patched")
def c18_patched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    patched = patching.patched_files(views.indented_files(spark, sf_dir), views.file_patches(spark, sf_dir))
    return patched.select("project", "file", "text")


# --- J: joins ----------------------------------------------------------------


@query(
    "j1_attached_specs",
    views.SPEC_SQL
    + """
    SELECT doc_id, id, coalesce(spec_code, '') AS spec_code, coalesce(status, 'failed') AS status, coalesce(error, '') AS error FROM v_spec
    """,
)
def j1_attached_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    attached = generated.attach_specs(
        views.functions_of_documents(spark, sf_dir), views.specs_of_labels(spark, sf_dir), ["doc_id"]
    )
    return attached.select("doc_id", "id", "spec_code", "status", "error")


@query("j2_source_exists", views.SPEC_SQL + "SELECT doc_id, file, has_source FROM v_routed")
def j2_source_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = routing.with_source_flag(
        views.functions_of_documents(spark, sf_dir), views.page_files(spark, sf_dir), ["file"]
    )
    return flagged.select("doc_id", "file", "has_source")


@query(
    "j3_functions_with_source",
    views.RESULTS_SQL
    + """
    SELECT r.id, r.file, p.page_id IS NOT NULL AS found, length(p.html) AS n_chars
    FROM v_result r LEFT JOIN pages p ON p.page_id = r.file_id WHERE r.success
    """,
)
def j3_functions_with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    wins = routing.successes(views.results(spark, sf_dir)).withColumn("project", F.lit("all"))
    files = views.page_files(spark, sf_dir).withColumn("project", F.lit("all"))
    joined = routing.with_source(wins, files)
    return joined.select("id", "file", "found", F.length("text").cast("bigint").alias("n_chars"))


@query(
    "j4_catalogue_match",
    _ranges_sql([("f0", 1, 1, 3), ("C1.m", 2, 6, 7), ("o3.inner", 4, 14, 14)]),
)
def j4_catalogue_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.locate(views.locate_requests(spark, sf_dir), views.module_files(spark, sf_dir), "exact")


_LINES_SQL = """
    WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                      unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)
"""


@query(
    "j5_uncovered_lines",
    _LINES_SQL
    + """
    SELECT t.doc_id, CAST(t.line_no AS INTEGER) AS line_no, t.line FROM t LEFT JOIN labels l ON l.doc_id = t.doc_id
    WHERE NOT coalesce(l.quality = 1 AND t.line_no BETWEEN 2 AND 3, false) AND NOT coalesce(l.toxic = 1 AND t.line_no = 5, false)
      AND NOT (t.line = '' AND t.line_no = (SELECT max(u.line_no) FROM t u WHERE u.doc_id = t.doc_id))
    """,
)
def j5_uncovered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = requirements.requirement_lines(views.texts(spark, sf_dir), ["doc_id"])
    return patching.uncovered_lines(lines, views.patches(spark, sf_dir), ["doc_id"]).select("doc_id", "line_no", "line")


@query(
    "j5_hot_file",
    """
    WITH t AS (SELECT l_linenumber, l_orderkey * 8 + l_linenumber AS line_no FROM lineitem),
    p AS (
      SELECT o_orderkey * 8 + o_custkey % 5 AS a, o_orderkey * 8 + o_custkey % 5 + CAST(floor(o_totalprice) AS BIGINT) % 90 AS b
      FROM orders WHERE o_orderkey % 7 = 0),
    m AS (SELECT a, max(b) AS b FROM p GROUP BY a),
    r AS (SELECT a, max(b) OVER (ORDER BY a) AS b FROM m)
    SELECT l_linenumber, line_no FROM t ASOF LEFT JOIN r ON r.a <= t.line_no WHERE r.b IS NULL OR r.b < t.line_no
    """,
)
def j5_hot_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item is a line of one file and every seventh order a range of it."""
    lines = views.table(spark, sf_dir, "lineitem").select(
        F.lit("hot").alias("file"), "l_linenumber", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no")
    )
    first = F.col("o_orderkey") * 8 + F.col("o_custkey") % 5
    ranges = views.table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(
        F.lit("hot").alias("file"), first.alias("start_line"), (first + F.col("o_totalprice").cast("bigint") % 90).alias("end_line")
    )
    return patching.uncovered_lines(lines, ranges, ["file"]).select("l_linenumber", "line_no")


@query("j6_missing_tools", views.REQUIREMENT_SQL + "SELECT project, spec FROM v_missing")
def j6_missing_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.requirement_files(spark, sf_dir)
    clean = requirements.clean_requirements(requirements.requirements_of_tree(files), ["project"])
    return requirements.missing_tools(clean, files, ["project"])


def _placed_archives(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Projects with their root, and trees where requirements sit in the root, above, both or elsewhere."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id")
    shape = F.col("doc_id") % 3
    root = F.when(shape == 0, F.lit("")).when(shape == 1, F.lit("proj")).otherwise(F.lit("top/proj"))
    parent = F.when(shape == 1, F.lit("")).otherwise(F.lit("top"))
    placed = docs.select(F.col("doc_id").alias("archive"), root.alias("root"), parent.alias("parent"))

    def at(folder):
        return F.when(folder == "", F.lit("requirements.txt")).otherwise(F.concat(folder, F.lit("/requirements.txt")))

    choice = F.col("archive") % 4
    files = (
        F.when(choice == 0, F.array(at(F.col("root"))))
        .when(choice == 1, F.array(at(F.col("parent"))))
        .when(choice == 2, F.array(at(F.col("root")), at(F.col("parent"))))
        .otherwise(F.array(F.lit("sub/x/requirements.txt")))
    )
    return placed.select("archive", "root"), placed.select("archive", F.explode(files).alias("file"))


@query(
    "j7_requirements_file",
    """
    SELECT doc_id AS archive, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'proj' ELSE 'top/proj' END AS root,
      CASE WHEN doc_id % 4 = 3 THEN NULL
           WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 4 IN (0, 2) THEN 'requirements.txt' END
           WHEN doc_id % 3 = 1 THEN CASE WHEN doc_id % 4 IN (0, 2) THEN 'proj/requirements.txt' ELSE 'requirements.txt' END
           ELSE CASE WHEN doc_id % 4 IN (0, 2) THEN 'top/proj/requirements.txt' ELSE 'top/requirements.txt' END END AS requirements_file
    FROM documents
    """,
)
def j7_requirements_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, files = _placed_archives(spark, sf_dir)
    return requirements.find_requirements(placed, files)


_MEMBERS_SQL = """
    WITH m AS (SELECT doc_id AS archive, unnest(CASE doc_id % 7
        WHEN 0 THEN ['main.py', 'zz/requirements.txt']
        WHEN 1 THEN ['b/requirements.txt', 'a/x.py', 'c/requirements.txt']
        WHEN 2 THEN ['.hid/requirements.txt', 'b/deep/x.py', 'a/readme.md']
        WHEN 3 THEN ['a/readme.md', 'requirements.txt']
        WHEN 4 THEN ['.hid/x.py']
        WHEN 5 THEN ['a/sub/requirements.txt', 'a/readme.md', source || '/x.py']
        ELSE [lang || '/' || source || '.py', 'zz/x.py'] END) AS file FROM documents),
    f AS (SELECT archive, CASE WHEN contains(file, '/') THEN split_part(file, '/', 1) ELSE '' END AS folder, file FROM m),
    g AS (SELECT archive, folder, bool_or(ends_with(file, '.py')) AS has_python,
                 bool_or(file = folder || '/requirements.txt') AS has_requirements FROM f GROUP BY archive, folder)
"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.col("doc_id") % 7

    def some(*files):
        return F.array(*[F.lit(f) if isinstance(f, str) else f for f in files])

    files = (
        F.when(shape == 0, some("main.py", "zz/requirements.txt"))
        .when(shape == 1, some("b/requirements.txt", "a/x.py", "c/requirements.txt"))
        .when(shape == 2, some(".hid/requirements.txt", "b/deep/x.py", "a/readme.md"))
        .when(shape == 3, some("a/readme.md", "requirements.txt"))
        .when(shape == 4, some(".hid/x.py"))
        .when(shape == 5, some("a/sub/requirements.txt", "a/readme.md", F.concat(F.col("source"), F.lit("/x.py"))))
        .otherwise(some(F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit(".py")), "zz/x.py"))
    )
    return views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("archive"), F.explode(files).alias("file"))


@query(
    "j8_project_root",
    _MEMBERS_SQL
    + """
    SELECT archive, CASE WHEN bool_or(folder = '' AND has_python) THEN ''
        ELSE coalesce(min(folder) FILTER (WHERE folder <> '' AND NOT starts_with(folder, '.') AND has_requirements),
                      min(folder) FILTER (WHERE folder <> '' AND NOT starts_with(folder, '.') AND has_python), '') END AS root
    FROM g GROUP BY archive
    """,
)
def j8_project_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.find_project_roots(_members(spark, sf_dir))


@query(
    "v3_candidate_folder",
    _MEMBERS_SQL
    + """
    SELECT archive, folder, has_python, has_requirements,
           row_number() OVER (PARTITION BY archive ORDER BY folder) AS position
    FROM g WHERE folder <> '' AND NOT starts_with(folder, '.')
    """,
)
def v3_candidate_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = projects.candidate_folders(_members(spark, sf_dir)).filter((F.col("folder") != "") & ~F.col("hidden"))
    # A group is one archive's top folders.
    place = F.row_number().over(Window.partitionBy("archive").orderBy("folder")).cast("bigint")
    return folders.select("archive", "folder", "has_python", "has_requirements", place.alias("position"))


# --- text to values ----------------------------------------------------------


@query(
    "x8_file_stem",
    views.PATH_SQL
    + r"SELECT doc_id, regexp_replace(regexp_extract(file, '([^/]*)$', 1), '(.)\.[^.]+$', '\1') AS stem FROM v_path",
)
def x8_file_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.paths_table(spark, sf_dir).select("doc_id", paths.stem(F.col("file")).alias("stem"))


@query(
    "x9_parsed_numbers",
    """
    SELECT event_id,
      CASE event_id % 8 WHEN 0 THEN value WHEN 1 THEN value WHEN 2 THEN NULL WHEN 3 THEN CAST('nan' AS DOUBLE) WHEN 4 THEN 10.0
                        WHEN 5 THEN 1e-9 WHEN 6 THEN NULL ELSE event_id END AS as_float,
      CASE event_id % 8 WHEN 4 THEN 10 WHEN 7 THEN event_id END AS as_int
    FROM events
    """,
)
def x9_parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape, value = F.col("event_id") % 8, F.col("value").cast("string")
    raw = (
        F.when(shape == 0, value)
        .when(shape == 1, F.concat(F.lit(" \t"), value, F.lit("\r\n")))
        .when(shape == 2, F.concat(value, F.lit("f")))
        .when(shape == 3, F.lit("NaN"))
        .when(shape == 4, F.lit("1_0"))
        .when(shape == 5, F.lit(" 1e-9 "))
        .when(shape == 6, F.col("props"))
        .otherwise(F.concat(F.lit("+"), F.col("event_id")))
    )
    return views.table(spark, sf_dir, "events").select(
        "event_id", nm.to_float(raw).alias("as_float"), nm.to_int(raw).alias("as_int")
    )


@query(
    "x10_prefix_split",
    views.LOG_SQL + "SELECT seq, CASE WHEN starts_with(line, 'EMISSIONS:') THEN substr(line, 11) END AS rest FROM v_log",
)
def x10_prefix_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = nm.after_prefix(F.col("line"), fixed.EMISSIONS_PREFIX)
    return views.log_lines(spark, sf_dir).select("seq", rest.alias("rest"))


@query(
    "x14_split_lines",
    """
    SELECT doc_id, CAST(len(l) AS INTEGER) AS n, md5(array_to_string(l, '|')) AS digest
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
    """,
)
def x14_split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with each kind of end, and a closing end that opens no further line."""
    shape = F.col("doc_id") % 3
    end = F.when(shape == 0, F.lit("\n")).when(shape == 1, F.lit("\r\n")).otherwise(F.lit("\r"))
    text = F.concat(F.replace(F.col("text"), F.lit("\n"), end), end)
    lines = views.texts(spark, sf_dir).select("doc_id", tx.split_lines(text).alias("lines"))
    return lines.select("doc_id", F.size("lines").alias("n"), F.md5(F.array_join("lines", "|")).alias("digest"))
