"""Shapes of the pipeline's tables, derived from the given tables.

Each view exists twice: as a DataFrame and as SQL text for the reference engine
of the correctness check.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftline import fixed_values as fixed
from thriftline.operators import outcome
from thriftline.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over enough tasks for work on their text."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")  # one file as a rule


# --- baselines, attempts, results --------------------------------------------


def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("function_id"),
        F.col("o_custkey").alias("file_id"),
        F.col("o_orderpriority").alias("project"),
        F.when(F.col("o_orderstatus") == "P", F.lit(0.0)).otherwise(F.col("o_totalprice") / 8).alias("baseline_kg"),
        (F.col("o_orderpriority") != "1-URGENT").alias("baseline_passed"),
    )


def attempt_rows(lineitem: DataFrame) -> DataFrame:
    """Attempts as they land; a function and number may come more than once."""
    return lineitem.select(
        F.col("l_orderkey").alias("function_id"),
        F.col("l_linenumber").alias("attempt"),
        (F.col("l_returnflag") != "R").alias("test_passed"),
        F.col("l_extendedprice").alias("emissions_kg"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per function and number."""
    return every_attempt(spark, sf_dir).filter(F.col("attempt") <= fixed.MAX_ATTEMPTS)


def every_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per function and number, numbers past the limit too."""
    rows = attempt_rows(table(spark, sf_dir, "lineitem"))
    return rows.groupBy("function_id", "attempt").agg(
        F.bool_and("test_passed").alias("test_passed"), F.min("emissions_kg").alias("emissions_kg")
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = attempt_rows(table(spark, sf_dir, "lineitem"))
    return outcome.resolve(baselines(spark, sf_dir), landed, ["function_id"])


def named(df: DataFrame) -> DataFrame:
    """Give outcomes the names, places and texts of functions."""
    number = F.col("function_id")
    return df.withColumns(
        {
            "id": F.concat(F.lit("fn_"), number),
            "name": F.when(number % 9 != 0, F.concat(F.lit("f"), number % 100)),
            "qualified_name": F.concat(F.lit("K.f"), number % 100),
            "file": F.concat(F.lit("src/m"), F.col("file_id"), F.lit(".py")),
            "line": (number % 1000 + 1).cast("int"),
            "function_code": F.concat(F.lit("def f(): return "), number),
            "spec_code": F.concat(F.lit("def test_"), number, F.lit("(): pass")),
            "optimized_function_code": F.when(number % 4 != 0, F.concat(F.lit("def f(): yield "), number)).otherwise(
                F.lit(" \n ")
            ),
        }
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(outcomes(spark, sf_dir))


RESULTS_SQL = """
WITH v_baseline AS (
  SELECT o_orderkey AS function_id, o_custkey AS file_id, o_orderpriority AS project,
         CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice / 8 END AS baseline_kg,
         o_orderpriority <> '1-URGENT' AS baseline_passed
  FROM orders),
v_attempt AS (
  SELECT l_orderkey AS function_id, l_linenumber AS attempt,
         bool_and(l_returnflag <> 'R') AS test_passed, min(l_extendedprice) AS emissions_kg
  FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey, l_linenumber),
v_judged AS (
  SELECT b.*, b.baseline_passed AND b.baseline_kg <> 0 AS usable,
         CASE WHEN a1.test_passed AND a1.emissions_kg < b.baseline_kg THEN 1
              WHEN a2.test_passed AND a2.emissions_kg < b.baseline_kg THEN 2 END AS best,
         a1.emissions_kg AS kg_1, a2.emissions_kg AS kg_2,
         CASE WHEN a2.attempt IS NOT NULL THEN 2 WHEN a1.attempt IS NOT NULL THEN 1 ELSE 0 END AS tried
  FROM v_baseline b
  LEFT JOIN (SELECT * FROM v_attempt WHERE attempt = 1) a1 ON a1.function_id = b.function_id
  LEFT JOIN (SELECT * FROM v_attempt WHERE attempt = 2) a2 ON a2.function_id = b.function_id),
v_outcome AS (
  SELECT function_id, file_id, project, baseline_kg, baseline_passed,
         CASE WHEN usable THEN NULL ELSE 'baseline_measurement_failed' END AS skip_reason,
         CASE WHEN usable THEN baseline_kg ELSE 0.0 END AS baseline_emissions_kg,
         CASE WHEN usable AND best = 1 THEN kg_1 WHEN usable AND best = 2 THEN kg_2 END AS optimized_emissions_kg,
         coalesce(usable AND best IS NOT NULL, false) AS success,
         CAST(CASE WHEN NOT usable THEN 0 ELSE coalesce(best, tried) END AS INTEGER) AS optimization_attempts,
         CASE WHEN usable AND best = 1 THEN (baseline_kg - kg_1) / baseline_kg * 100
              WHEN usable AND best = 2 THEN (baseline_kg - kg_2) / baseline_kg * 100
              ELSE 0.0 END AS reduction_pct
  FROM v_judged),
v_result AS (
  SELECT *, 'fn_' || function_id AS id,
         CASE WHEN function_id % 9 <> 0 THEN 'f' || (function_id % 100) END AS name,
         'K.f' || (function_id % 100) AS qualified_name,
         'src/m' || file_id || '.py' AS file,
         CAST(function_id % 1000 + 1 AS INTEGER) AS line,
         'def f(): return ' || function_id AS function_code,
         'def test_' || function_id || '(): pass' AS spec_code,
         CASE WHEN function_id % 4 <> 0 THEN 'def f(): yield ' || function_id
              ELSE ' ' || chr(10) || ' ' END AS optimized_function_code
  FROM v_outcome),
v_measured AS (
  SELECT * FROM v_result WHERE success AND baseline_emissions_kg IS NOT NULL AND optimized_emissions_kg IS NOT NULL)
"""

# --- measurement logs --------------------------------------------------------


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    line = (
        F.when(kind == "purchase", F.concat(F.lit(fixed.EMISSIONS_PREFIX), F.col("value").cast("string")))
        .when(kind == "error", F.lit("EXIT_CODE:1"))
        .when(kind == "signup", F.lit("EXIT_CODE:0"))
        .when(kind == "click", F.lit("EMISSIONS:n/a"))
        .otherwise(F.concat(F.lit("noise "), F.col("props")))
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("function_id"),
        F.col("ts").cast("date").alias("run_id"),
        F.col("event_id").alias("seq"),
        line.alias("line"),
    )


LOG_SQL = """
WITH v_log AS (
  SELECT user_id AS function_id, CAST(ts AS DATE) AS run_id, event_id AS seq,
         CASE event_type WHEN 'purchase' THEN 'EMISSIONS:' || CAST(value AS VARCHAR)
                         WHEN 'error' THEN 'EXIT_CODE:1' WHEN 'signup' THEN 'EXIT_CODE:0'
                         WHEN 'click' THEN 'EMISSIONS:n/a' ELSE 'noise ' || props END AS line
  FROM events),
v_value AS (
  SELECT *, CASE WHEN starts_with(line, 'EMISSIONS:') THEN TRY_CAST(trim(substr(line, 11)) AS DOUBLE) END AS e,
            CASE WHEN starts_with(line, 'EXIT_CODE:') THEN TRY_CAST(trim(substr(line, 11)) AS BIGINT) END AS c
  FROM v_log),
v_run AS (
  SELECT function_id, run_id,
         arg_max(e, seq) FILTER (WHERE e IS NOT NULL) AS emissions_kg,
         arg_max(c, seq) FILTER (WHERE c IS NOT NULL) AS exit_code
  FROM v_value GROUP BY function_id, run_id),
v_runs AS (SELECT *, emissions_kg IS NOT NULL AND exit_code IS NOT NULL AS parsed FROM v_run)
"""

# --- paths -------------------------------------------------------------------


def path_of(number: Column, lang: Column) -> Column:
    """Eight shapes of relative paths, unique per number."""
    excluded = F.array(*[F.lit(p) for p in fixed.EXCLUDED_PARTS])
    shapes = [
        F.concat(F.lit("my-pkg/mod-"), number, F.lit(".v2.py")),
        F.concat(F.lit("Tests/m"), number, F.lit(".py")),
        F.concat(F.get(excluded, (number % 15).cast("int")), F.lit("/lib/x"), number, F.lit(".py")),
        F.concat(F.lit("src/test_m"), number, F.lit(".py")),
        F.concat(F.lit("src/pkg"), number, F.lit("/__init__.py")),
        F.concat(F.lit("src/m"), number, F.lit("_spec.py")),
        F.concat(F.lit("pkg/"), lang, F.lit("/mod"), number, F.lit(".py")),
        F.concat(F.lit("Venv/m"), number, F.lit(".txt")),
    ]
    chosen = shapes[-1]
    for n, shape in list(enumerate(shapes))[-2::-1]:
        chosen = F.when(number % 8 == n, shape).otherwise(chosen)
    return chosen


def paths_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("project"), path_of(F.col("doc_id"), F.col("lang")).alias("file")
    )


PATH_SQL = """
WITH v_path AS (
  SELECT doc_id, source AS project, text,
    CASE doc_id % 8
      WHEN 0 THEN 'my-pkg/mod-' || doc_id || '.v2.py'
      WHEN 1 THEN 'Tests/m' || doc_id || '.py'
      WHEN 2 THEN ['.git', '.hg', '.svn', '.venv', 'venv', 'env', '__pycache__', 'build', 'dist', '.mypy_cache',
                   '.pytest_cache', '.ruff_cache', 'site-packages', 'node_modules', '.tox'][doc_id % 15 + 1]
                  || '/lib/x' || doc_id || '.py'
      WHEN 3 THEN 'src/test_m' || doc_id || '.py'
      WHEN 4 THEN 'src/pkg' || doc_id || '/__init__.py'
      WHEN 5 THEN 'src/m' || doc_id || '_spec.py'
      WHEN 6 THEN 'pkg/' || lang || '/mod' || doc_id || '.py'
      ELSE 'Venv/m' || doc_id || '.txt' END AS file
  FROM documents),
v_class AS (
  SELECT *, doc_id % 8 = 2 AS excluded, doc_id % 8 IN (1, 3, 5) AS is_test, doc_id % 8 <> 7 AS is_python FROM v_path)
"""

# --- specs -------------------------------------------------------------------


def functions_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("project"),
        F.concat(F.lit("m"), F.col("doc_id"), F.lit(".f")).alias("id"),
        F.lit("f").alias("name"),
        F.lit("f").alias("qualified_name"),
        F.concat(F.lit("src/m"), F.col("doc_id"), F.lit(".py")).alias("file"),
        F.lit(1).alias("line"),
        F.col("n_chars").cast("int").alias("end_line"),
        F.concat(F.lit("def f(): return "), F.col("n_chars")).alias("function_code"),
    )


def specs_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.col("quality") == 1
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        F.when(good & (F.col("doc_id") % 10 != 0), F.concat(F.lit("def test_"), F.col("doc_id"), F.lit("(): pass")))
        .otherwise(F.lit(""))
        .alias("spec_code"),
        F.when(good, fixed.STATUS_GENERATED).otherwise(fixed.STATUS_FAILED).alias("status"),
        F.when(~good, F.lit("empty response")).alias("error"),
    )


def unrouted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with whatever spec they have; without a label all of it is NULL."""
    return functions_of_documents(spark, sf_dir).join(specs_of_labels(spark, sf_dir), "doc_id", "left")


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per page, in every project folder of that number."""
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("src/m"), F.col("page_id"), F.lit(".py")).alias("file"),
        F.col("html").alias("text"),
        "page_id",
    )


SPEC_SQL = """
WITH v_function AS (
  SELECT doc_id, source AS project, 'm' || doc_id || '.f' AS id, 'f' AS name, 'f' AS qualified_name,
         'src/m' || doc_id || '.py' AS file, 1 AS line, CAST(n_chars AS INTEGER) AS end_line,
         'def f(): return ' || n_chars AS function_code
  FROM documents),
v_label AS (
  SELECT doc_id,
         CASE WHEN quality = 1 AND doc_id % 10 <> 0 THEN 'def test_' || doc_id || '(): pass' ELSE '' END AS spec_code,
         CASE WHEN quality = 1 THEN 'generated' ELSE 'failed' END AS status,
         CASE WHEN quality <> 1 THEN 'empty response' END AS error
  FROM labels),
v_spec AS (SELECT f.*, l.spec_code, l.status, l.error FROM v_function f LEFT JOIN v_label l ON l.doc_id = f.doc_id),
v_file AS (SELECT 'src/m' || page_id || '.py' AS file, page_id, html AS text FROM pages),
v_routed AS (
  SELECT s.*, f.file IS NOT NULL AS has_source,
         CASE WHEN status IS NULL OR status <> 'generated' OR coalesce(spec_code, '') = '' THEN 'no_spec'
              WHEN f.file IS NULL THEN 'source_file_not_found' END AS skip_reason
  FROM v_spec s LEFT JOIN v_file f ON f.file = s.file)
"""

# --- requirements ------------------------------------------------------------


def requirement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A requirements file per document, one requirement shape per line of text."""

    def shape(line: Column, at: Column) -> Column:
        return (
            F.when(at % 6 == 0, F.concat(F.lower(line), F.lit("==1."), at.cast("string"), F.lit("  # pinned")))
            .when(at % 6 == 1, F.concat(F.lit("pip install "), line))
            .when(at % 6 == 2, F.concat(F.lit("# "), line))
            .when(at % 6 == 3, F.concat(F.lit("PyTest-cov>=2; "), line))
            .when(at % 6 == 4, F.concat(F.lit("\t "), line, F.lit(" \t")))
            .otherwise(F.concat(F.lit("CodeCarbon #egg="), line))
        )

    lines = F.transform(F.split("text", "\n", -1), shape)
    return texts(spark, sf_dir).select(
        F.col("doc_id").alias("project"), F.lit("requirements.txt").alias("file"), F.array_join(lines, "\n").alias("text")
    )


REQUIREMENT_SQL = """
WITH v_text AS (
  SELECT doc_id AS project, unnest(string_split(text, chr(10))) AS l,
         unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents),
v_req AS (
  SELECT project, CAST(i + 1 AS INTEGER) AS line_no,
         CASE i % 6 WHEN 0 THEN lower(l) || '==1.' || i || '  # pinned'
                    WHEN 1 THEN 'pip install ' || l
                    WHEN 2 THEN '# ' || l
                    WHEN 3 THEN 'PyTest-cov>=2; ' || l
                    WHEN 4 THEN chr(9) || ' ' || l || ' ' || chr(9)
                    ELSE 'CodeCarbon #egg=' || l END AS line
  FROM v_text),
v_clean AS (
  SELECT project, line_no, trim(split_part(line, '#', 1), chr(9) || chr(10) || chr(13) || ' ' || chr(160)) AS spec
  FROM v_req),
v_kept AS (SELECT * FROM v_clean WHERE spec <> '' AND NOT starts_with(spec, 'pip ')),
v_tool AS (SELECT unnest(['pytest', 'codecarbon']) AS tool),
v_missing AS (
  SELECT p.project, t.tool AS spec FROM (SELECT doc_id AS project FROM documents) p CROSS JOIN v_tool t
  WHERE NOT EXISTS (SELECT 1 FROM v_kept k WHERE k.project = p.project AND starts_with(lower(k.spec), t.tool)))
"""

# --- lines and patches -------------------------------------------------------


def indented_text(text: Column) -> Column:
    """Text whose lines after the first are indented."""
    return F.replace(text, F.lit("\n"), F.lit("\n    "))


def indented_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("project"),
        F.when(F.col("doc_id") % 10 == 9, F.concat(F.lit("lib/.git/m"), F.col("doc_id")))
        .otherwise(F.concat(F.lit("src/m"), F.col("doc_id"), F.lit(".py")))
        .alias("file"),
        "doc_id",
        indented_text(F.col("text")).alias("text"),
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of labelled documents, some sent twice, some inside others."""

    def patch(first: int, last: int, code: Column, seq: int) -> Column:
        return F.struct(
            F.lit(first).alias("start_line"), F.lit(last).alias("end_line"), code.alias("code"), F.lit(seq).alias("seq")
        )

    number = F.col("doc_id").cast("string")
    good = F.array(
        patch(2, 3, F.lit("stale"), 1),
        patch(2, 3, F.concat(F.lit("  def p():\n    return "), number, F.lit("\n\n  # end")), 2),
        patch(2, 2, F.lit("inner"), 3),
    )
    toxic = F.array(patch(5, 5, F.concat(F.lit("x = "), number), 4))
    none = F.array().cast(good_type := "array<struct<start_line:int,end_line:int,code:string,seq:int>>")
    chosen = F.concat(
        F.when(F.col("quality") == 1, good.cast(good_type)).otherwise(none),
        F.when(F.col("toxic") == 1, toxic.cast(good_type)).otherwise(none),
    )
    return table(spark, sf_dir, "labels").select("doc_id", F.inline(chosen))


def file_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same patches by project and file."""
    places = indented_files(spark, sf_dir).select("doc_id", "project", "file")
    return patches(spark, sf_dir).join(places, "doc_id").drop("doc_id")


PATCH_SQL = """
WITH v_lines AS (
  SELECT doc_id, source AS project,
         CASE WHEN doc_id % 10 = 9 THEN 'lib/.git/m' || doc_id ELSE 'src/m' || doc_id || '.py' END AS file,
         string_split(replace(text, chr(10), chr(10) || '    '), chr(10)) AS lines
  FROM documents),
v_ends AS (
  SELECT *, list_filter(list_transform(range(1, len(lines) + 1),
              lambda i: lines[i] || CASE WHEN i < len(lines) THEN chr(10) ELSE '' END), lambda x: x <> '') AS ends
  FROM v_lines),
v_code AS (
  SELECT e.*, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic,
         coalesce(regexp_extract(lines[2], '^(\\s*)', 1), '') AS in_2,
         coalesce(regexp_extract(lines[5], '^(\\s*)', 1), '') AS in_5
  FROM v_ends e LEFT JOIN labels l ON l.doc_id = e.doc_id),
v_patched AS (
  SELECT doc_id, project, file, good OR toxic AS patched,
         array_to_string(list_concat(
           ends[1:1],
           CASE WHEN good THEN [in_2 || 'def p():' || chr(10) || in_2 || '  return ' || doc_id || chr(10) || chr(10)
                                || in_2 || '# end' || chr(10)] ELSE ends[2:3] END,
           ends[4:4],
           CASE WHEN toxic THEN [in_5 || 'x = ' || doc_id || chr(10)] ELSE ends[5:5] END,
           ends[6:]), '') AS text
  FROM v_code)
"""

# --- modules -----------------------------------------------------------------


def module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python module per document: four lines of code for each line of text.

    In turn a function, a class with a method, a function under ``if`` and a
    function within a function; the text itself goes into comments.
    """

    def block(line: Column, at: Column) -> Column:
        n, length = at.cast("string"), F.length(line).cast("string")
        return (
            F.when(at % 4 == 0, F.concat(F.lit("def f"), n, F.lit("(a, b):\n    # "), line, F.lit("\n    return "), length, F.lit("\n")))
            .when(at % 4 == 1, F.concat(F.lit("class C"), n, F.lit(":\n    async def m(self):\n        return "), length, F.lit("  # "), line, F.lit("\n")))
            .when(at % 4 == 2, F.concat(F.lit("if True:  # "), line, F.lit("\n    def h"), n, F.lit("(): pass\n\n")))
            .otherwise(F.concat(F.lit("def o"), n, F.lit("(x):  # "), line, F.lit("\n    def inner(y, z): return y\n    return inner\n")))
        )

    return texts(spark, sf_dir).select(
        F.col("source").alias("project"),
        F.concat(F.lit("src/m-"), F.col("doc_id"), F.lit(".py")).alias("file"),
        "doc_id",
        F.array_join(F.transform(F.split("text", "\n", -1), block), "\n").alias("text"),
    )


MODULE_SQL = """
WITH v_text AS (
  SELECT source AS project, doc_id, unnest(string_split(text, chr(10))) AS l,
         unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents),
v_def AS (
  SELECT project, doc_id, i, 'f' || i AS qualified_name, 'f' || i AS name, 4 * i + 1 AS line, 4 * i + 3 AS end_line, 2 AS n_args,
         'def f' || i || '(a, b):' || chr(10) || '    return ' || length(l) AS function_code FROM v_text WHERE i % 4 = 0
  UNION ALL
  SELECT project, doc_id, i, 'C' || i || '.m', 'm', 4 * i + 2, 4 * i + 3, 1,
         'async def m(self):' || chr(10) || '    return ' || length(l) FROM v_text WHERE i % 4 = 1
  UNION ALL
  SELECT project, doc_id, i, 'o' || i, 'o' || i, 4 * i + 1, 4 * i + 3, 1,
         'def o' || i || '(x):' || chr(10) || chr(10) || '    def inner(y, z):' || chr(10) || '        return y'
         || chr(10) || '    return inner' FROM v_text WHERE i % 4 = 3
  UNION ALL
  SELECT project, doc_id, i, 'o' || i || '.inner', 'inner', 4 * i + 2, 4 * i + 2, 2,
         'def inner(y, z):' || chr(10) || '    return y' FROM v_text WHERE i % 4 = 3)
"""


def locate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six names looked for in every module."""
    names = F.array(*[F.lit(n) for n in ("f0", "C1.m", "h2", "m", "inner", "o3.inner")])
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("project"),
        F.concat(F.lit("src/m-"), F.col("doc_id"), F.lit(".py")).alias("file"),
        F.explode(names).alias("qualified_name"),
    )


REQUEST_SQL = """
WITH v_request AS (
  SELECT source AS project, 'src/m-' || doc_id || '.py' AS file, len(string_split(text, chr(10))) AS n,
         unnest(['f0', 'C1.m', 'h2', 'm', 'inner', 'o3.inner']) AS qualified_name
  FROM documents)
"""

# --- model responses ---------------------------------------------------------


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as model responses: fenced, half fenced, bare code and prose."""
    text = F.col("text")
    raw = (
        F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("Sure:\n```python\n  "), text, F.lit("\n\n```\nbye")))
        .when(F.col("conv_id") % 4 == 1, F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .when(F.col("conv_id") % 4 == 2, F.concat(F.lit("Here it is\n  def f():\n"), text, F.lit("\n")))
        .otherwise(text)
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", raw.alias("raw"))


RESPONSE_SQL = """
WITH v_response AS (
  SELECT conv_id, turn, text,
    CASE conv_id % 4
      WHEN 0 THEN 'Sure:' || chr(10) || '```python' || chr(10) || '  ' || text || chr(10) || chr(10) || '```' || chr(10) || 'bye'
      WHEN 1 THEN '```' || chr(10) || text || chr(10) || '```'
      WHEN 2 THEN 'Here it is' || chr(10) || '  def f():' || chr(10) || text || chr(10)
      ELSE text END AS raw
  FROM conversations)
"""

# --- archives ----------------------------------------------------------------


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zip archive per document: its text as a module, a note, and the note again."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for number, text, lang in frame.itertuples(index=False):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr("src/", "")
                    archive.writestr(f"src/m{number}.py", text)
                    archive.writestr("../NOTE.md", lang)
                rows.append((f"a{number}.zip", held.getvalue()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    docs = texts(spark, sf_dir).select("doc_id", "text", "lang")
    return docs.mapInPandas(pack, schema="path string, content binary")


ARCHIVE_SQL = """
SELECT 'a' || doc_id || '.zip' AS archive, 'src/m' || doc_id || '.py' AS file, CAST(strlen(text) AS BIGINT) AS n_bytes,
       md5(text) AS digest FROM documents
UNION ALL
SELECT 'a' || doc_id || '.zip', 'NOTE.md', CAST(strlen(lang) AS BIGINT), md5(lang) FROM documents
"""
