"""Queries over measurements, outcomes, savings and impact (A, W, V, U, X, M and R operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftline import fixed_values as fixed
from thriftline.functions import numbers as nm
from thriftline.functions import paths, times
from thriftline.operators import generated, impact, measuring, outcome, patching, routing, summary
from thriftline.operators.numbering import numbered
from thriftline.plans import views
from thriftline.plans.registry import query
from thriftline.session import scratch_path, slots
from thriftline.sources import requirements, tree
from thriftline.streaming import expiring, progress

_RUN = ["function_id", "run_id"]


def _sum(column: str, scale: int = 80) -> str:
    """Exact sum of doubles as a whole number of ``2 ** -scale``, rounded once; it has to hold the last bit of each."""
    units = f"sum(CAST({column} * pow(2, {scale}) AS HUGEINT))"
    # Some 60 leading bits with a mark for what is cut off, so that the one rounding is that of the cast.
    shift = "greatest(0, CAST(ceil(log2(CAST(abs(s) AS DOUBLE))) AS INTEGER) - 60)"
    unit = f"CAST(pow(2, {shift}) AS HUGEINT)"
    head = f"(abs(s) // {unit} + CASE WHEN abs(s) % {unit} <> 0 AND abs(s) // {unit} % 2 = 0 THEN 1 ELSE 0 END)"
    value = f"CAST(CAST({head} AS BIGINT) AS DOUBLE) * pow(2, {shift} - {scale}) * CASE WHEN s < 0 THEN -1 ELSE 1 END"
    return f"coalesce(list_transform([{units}], lambda s: CASE WHEN s = 0 THEN 0.0 ELSE {value} END)[1], 0.0)"


def _round(value: str, decimals: int) -> str:
    return f"CAST(format('{{:.{decimals}f}}', CAST({value} AS DOUBLE)) AS DOUBLE)"


# --- A: aggregations ---------------------------------------------------------


@query(
    "a1_status_counts",
    views.SPEC_SQL
    + """
    SELECT project, count(*) FILTER (WHERE status = 'generated') AS generated,
           count(*) FILTER (WHERE coalesce(status, 'failed') = 'failed') AS failed, count(*) AS total
    FROM v_spec GROUP BY project
    """,
)
def a1_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = generated.attach_specs(
        views.functions_of_documents(spark, sf_dir), views.specs_of_labels(spark, sf_dir), ["doc_id"]
    )
    return generated.count_statuses(specs, ["project"])


def _averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = measuring.parse_runs(views.log_lines(spark, sf_dir), _RUN)
    return measuring.average_runs(runs, ["function_id"])


@query(
    "a2_mean_emissions",
    views.LOG_SQL
    + f"""
    SELECT function_id, count(*) AS runs,
           CASE WHEN bool_or(NOT parsed) THEN 0.0 ELSE {_sum('emissions_kg')} / count(*) END AS emissions_kg
    FROM v_runs GROUP BY function_id
    """,
)
def a2_mean_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _averages(spark, sf_dir).select("function_id", "runs", "emissions_kg")


@query(
    "a2_mean_of_parsed_runs",
    views.LOG_SQL
    + f"""
    SELECT run_id, count(*) AS runs, {_sum('emissions_kg')} / count(*) AS emissions_kg, bool_and(exit_code = 0) AS passed
    FROM v_runs WHERE parsed GROUP BY run_id
    """,
)
def a2_mean_of_parsed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in which every run could be read."""
    runs = measuring.parse_runs(views.log_lines(spark, sf_dir), _RUN).filter("parsed")
    return measuring.average_runs(runs, ["run_id"])


@query(
    "a2_unusable_runs",
    views.LOG_SQL
    + f"""
    , v_marked AS (
      SELECT function_id, run_id, seq, CASE WHEN starts_with(line, 'EMISSIONS:') AND seq % 7 = 0 THEN CAST('nan' AS DOUBLE)
             WHEN starts_with(line, 'EMISSIONS:') AND seq % 11 = 0 THEN CAST('inf' AS DOUBLE) ELSE e END AS e, c FROM v_value),
    v_last AS (
      SELECT function_id, run_id, arg_max(e, seq) FILTER (WHERE e IS NOT NULL) AS e, arg_max(c, seq) FILTER (WHERE c IS NOT NULL) AS c
      FROM v_marked GROUP BY function_id, run_id),
    v_finite AS (SELECT *, CASE WHEN isfinite(e) THEN e END AS f FROM v_last WHERE e IS NOT NULL AND c IS NOT NULL)
    SELECT run_id, count(*) AS runs,
           CASE WHEN bool_or(isnan(e)) THEN CAST('nan' AS DOUBLE) WHEN bool_or(isinf(e)) THEN CAST('inf' AS DOUBLE)
                ELSE {_sum('f')} / count(*) END AS emissions_kg, bool_and(c = 0) AS passed
    FROM v_finite GROUP BY run_id
    """,
)
def a2_unusable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some meters print ``nan`` or ``inf``: a mean over such runs is no number, not 0.0."""
    printed = F.startswith("line", F.lit(fixed.EMISSIONS_PREFIX))
    odd = F.when(printed & (F.col("seq") % 7 == 0), fixed.EMISSIONS_PREFIX + "nan").when(
        printed & (F.col("seq") % 11 == 0), fixed.EMISSIONS_PREFIX + "inf"
    )
    lines = views.log_lines(spark, sf_dir).withColumn("line", F.coalesce(odd, F.col("line")))
    return measuring.average_runs(measuring.parse_runs(lines, _RUN).filter("parsed"), ["run_id"])


@query(
    "a3_all_runs_passed",
    views.LOG_SQL
    + """
    SELECT function_id, bool_and(parsed AND coalesce(exit_code = 0, false)) AS passed FROM v_runs GROUP BY function_id
    """,
)
def a3_all_runs_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _averages(spark, sf_dir).select("function_id", "passed")


@query(
    "a4_by_file",
    views.RESULTS_SQL
    + """
    SELECT project, file, id, row_number() OVER (PARTITION BY project, file ORDER BY line, id) AS position,
           count(*) OVER (PARTITION BY project, file) AS in_file
    FROM v_result WHERE success
    """,
)
def a4_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    wins = routing.successes(views.results(spark, sf_dir)).select("project", "file", "line", "id")
    return patching.by_file(wins, ["project", "file"], ["line", "id"]).drop("line")


TOTALS_SQL = (
    views.RESULTS_SQL
    + f"""
    , v_part AS (SELECT DISTINCT project FROM v_result),
    v_sum AS (
      SELECT p.project, count(m.id) AS functions_with_measurements,
             {_sum('m.baseline_emissions_kg')} AS total_baseline_emissions_kg,
             {_sum('m.optimized_emissions_kg')} AS total_optimized_emissions_kg
      FROM v_part p LEFT JOIN v_measured m ON m.project = p.project GROUP BY p.project),
    v_total AS (
      SELECT *, total_baseline_emissions_kg - total_optimized_emissions_kg AS total_co2_saved_kg,
             (total_baseline_emissions_kg - total_optimized_emissions_kg) * 1000 AS total_co2_saved_g FROM v_sum)
    """
)


@query("a5_totals", TOTALS_SQL + "SELECT * FROM v_total")
def a5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.totals(views.results(spark, sf_dir), ["project"])


@query(
    "a5_small_totals",
    views.RESULTS_SQL
    + f"""
    , v_small AS (SELECT project, baseline_emissions_kg * 1e-12 AS b, optimized_emissions_kg * 1e-12 AS o FROM v_measured),
    v_part AS (SELECT DISTINCT project FROM v_result),
    v_sum AS (SELECT p.project, count(s.b) AS functions_with_measurements, {_sum('s.b', 110)} AS total_baseline_emissions_kg,
                     {_sum('s.o', 110)} AS total_optimized_emissions_kg
              FROM v_part p LEFT JOIN v_small s ON s.project = p.project GROUP BY p.project)
    SELECT *, total_baseline_emissions_kg - total_optimized_emissions_kg AS total_co2_saved_kg,
           (total_baseline_emissions_kg - total_optimized_emissions_kg) * 1000 AS total_co2_saved_g FROM v_sum
    """,
)
def a5_small_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short tests emit around 1e-8 kg."""
    small = {c: F.col(c) * 1e-12 for c in ("baseline_emissions_kg", "optimized_emissions_kg")}
    return summary.totals(views.results(spark, sf_dir).withColumns(small), ["project"])


@query(
    "a5_wide_totals",
    """
    SELECT l_suppkey AS project, 3 * count(*) AS functions_with_measurements,
           CAST(sum(l_orderkey) AS DOUBLE) * pow(2, -83) AS total_baseline_emissions_kg,
           CAST(sum(l_linenumber) AS DOUBLE) * pow(2, 83) AS total_optimized_emissions_kg,
           CAST(sum(l_orderkey) AS DOUBLE) * pow(2, -83) - CAST(sum(l_linenumber) AS DOUBLE) * pow(2, 83) AS total_co2_saved_kg,
           (CAST(sum(l_orderkey) AS DOUBLE) * pow(2, -83) - CAST(sum(l_linenumber) AS DOUBLE) * pow(2, 83)) * 1000 AS total_co2_saved_g
    FROM lineitem GROUP BY l_suppkey
    """,
)
def a5_wide_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts from 1e-25 to 1e25 in one sum: the large ones cancel and every bit of the small ones counts."""
    price = F.col("l_extendedprice")
    before = [price * 1e20, -price * 1e20, F.col("l_orderkey") * 2.0**-83]
    after = [price * 1e-28, -price * 1e-28, F.col("l_linenumber") * 2.0**83]
    both = F.arrays_zip(F.array(*before).alias("baseline_emissions_kg"), F.array(*after).alias("optimized_emissions_kg"))
    rows = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("project"), F.lit(True).alias("success"), F.inline(both))
    return summary.totals(rows, ["project"])


_REDUCTIONS = f"""
    {_round(f"coalesce({_sum('m.reduction_pct')} / nullif(count(m.reduction_pct), 0), 0.0)", 2)} AS avg_co2_reduction_pct,
    {_round("coalesce(max(m.reduction_pct), 0.0)", 2)} AS max_co2_reduction_pct,
    {_round("coalesce(min(m.reduction_pct), 0.0)", 2)} AS min_co2_reduction_pct
"""


@query(
    "a6_reductions",
    TOTALS_SQL
    + f"SELECT p.project, {_REDUCTIONS} FROM v_part p LEFT JOIN v_measured m ON m.project = p.project GROUP BY p.project",
)
def a6_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.reductions(views.results(spark, sf_dir), ["project"])


@query(
    "a7_touched_files",
    views.RESULTS_SQL
    + """
    SELECT project, file, row_number() OVER (PARTITION BY project ORDER BY file) AS position
    FROM (SELECT DISTINCT project, file FROM v_result WHERE success)
    """,
)
def a7_touched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.files_optimized_in_order(views.results(spark, sf_dir), ["project"])


_COUNTS = f"""
    count(*) AS total_functions_analyzed, count(*) FILTER (WHERE success) AS functions_optimized,
    count(*) FILTER (WHERE NOT success) AS functions_skipped,
    {_round("count(*) FILTER (WHERE success) / count(*) * 100", 1)} AS success_rate_pct
"""


@query("a8_summary_counts", views.RESULTS_SQL + f"SELECT project, {_COUNTS} FROM v_result GROUP BY project")
def a8_summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.counts(views.results(spark, sf_dir), ["project"])


_REPORT_SQL = (
    views.RESULTS_SQL
    + """
    , v_count AS (
      SELECT project, count(*) AS total_functions, count(*) FILTER (WHERE success) AS optimised_functions,
             count(*) FILTER (WHERE NOT success) AS failed_functions,
             count(*) FILTER (WHERE success) / count(*) * 100 AS success_rate,
             count(DISTINCT CASE WHEN success THEN file END) AS files_touched
      FROM v_result GROUP BY project),
    v_impact_run AS (
      SELECT *, optimised_functions * CAST(0.1 AS DOUBLE) AS energy_kwh,
             optimised_functions * CAST(0.1 AS DOUBLE) * CAST(0.364 AS DOUBLE) AS co2_kg,
             optimised_functions * CAST(0.1 AS DOUBLE) * CAST(0.281 AS DOUBLE) AS cost_eur FROM v_count),
    v_impact_year AS (
      SELECT *, energy_kwh * 1000 AS annual_energy_kwh, co2_kg * 1000 AS annual_co2_kg, cost_eur * 1000 AS annual_cost_eur
      FROM v_impact_run)
    """
)


def _report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.report_counts(views.results(spark, sf_dir), ["project"])


@query("a9_report_counts", _REPORT_SQL + "SELECT * FROM v_count")
def a9_report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report_counts(spark, sf_dir)


@query(
    "a10_success_line",
    views.RESULTS_SQL
    + """
    SELECT project, count(*) FILTER (WHERE success) AS successful, count(*) AS total,
           count(*) FILTER (WHERE success) || '/' || count(*) AS label FROM v_result GROUP BY project
    """,
)
def a10_success_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.success_line(views.results(spark, sf_dir), ["project"])


_SUMMARY_SQL = (
    TOTALS_SQL
    + f"""
    , v_counts AS (SELECT project, {_COUNTS} FROM v_result GROUP BY project),
    v_reductions AS (SELECT p.project, {_REDUCTIONS} FROM v_part p LEFT JOIN v_measured m ON m.project = p.project GROUP BY p.project),
    v_summary AS (SELECT * FROM v_counts JOIN v_reductions USING (project) JOIN v_total USING (project)),
    v_run AS (
      SELECT *, CASE WHEN total_co2_saved_kg > 0 THEN total_co2_saved_kg / CAST(0.233 AS DOUBLE) ELSE 0.0 END AS energy_saved_kwh FROM v_summary),
    v_money AS (
      SELECT *, energy_saved_kwh * CAST(0.10 AS DOUBLE) AS electricity_cost_saved_usd,
             total_co2_saved_kg / 1000 * CAST(65.0 AS DOUBLE) AS eu_ets_carbon_credit_value_usd,
             total_co2_saved_kg / 1000 * CAST(15.0 AS DOUBLE) AS vcm_carbon_credit_value_usd FROM v_run)
    """
)
_YEAR = """
    total_co2_saved_kg * 1000 AS annual_co2_saved_kg, energy_saved_kwh * 1000 AS annual_energy_saved_kwh,
    electricity_cost_saved_usd * 1000 AS annual_electricity_cost_saved_usd,
    eu_ets_carbon_credit_value_usd * 1000 AS annual_eu_ets_carbon_credit_value_usd,
    vcm_carbon_credit_value_usd * 1000 AS annual_vcm_carbon_credit_value_usd
"""


@query("a11_savings_summary", _SUMMARY_SQL + f"SELECT *, {_YEAR} FROM v_money")
def a11_savings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scalar of the savings document; its lists are V2, P12 and A7."""
    scalars = summary.project_summary(views.results(spark, sf_dir), ["project"])
    return impact.with_measured_year(impact.with_measured_run(scalars))


@query(
    "a12_file_counts",
    views.PATH_SQL
    + """
    SELECT project, count(*) FILTER (WHERE is_python AND NOT excluded AND NOT is_test) AS source_files,
           count(*) FILTER (WHERE is_python AND NOT excluded AND is_test) AS test_files FROM v_class GROUP BY project
    """,
)
def a12_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.count_files(views.paths_table(spark, sf_dir), ["project"])


# --- W: ordered logic --------------------------------------------------------


@query("w1_parsed_runs", views.LOG_SQL + "SELECT function_id, run_id, emissions_kg, exit_code, parsed FROM v_runs")
def w1_parsed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measuring.parse_runs(views.log_lines(spark, sf_dir), _RUN)


@query(
    "w2_first_measurement",
    views.LOG_SQL
    + """
    , v_first AS (SELECT *, row_number() OVER (PARTITION BY function_id, run_id ORDER BY seq) AS n
                  FROM v_value WHERE starts_with(line, 'EMISSIONS:'))
    SELECT r.function_id, r.run_id, f.e AS emissions_kg,
           CASE WHEN f.n IS NULL THEN 'no emissions line' WHEN f.e IS NULL THEN 'unreadable emissions value' END AS reason
    FROM v_run r LEFT JOIN (SELECT * FROM v_first WHERE n = 1) f ON f.function_id = r.function_id AND f.run_id = r.run_id
    """,
)
def w2_first_measurement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measuring.first_measurement(views.log_lines(spark, sf_dir), _RUN)


_OUTCOME_COLUMNS = (
    "function_id, file_id, project, baseline_emissions_kg, optimized_emissions_kg, success, "
    "optimization_attempts, reduction_pct, skip_reason"
)


@query("w3_attempt_outcome", views.RESULTS_SQL + f"SELECT {_OUTCOME_COLUMNS} FROM v_outcome")
def w3_attempt_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.outcomes(spark, sf_dir).select(*_OUTCOME_COLUMNS.split(", "))


@query(
    "w3_outcome_classes",
    views.RESULTS_SQL
    + """
    SELECT CASE WHEN skip_reason IS NOT NULL THEN skip_reason WHEN success THEN 'win at ' || optimization_attempts
                WHEN optimization_attempts = 0 THEN 'no attempts' ELSE 'no improvement' END AS outcome, count(*) AS n
    FROM v_outcome GROUP BY ALL
    """,
)
def w3_outcome_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = views.outcomes(spark, sf_dir).select(outcome.outcome_label().alias("outcome"))
    return labelled.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "w4_retry_reason",
    views.RESULTS_SQL
    + """
    , v_pair AS (
      SELECT a.function_id, a.attempt, CASE WHEN NOT a.test_passed THEN 'test suite failed'
               WHEN NOT a.emissions_kg < j.baseline_kg
               THEN format('{:.1f}', (a.emissions_kg - j.baseline_kg) / j.baseline_kg * 100) || '% worse emissions than baseline' END AS refused_because
      FROM v_attempt a JOIN v_judged j ON j.function_id = a.function_id WHERE j.usable)
    SELECT *, lag(refused_because) OVER (PARTITION BY function_id ORDER BY attempt) AS retry_reason FROM v_pair
    """,
)
def w4_retry_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = outcome.with_retry_reasons(views.attempts(spark, sf_dir), views.baselines(spark, sf_dir), ["function_id"])
    return told.select("function_id", "attempt", "refused_because", "retry_reason")


_REFUSED = """CASE WHEN NOT test_passed THEN 'test suite failed' WHEN kg IS NULL THEN 'emissions could not be read'
    WHEN NOT kg < baseline_kg THEN format('{:.1f}', (kg - baseline_kg) / baseline_kg * 100) || '% worse emissions than baseline' END"""


@query(
    "w4_unreadable_attempts",
    views.RESULTS_SQL
    + f"""
    , v_read AS (
      SELECT a.function_id, a.attempt, a.test_passed, j.baseline_kg,
             CASE WHEN (a.function_id + a.attempt) % 5 <> 0 THEN a.emissions_kg END AS given
      FROM v_attempt a JOIN v_judged j ON j.function_id = a.function_id WHERE j.usable),
    v_mode AS (SELECT *, 'strict' AS mode, given AS kg FROM v_read UNION ALL SELECT *, 'compat', coalesce(given, 0.0) FROM v_read),
    v_refused AS (SELECT mode, function_id, attempt, {_REFUSED} AS refused_because FROM v_mode)
    SELECT *, lag(refused_because) OVER (PARTITION BY mode, function_id ORDER BY attempt) AS retry_reason FROM v_refused
    """,
)
def w4_unreadable_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements that gave nothing, under both modes."""
    read = F.when((F.col("function_id") + F.col("attempt")) % 5 != 0, F.col("emissions_kg"))
    given = views.attempts(spark, sf_dir).withColumn("emissions_kg", read)
    known = views.baselines(spark, sf_dir)
    told = [
        outcome.with_retry_reasons(given, known, ["function_id"], mode=mode).withColumn("mode", F.lit(mode))
        for mode in (outcome.STRICT, outcome.COMPAT)
    ]
    return told[0].unionByName(told[1]).select("mode", "function_id", "attempt", "refused_because", "retry_reason")


@query(
    "w5_progress_label",
    views.RESULTS_SQL
    + """
    , v_n AS (SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY file, line, id) AS i,
                     count(*) OVER (PARTITION BY project) AS n FROM v_result)
    SELECT *, i || '/' || n AS label FROM v_n
    """,
)
def w5_progress_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = views.named(views.baselines(spark, sf_dir)).select("project", "id", "file", "line")
    return generated.progress_labels(functions, ["project"], ["file", "line", "id"]).drop("file", "line")


@query(
    "w6_outermost_patches",
    """
    WITH p AS (
      SELECT doc_id, 2 AS start_line, 3 AS end_line, 2 AS seq, '  def p():' || chr(10) || '    return ' || doc_id || chr(10) || chr(10) || '  # end' AS code,
             false AS "inner" FROM labels WHERE quality = 1
      UNION ALL SELECT doc_id, 2, 2, 3, 'inner', true FROM labels WHERE quality = 1
      UNION ALL SELECT doc_id, 5, 5, 4, 'x = ' || doc_id, false FROM labels WHERE toxic = 1)
    SELECT * FROM p
    """,
)
def w6_outermost_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    single = patching.single_patches(views.patches(spark, sf_dir), ["doc_id"])
    return patching.with_overlap_flag(single, ["doc_id"])


@query(
    "w6_chained_patches",
    """
    SELECT c_custkey AS doc_id, unnest([1, 2, 4, 8, 8]) AS start_line, unnest([5, 3, 10, 12, 9]) AS end_line,
           unnest([false, true, true, false, true]) AS "inner" FROM customer
    """,
)
def w6_chained_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1-5 stands, 4-10 overlaps it and goes, so 8-12 overlaps nothing that stands."""
    spans = [(4, 10), (8, 9), (1, 5), (8, 12), (2, 3)]
    items = F.array(*[F.struct(F.lit(a).alias("start_line"), F.lit(b).alias("end_line")) for a, b in spans])
    chained = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.inline(items))
    return patching.with_overlap_flag(chained, ["doc_id"])


@query(
    "w6_many_patches",
    """
    WITH RECURSIVE p AS (
      SELECT l_linenumber % 2 AS doc_id, l_orderkey * 8 + l_linenumber AS start_line,
             max(l_orderkey * 8 + l_linenumber + CAST(l_quantity AS BIGINT)) AS end_line FROM lineitem GROUP BY ALL),
    stands AS (
      SELECT doc_id, start_line, end_line FROM p QUALIFY start_line = min(start_line) OVER (PARTITION BY doc_id)
      UNION ALL
      SELECT n.doc_id, n.start_line, n.end_line FROM stands s JOIN LATERAL (
        SELECT * FROM p WHERE p.doc_id = s.doc_id AND p.start_line > s.end_line ORDER BY p.start_line LIMIT 1) n ON true)
    SELECT p.*, s.start_line IS NULL AS "inner" FROM p LEFT JOIN stands s ON s.doc_id = p.doc_id AND s.start_line = p.start_line
    """,
)
def w6_many_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as ranges of two files."""
    at = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    ranges = views.table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") % 2).alias("doc_id"), at.alias("start_line")).agg(
        F.max(at + F.col("l_quantity").cast("bigint")).alias("end_line")
    )
    return patching.with_overlap_flag(ranges, ["doc_id"])


# --- V: orders ---------------------------------------------------------------


@query(
    "v1_sorted_files",
    views.PATH_SQL
    + """
    SELECT project, file, row_number() OVER (PARTITION BY project ORDER BY string_split(file, '/')) AS position FROM v_path
    """,
)
def v1_sorted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.paths_table(spark, sf_dir).select("project", "file")
    return numbered(files, ["project"], [paths.path_sort_key(F.col("file"))])


_SAVED = """
    project, id, name, file, baseline_emissions_kg, optimized_emissions_kg,
    baseline_emissions_kg - optimized_emissions_kg AS co2_saved_kg, reduction_pct, optimization_attempts
"""


@query(
    "v2_ranked_savings",
    views.RESULTS_SQL
    + f"""
    SELECT {_SAVED}, row_number() OVER (PARTITION BY project ORDER BY reduction_pct DESC NULLS LAST, file, line, id) AS rank
    FROM v_result WHERE success
    """,
)
def v2_ranked_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.ranked_savings(views.results(spark, sf_dir), ["project"]).drop("line")


@query(
    "v2_top_savings",
    views.RESULTS_SQL
    + f"SELECT {_SAVED} FROM v_result WHERE success ORDER BY reduction_pct DESC NULLS LAST, file, line, id, project LIMIT 20",
)
def v2_top_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top-k report."""
    return summary.top_savings(views.results(spark, sf_dir), ["project"], 20).drop("line")


# --- U: set operations -------------------------------------------------------

_UNION_SQL = (
    views.SPEC_SQL
    + ", "
    + views.RESULTS_SQL.strip()[len("WITH "):]
    + """
    SELECT project, id, success, optimization_attempts, baseline_emissions_kg, skip_reason FROM v_result
    UNION ALL
    SELECT project, id, false, 0, NULL, {reason} FROM {skipped}
    """
)


@query("u1_all_records", _UNION_SQL.format(reason="skip_reason", skipped="v_routed WHERE skip_reason IS NOT NULL"))
def u1_all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = routing.route(views.unrouted(spark, sf_dir), views.page_files(spark, sf_dir), ["file"])
    skipped = routing.skipped_records(routed, ["project"])
    done = routing.final_records(views.results(spark, sf_dir), ["project"])
    return routing.all_records(skipped, done).select(
        "project", "id", "success", "optimization_attempts", "baseline_emissions_kg", "skip_reason"
    )


@query(
    "u2_nothing_eligible",
    "SELECT source AS project, 'm' || doc_id || '.f' AS id, false AS success, 'no_spec' AS skip_reason FROM documents",
)
def u2_nothing_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No function has a spec: the processed side is empty and only skipped records come out."""
    bare = views.functions_of_documents(spark, sf_dir).withColumns(
        {"spec_code": F.lit(""), "status": F.lit("failed"), "error": F.lit("")}
    )
    routed = routing.route(bare, views.page_files(spark, sf_dir), ["file"])
    work = routing.eligible(routed).drop("skip_reason").select(
        "*", F.col("doc_id").alias("function_id"), F.lit(1.0).alias("baseline_kg"), F.lit(True).alias("baseline_passed")
    )
    decided = outcome.resolve(work, views.attempt_rows(views.table(spark, sf_dir, "lineitem")), ["function_id"])
    done = routing.final_records(decided.withColumn("optimized_function_code", F.lit("")), ["project"])
    return routing.all_records(routing.skipped_records(routed, ["project"]), done).select(
        "project", "id", "success", "skip_reason"
    )


@query(
    "u3_shared_parts",
    views.PATH_SQL
    + """
    SELECT doc_id, CASE WHEN starts_with(file, 'Tests/') THEN 'tests' ELSE '' END AS shared FROM v_path
    """,
)
def u3_shared_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = F.array_join(paths.test_parts(F.col("file")), ",")
    return views.paths_table(spark, sf_dir).select("doc_id", shared.alias("shared"))


@query(
    "u4_required_tools",
    views.REQUIREMENT_SQL
    + "SELECT project, spec, false AS added FROM v_kept UNION ALL SELECT project, spec, true FROM v_missing",
)
def u4_required_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.requirement_files(spark, sf_dir)
    clean = requirements.clean_requirements(requirements.requirements_of_tree(files), ["project"])
    return requirements.with_required_tools(clean, files, ["project"])


@query(
    "u4_project_requirements",
    views.REQUIREMENT_SQL
    + """
    SELECT 'a' || project AS archive, spec, false AS added FROM v_kept WHERE project % 4 <> 3
    UNION ALL SELECT 'a' || project, spec, true FROM v_missing WHERE project % 4 <> 3
    UNION ALL SELECT 'a' || doc_id, unnest(['pytest', 'codecarbon']), true FROM documents WHERE doc_id % 4 = 3
    """,
)
def u4_project_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements in the root, in the root though the parent has some too, in the parent, and elsewhere only."""
    shape = F.col("project") % 4
    root = F.when(shape == 0, "").when(shape == 1, "src").when(shape == 2, "src/app").otherwise("src")
    used = F.when(shape == 0, "requirements.txt").when(shape == 3, "docs/requirements.txt").otherwise("src/requirements.txt")
    given = views.requirement_files(spark, sf_dir).select(
        "project", F.concat(F.lit("a"), "project").alias("archive"), root.alias("root"), used.alias("file"), "text"
    )
    beside = given.filter(shape == 1).select("archive", F.lit("requirements.txt").alias("file"), F.lit("unused==1").alias("text"))
    files = given.select("archive", "file", "text").unionByName(beside)
    return requirements.project_requirements(given.select("archive", "root"), files).drop("root")


@query("u5_distinct_files", views.RESULTS_SQL + "SELECT DISTINCT project, file FROM v_result WHERE success")
def u5_distinct_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.files_optimized(views.results(spark, sf_dir), ["project"])


# --- X: scalars --------------------------------------------------------------

_TRIED_SQL = views.RESULTS_SQL + """
    , v_every AS (SELECT l_orderkey AS function_id, l_linenumber AS attempt, bool_and(l_returnflag <> 'R') AS test_passed,
                         min(l_extendedprice) AS emissions_kg FROM lineitem GROUP BY ALL),
    v_tried AS (SELECT a.function_id, a.attempt, a.test_passed, a.emissions_kg, b.baseline_kg
                FROM v_every a JOIN v_baseline b ON b.function_id = a.function_id)
"""


def _tried(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = views.baselines(spark, sf_dir).select("function_id", "baseline_kg")
    return views.every_attempt(spark, sf_dir).join(known, "function_id")


@query(
    "x1_reduction_pct",
    _TRIED_SQL
    + """
    SELECT function_id, attempt, CASE WHEN test_passed AND baseline_kg > 0 THEN (baseline_kg - emissions_kg) / baseline_kg * 100 ELSE 0.0 END AS reduction_pct
    FROM v_tried
    """,
)
def x1_reduction_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    pct = nm.reduction_pct(F.col("test_passed"), F.col("baseline_kg"), F.col("emissions_kg"))
    return _tried(spark, sf_dir).select("function_id", "attempt", pct.alias("reduction_pct"))


@query(
    "x2_change_label",
    _TRIED_SQL
    + """
    SELECT function_id, attempt, CASE WHEN emissions_kg < baseline_kg THEN 'better' ELSE 'worse' END AS label,
           CASE WHEN baseline_kg > 0 THEN abs((emissions_kg - baseline_kg) / baseline_kg * 100) END AS pct FROM v_tried
    """,
)
def x2_change_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = F.col("baseline_kg"), F.col("emissions_kg")
    pct = F.when(nm.is_positive(before), F.abs(nm.pct_worse(before, after)))
    return _tried(spark, sf_dir).select(
        "function_id", "attempt", nm.change_label(before, after).alias("label"), pct.alias("pct")
    )


@query(
    "x3_pct_worse",
    _TRIED_SQL
    + """
    SELECT function_id, attempt, CASE WHEN baseline_kg > 0 THEN (emissions_kg - baseline_kg) / baseline_kg * 100 ELSE 0.0 END AS pct_worse
    FROM v_tried
    """,
)
def x3_pct_worse(spark: SparkSession, sf_dir: str) -> DataFrame:
    worse = nm.pct_worse(F.col("baseline_kg"), F.col("emissions_kg"))
    return _tried(spark, sf_dir).select("function_id", "attempt", worse.alias("pct_worse"))


@query(
    "x4_saved_kg",
    views.RESULTS_SQL + "SELECT project, id, baseline_emissions_kg - optimized_emissions_kg AS co2_saved_kg FROM v_result",
)
def x4_saved_kg(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = nm.saved_kg(F.col("baseline_emissions_kg"), F.col("optimized_emissions_kg"))
    return views.results(spark, sf_dir).select("project", "id", saved.alias("co2_saved_kg"))


@query("x5_units", "SELECT o_orderkey, o_totalprice * 1000 AS g, o_totalprice / 1000 AS t FROM orders")
def x5_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    kg = F.col("o_totalprice")
    return views.table(spark, sf_dir, "orders").select("o_orderkey", nm.kg_to_g(kg).alias("g"), nm.kg_to_t(kg).alias("t"))


@query(
    "x6_magnitude",
    """
    WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice * 100 WHEN 1 THEN o_totalprice
                                   WHEN 2 THEN o_totalprice / 1000 ELSE -o_totalprice END AS n FROM orders)
    SELECT o_orderkey, CASE WHEN n >= 1000000 THEN format('{:,.1f}', n / 1000000) || 'M'
                            WHEN n >= 1000 THEN format('{:,.1f}', n / 1000) || 'k' ELSE format('{:,.1f}', n) END AS one_decimal,
           CASE WHEN n >= 1000000 THEN format('{:,.0f}', n / 1000000) || 'M'
                WHEN n >= 1000 THEN format('{:,.0f}', n / 1000) || 'k' ELSE format('{:,.0f}', n) END AS no_decimal
    FROM t
    """,
)
def x6_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, shape = F.col("o_totalprice"), F.col("o_orderkey") % 4
    n = F.when(shape == 0, price * 100).when(shape == 1, price).when(shape == 2, price / 1000).otherwise(-price)
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey", nm.magnitude(n, 1).alias("one_decimal"), nm.magnitude(n, 0).alias("no_decimal")
    )


@query(
    "x7_rounded",
    f"""
    SELECT l_orderkey, l_linenumber, l_extendedprice, {_round('l_extendedprice / 8', 2)} AS two, {_round('l_quantity / 4', 1)} AS one
    FROM lineitem
    """,
)
def x7_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        nm.round_even(F.col("l_extendedprice") / 8, 2).alias("two"),
        nm.round_even(F.col("l_quantity") / 4, 1).alias("one"),
    )


@query(
    "x11_stamp_texts",
    """
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS local_text,
           strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS utc_text,
           strftime(ts, '%B %d, %Y') AS day_text FROM events
    """,
)
def x11_stamp_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts")
    return views.table(spark, sf_dir, "events").select(
        "event_id",
        times.iso_text(at).alias("local_text"),
        times.iso_text(at, utc=True).alias("utc_text"),
        times.long_date(at).alias("day_text"),
    )


@query(
    "x12_sanitized",
    """
    WITH t AS (SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_linenumber % 3 = 2 THEN l_tax END AS v FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_extendedprice, v AS plain, v AS in_array, v AS in_struct, l_extendedprice AS kept FROM t
    """,
)
def x12_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("l_linenumber") % 3
    v = F.when(kind == 0, F.lit(float("nan"))).when(kind == 1, F.lit(float("-inf"))).otherwise(F.col("l_tax"))
    nested = views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        v.alias("plain"),
        F.array(v, F.col("l_extendedprice")).alias("items"),
        F.struct(v.alias("inner"), F.lit("text").alias("label")).alias("record"),
    )
    return nm.sanitize(nested).select(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        "plain",
        F.get("items", F.lit(0)).alias("in_array"),
        F.col("record.inner").alias("in_struct"),
        F.get("items", F.lit(1)).alias("kept"),
    )


@query(
    "x13_defaults",
    views.SPEC_SQL
    + "SELECT doc_id, coalesce(spec_code, '') AS spec_code, coalesce(status, 'failed') AS status, coalesce(error, 'none') AS error FROM v_spec",
)
def x13_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.unrouted(spark, sf_dir).select("doc_id", "spec_code", "status", "error").fillna(
        {"spec_code": "", "status": "failed", "error": "none"}
    )


# --- M: impact models --------------------------------------------------------


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.totals(views.results(spark, sf_dir), ["project"]).select("project", "total_co2_saved_kg")


_RUN_COLUMNS = (
    "project, total_co2_saved_kg, energy_saved_kwh, electricity_cost_saved_usd, "
    "eu_ets_carbon_credit_value_usd, vcm_carbon_credit_value_usd"
)


@query("m1_measured_run", _SUMMARY_SQL + f"SELECT {_RUN_COLUMNS} FROM v_money")
def m1_measured_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.with_measured_run(_totals(spark, sf_dir))


@query("m2_measured_year", _SUMMARY_SQL + f"SELECT project, total_co2_saved_kg, {_YEAR} FROM v_money")
def m2_measured_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.with_measured_year(_totals(spark, sf_dir))


@query(
    "m3_assumptions",
    _SUMMARY_SQL
    + """
    SELECT project, energy_saved_kwh, CAST(0.233 AS DOUBLE) AS carbon_intensity_kg_per_kwh, CAST(0.10 AS DOUBLE) AS electricity_price_usd_per_kwh,
           CAST(65.0 AS DOUBLE) AS eu_ets_carbon_price_usd_per_tonne, CAST(15.0 AS DOUBLE) AS vcm_carbon_price_usd_per_tonne,
           1000 AS annual_training_runs_assumed FROM v_money
    """,
)
def m3_assumptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = impact.cost_estimates(F.col("total_co2_saved_kg"))
    nested = _totals(spark, sf_dir).select("project", block.alias("costs"))
    return nested.select("project", "costs.per_benchmark_run.energy_saved_kwh", "costs.assumptions.*")


@query(
    "m4_assumed_run",
    _REPORT_SQL + "SELECT project, optimised_functions, energy_kwh, co2_kg, cost_eur FROM v_impact_run",
)
def m4_assumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.with_assumed_run(_report_counts(spark, sf_dir).select("project", "optimised_functions"))


@query(
    "m5_assumed_year",
    _REPORT_SQL + "SELECT project, annual_energy_kwh, annual_co2_kg, annual_cost_eur FROM v_impact_year",
)
def m5_assumed_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = impact.with_assumed_year(impact.with_assumed_run(_report_counts(spark, sf_dir)))
    return year.select("project", "annual_energy_kwh", "annual_co2_kg", "annual_cost_eur")


@query(
    "m6_equivalents",
    _REPORT_SQL
    + """
    , v_amount AS (
      SELECT project, 'car_km' AS equivalent, annual_co2_kg * 1000 / CAST(120 AS DOUBLE) AS amount FROM v_impact_year
      UNION ALL SELECT project, 'phone_charges', annual_co2_kg / CAST(0.005 AS DOUBLE) FROM v_impact_year
      UNION ALL SELECT project, 'streaming_hours', annual_co2_kg / CAST(0.036 AS DOUBLE) FROM v_impact_year
      UNION ALL SELECT project, 'tree_days', annual_co2_kg / CAST(21 AS DOUBLE) * 365 FROM v_impact_year
      UNION ALL SELECT project, 'trees', annual_co2_kg / CAST(21 AS DOUBLE) FROM v_impact_year)
    SELECT *, CASE WHEN amount >= 1000000 THEN format('{:,.1f}', amount / 1000000) || 'M'
                   WHEN amount >= 1000 THEN format('{:,.1f}', amount / 1000) || 'k' ELSE format('{:,.1f}', amount) END AS display
    FROM v_amount
    """,
)
def m6_equivalents(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = impact.with_assumed_year(impact.with_assumed_run(_report_counts(spark, sf_dir)))
    return impact.equivalent_rows(year, ["project"])


# --- R: streaming ------------------------------------------------------------


def _streamed(spark: SparkSession, source: str, schema, options: dict) -> str:
    """Publish the attempts of a folder of line items; gives where."""
    landed = spark.readStream.schema(schema).options(**options).parquet(source)
    out = scratch_path(spark, "attempts")
    progress.publish_attempts(
        views.attempt_rows(landed), ["function_id"], out, scratch_path(spark, "attempts-progress")
    ).awaitTermination()
    return out


@query("r1_published_outcomes", views.RESULTS_SQL + f"SELECT {_OUTCOME_COLUMNS} FROM v_outcome")
def r1_published_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts stream in from the given table; the end state equals the batch result."""
    # The file stream source takes folders and globs; a table may be a single file.
    schema = views.table(spark, sf_dir, "lineitem").schema
    out = _streamed(spark, f"{sf_dir}/lineitem.parque[t]", schema, {})
    seen = progress.newest(spark, out, ["function_id"])
    current = progress.current_outcomes(seen, views.baselines(spark, sf_dir), ["function_id"])
    return current.select(*_OUTCOME_COLUMNS.split(", "))


@query("r1_late_baselines", views.RESULTS_SQL + f"SELECT {_OUTCOME_COLUMNS} FROM v_outcome")
def r1_late_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All attempts land first, over several micro-batches; the baselines come last."""
    items = views.table(spark, sf_dir, "lineitem")
    folder = scratch_path(spark, "landed")
    n_files = slots(spark)
    items.repartition(n_files, "l_linenumber", "l_orderkey").write.parquet(folder)
    out = _streamed(spark, folder, items.schema, {"maxFilesPerTrigger": str(-(-n_files // 4))})
    seen = progress.merged(spark, out, ["function_id"])
    current = progress.current_outcomes(seen, views.baselines(spark, sf_dir), ["function_id"])
    return current.select(*_OUTCOME_COLUMNS.split(", "))


@query("r1_expired_state", views.RESULTS_SQL + f"SELECT {_OUTCOME_COLUMNS} FROM v_outcome")
def r1_expired_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each attempt number lands a day after the one before; state ends after an hour, so each batch finds none."""
    items = views.attempt_rows(views.table(spark, sf_dir, "lineitem"))
    landed = items.withColumn("landed_at", F.timestamp_seconds(F.col("attempt").cast("bigint") * 86_400))
    folder, out, kept = (scratch_path(spark, name) for name in ("landed", "attempts", "current"))
    last = fixed.MAX_ATTEMPTS + 1
    schema = landed.schema
    folded = None
    for number in range(1, last + 1):
        own = F.col("attempt") == number if number < last else F.col("attempt") >= number
        landed.where(own).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        expiring.publish_expiring(
            stream, ["function_id"], out, f"{folder}-progress", ttl_ms=3_600_000, delay="0 seconds"
        ).awaitTermination()
        if number < last:
            folded = expiring.fold(spark, out, kept, ["function_id"], folded)
    seen = expiring.current(spark, out, ["function_id"], folded)
    current = progress.current_outcomes(seen, views.baselines(spark, sf_dir), ["function_id"])
    return current.select(*_OUTCOME_COLUMNS.split(", "))
