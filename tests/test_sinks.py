from __future__ import annotations

import json
import math
import pathlib

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from thriftline import schemas
from thriftline.operators import impact, summary
from thriftline.session import scratch_path
from thriftline.sinks import documents as sink
from thriftline.sinks import trees
from thriftline.sources import documents
from thriftline.streaming import progress
from thriftline.operators import outcome

RESULT = (
    "project string, id string, name string, file string, line int, baseline_emissions_kg double, optimized_emissions_kg double, "
    "reduction_pct double, success boolean, optimization_attempts int, skip_reason string"
)
ROWS = [
    ("p q/1", "a", "f", "x.py", 1, 4.0, 1.0, 75.0, True, 1, None),
    ("p q/1", "b", 'g"\n', "a.py", 9, 4.0, 3.0, 25.0, True, 2, None),
    ("p q/1", "c", "h", "a.py", 5, 8.0, 2.0, 75.0, True, 1, None),
    ("p q/1", "d", "i", "z.py", 1, None, None, 0.0, False, 0, "no_spec"),
    ("p q/1", "e", "j", "b.py", 1, 3.0, None, 0.0, False, 2, None),
    ("p q/1", "m", "k", "b.py", 2, None, None, None, True, 1, None),
    ("other", "x", "y", "only.py", 1, 0.0, None, 0.0, False, 0, "baseline_measurement_failed"),
]


def local(path):
    return pathlib.Path(path.removeprefix("file:"))


def joined(path, part=1 << 20):
    """The documents by project, each from its exported file."""
    spark = SparkSession.getActiveSession()
    found = sink.export_documents(spark, path, scratch_path(spark, "exported"), part).collect()
    whole = {r.project: local(r.uri).read_bytes() for r in found}
    assert {r.project: r.n_bytes for r in found} == {p: len(t) for p, t in whole.items()}
    assert not [p for r in found for p in local(r.uri).parent.iterdir() if p.suffix != ".json"]
    return {p: json.loads(t) for p, t in whole.items()}


def test_savings_document(spark):
    path = scratch_path(spark, "t")
    sink.write_savings_documents(spark.createDataFrame(ROWS, RESULT), path, "2024-01-01T00:00:00+00:00")
    found = joined(path)
    assert set(found) == {"other", "p q/1"}
    full, empty = found["p q/1"], found["other"]
    assert full["project_root"] == "p q/1" and full["generated_at"] == "2024-01-01T00:00:00+00:00"
    assert full["summary"] == {
        "total_functions_analyzed": 6, "functions_optimized": 4, "functions_skipped": 2, "success_rate_pct": 66.7,
        "files_optimized": ["a.py", "b.py", "x.py"], "functions_with_measurements": 3, "avg_co2_reduction_pct": 58.33,
        "max_co2_reduction_pct": 75.0, "min_co2_reduction_pct": 25.0, "total_baseline_emissions_kg": 16.0,
        "total_optimized_emissions_kg": 6.0, "total_co2_saved_kg": 10.0, "total_co2_saved_g": 10000.0,
    }
    # Best first; equal savings by file and line; an unknown one last.
    assert [f["id"] for f in full["optimized_functions"]] == ["c", "a", "b", "m"]
    assert full["optimized_functions"][2]["name"] == 'g"\n' and full["optimized_functions"][3]["co2_saved_kg"] is None
    assert full["skipped_functions"] == [
        {"id": "e", "name": "j", "file": "b.py", "reason": None}, {"id": "d", "name": "i", "file": "z.py", "reason": "no_spec"},
    ]
    costs = full["cost_estimates"]
    assert costs["assumptions"]["annual_training_runs_assumed"] == 1000
    assert costs["per_benchmark_run"]["energy_saved_kwh"] == 10.0 / 0.233
    assert costs["annual_projection"]["eu_ets_carbon_credit_value_usd"] == 10.0 / 1000 * 65.0 * 1000
    assert empty["optimized_functions"] == [] and empty["summary"]["files_optimized"] == []
    assert empty["summary"]["success_rate_pct"] == 0.0 and empty["summary"]["total_co2_saved_kg"] == 0.0


def test_long_document_keeps_order_over_many_tasks(spark):
    rows = spark.range(5000).select(
        F.lit("p").alias("project"), F.concat(F.lit("id"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("id"),
        F.concat(F.lit("f"), F.col("id") % 7).alias("name"), F.lit("n").alias("qualified_name"), F.lit("f.py").alias("file"),
        F.lit("c").alias("function_code"), F.lit("s").alias("spec_code"), F.lit("c").alias("optimized_function_code"),
        F.lit("s").alias("optimized_test_code"), F.when(F.col("id") % 5 == 0, float("nan")).otherwise(F.lit(1.0)).alias("baseline_emissions_kg"),
        F.lit(float("inf")).alias("optimized_emissions_kg"), F.lit(0.0).alias("reduction_pct"), F.lit(False).alias("success"),
        F.lit(0).alias("optimization_attempts"), F.lit(None).cast("string").alias("skip_reason"),
    )
    path = scratch_path(spark, "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sink.write_result_documents(rows, path, "now")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list(local(path).glob("part-*"))) > 3
    functions = joined(path, 10_000)["p"]["functions"]
    assert [f["id"] for f in functions] == [f"id{n:06}" for n in range(5000)]
    assert functions[0]["baseline_emissions_kg"] is None and functions[1]["optimized_emissions_kg"] is None
    assert list(functions[0]) == schemas.RESULT.names
    back = documents.read_section(spark, path, "1-functions", schemas.RESULT)
    assert back.count() == 5000 and back.filter("project = 'p' and baseline_emissions_kg = 1.0").count() == 4000


def test_odd_names_and_repeated_records_make_documents(spark):
    kinds = "project string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.SPEC_RESULT)
    names = ["007", "1e3", "2024-01-01", "a\u2028b", "", None]
    rows = [(p, "i", "f\u2028", "f", "b.py", 1, 2, "c", "", "failed", "why") for p in names for _ in range(3)]
    path = scratch_path(spark, "t")
    sink.write_spec_documents(spark.createDataFrame(rows, kinds), path, "now")
    texts = {}
    for r in sorted(sink.document_texts(spark, path).collect(), key=lambda r: r.place):
        texts[r.project] = texts.get(r.project, "") + r.value
    assert set(texts) == set(names)
    for name, text in texts.items():
        found = json.loads(text)
        assert found["project_root"] == name and [f["name"] for f in found["functions"]] == ["f\u2028"] * 3
    # Every name has a file of its own, NULL and the empty one too.
    exported = joined(path, 50)
    assert {n: d["project_root"] for n, d in exported.items()} == {n: n for n in names}
    back = documents.read_section(spark, path, "1-functions", schemas.SPEC_RESULT)
    assert sorted(str(r.project) for r in back.collect()) == sorted(str(p) for p in names for _ in range(3))


def test_spec_document(spark):
    specs = spark.createDataFrame(
        [("p", "b", "f", "f", "b.py", 1, 2, "c", "", "failed", "why"), ("p", "a", "f", "f", "a.py", 9, 9, "c", "t", "generated", "")],
        "project string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.SPEC_RESULT),
    )
    path = scratch_path(spark, "t")
    sink.write_spec_documents(specs, path, "now")
    document = joined(path)["p"]
    assert [f["id"] for f in document["functions"]] == ["a", "b"] and document["functions"][1]["error"] == "why"


def test_tree_is_written_and_written_again(spark, tmp_path):
    table = spark.createDataFrame([("p", "a/__init__.py", "x"), ("p", "../up.py", "y"), ("q", "m.py", "é")], "project string, file string, content string")
    for _ in range(2):
        trees.write_tree(table, str(tmp_path))
    found = {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
    assert found == {"p/a/__init__.py": "x", "p/up.py": "y", "q/m.py": "é"}


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([], RESULT)
    assert summary.totals(none, []).first()[:] == (0, 0.0, 0.0, 0.0, 0.0)
    assert summary.reductions(none, []).first()[:] == (0.0, 0.0, 0.0)
    assert summary.counts(none, []).first()[:] == (0, 0, 0, 0.0)
    assert summary.report_counts(none, []).first()[:] == (0, 0, 0, 0.0, 0)
    row = impact.with_measured_year(impact.with_measured_run(summary.project_summary(none, []))).first()
    assert row.energy_saved_kwh == 0.0 and row.annual_co2_saved_kg == 0.0


def test_negative_savings_keep_their_credit_value(spark):
    row = impact.with_measured_run(spark.createDataFrame([(-1000.0,)], "total_co2_saved_kg double")).first()
    assert (row.energy_saved_kwh, row.electricity_cost_saved_usd) == (0.0, 0.0)
    assert (row.eu_ets_carbon_credit_value_usd, row.vcm_carbon_credit_value_usd) == (-65.0, -15.0)


def test_assumed_model(spark):
    counts = spark.createDataFrame([(7,)], "optimised_functions bigint")
    row = impact.impact_metrics(counts).first()
    energy = 7 * 0.1
    annual = energy * 0.364 * 1000
    assert row.energy_kwh == energy and row.annual_cost_eur == energy * 0.281 * 1000
    assert row.car_km == annual * 1000 / 120.0 and row.tree_days == annual / 21.0 * 365
    assert math.isclose(row.phone_charges, annual / 0.005) and math.isclose(row.trees, annual / 21)


@pytest.mark.parametrize("mode", [outcome.STRICT, outcome.COMPAT])
def test_stream_ends_where_the_batch_does(spark, tmp_path, mode):
    """Attempts of one function arrive in different micro-batches, some twice."""
    rows = spark.range(2700).select(
        (F.col("id") % 900).alias("f"), (F.floor(F.col("id") / 900) + 1).cast("int").alias("attempt"),
        (F.hash("id") % 3 != 0).alias("test_passed"),
        F.when(F.hash("id") % 7 != 0, F.abs(F.hash("id") % 50).cast("double")).alias("emissions_kg"),
    )
    for n in range(4):
        part = rows.filter(F.abs(F.hash("f", "attempt")) % 4 == n)
        again = rows.filter(F.abs(F.hash("f", "attempt")) % 40 == n)
        part.unionByName(again).coalesce(1).write.mode("append").parquet(str(tmp_path / "landed"))
    bases = spark.range(1000).select(
        F.col("id").alias("f"), (F.col("id") % 40).cast("double").alias("baseline_kg"), (F.col("id") % 11 != 0).alias("baseline_passed")
    )
    landed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "landed"))
    out = str(tmp_path / "out")
    query = progress.publish_attempts(landed, ["f"], out, str(tmp_path / "state"), mode=mode)
    query.awaitTermination()
    assert len(list(pathlib.Path(out).glob("batch=*"))) >= 4
    streamed = progress.current_outcomes(progress.newest(spark, out, ["f"]), bases, ["f"])
    batch = outcome.resolve(bases, rows, ["f"], mode=mode)
    assert streamed.count() == batch.count() == 1000
    assert streamed.select(batch.columns).exceptAll(batch).count() == 0
    assert progress.newest(spark, out, ["f"]).count() == 900
