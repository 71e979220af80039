"""One small corpus through all three phases."""

from __future__ import annotations

import ast
import io
import zipfile

from pyspark.sql import functions as F

from thriftline.operators import summary
from thriftline.plans import lifecycle
from thriftline.session import written
from thriftline.sources import archives

GOOD = "class A:\n    def slow(self, n):\n        return sum(range(n))\n\n    def kept(self):\n        return 1\n\n\ndef top():\n    def inner():\n        return 2\n    return inner\n"


def pack(members):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for name, text in members.items():
            archive.writestr(name, text)
    return bytearray(held.getvalue())


def test_three_phases(spark, tmp_path):
    blobs = [
        ("one.zip", pack({"proj/requirements.txt": "numpy", "proj/m.py": GOOD, "proj/tests/test_m.py": "x", "proj/bad.py": "def f(:", "proj/.git/config": "s", "readme": "r"})),
        ("two.zip", pack({"main.py": "def go():\n    return 0", "venv/lib.py": "def no(): pass"})),
    ]
    members = archives.expand_archives(spark.createDataFrame(blobs, "path string, content binary"))
    files = written(lifecycle.project_files(members), "files")
    for name, blob in blobs:
        (tmp_path / name).write_bytes(blob)
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    opened = lifecycle.open_projects(spark, str(tmp_path)).withColumn("project", F.substring_index("project", "/", -1))
    assert opened.select(files.columns).exceptAll(files).isEmpty() and files.exceptAll(opened.select(files.columns)).isEmpty()
    functions = written(lifecycle.functions_of(files), "functions")
    ids = {(r.project, r.id): r.line for r in functions.collect()}
    assert set(ids) == {("one.zip", "m.A.slow"), ("one.zip", "m.A.kept"), ("one.zip", "m.top"), ("one.zip", "m.top.inner"), ("two.zip", "main.go")}

    def keyed(rows, schema):
        return spark.createDataFrame([(p, i, ids[(p, i)], *rest) for p, i, *rest in rows], f"project string, id string, line int, {schema}")

    test = "```python\ndef test(): assert True\n```"
    responses = keyed([("one.zip", i, test) for i in ("m.A.slow", "m.A.kept", "m.top.inner")] + [("two.zip", "main.go", test), ("one.zip", "m.top", "def (")], "raw string")
    log = keyed(
        [(p, i, 1, n, line) for p, i in ids for n, line in enumerate(["EMISSIONS:4.0", "EXIT_CODE:1" if i == "m.A.kept" else "EXIT_CODE:0"])],
        "run_id int, seq int, log_line string",
    )
    attempts = keyed(
        [("one.zip", "m.A.slow", 1, True, 9.0), ("one.zip", "m.A.slow", 2, True, 1.0), ("one.zip", "m.top.inner", 1, True, 3.0), ("two.zip", "main.go", 1, False, 1.0), ("two.zip", "main.go", 2, True, 4.0)],
        "attempt int, test_passed boolean, emissions_kg double",
    )
    codes = keyed(
        [("one.zip", "m.A.slow", 1, "bad"), ("one.zip", "m.A.slow", 2, "def slow(self, n):\n    return n * (n - 1) // 2"), ("one.zip", "m.top.inner", 1, "def inner():\n    return 1 + 1"), ("two.zip", "main.go", 1, "no")],
        "attempt int, code string",
    )
    results = written(lifecycle.results_of(functions, files, responses, log, attempts, codes), "results")
    got = {r.id: (r.success, r.optimization_attempts, r.skip_reason, r.reduction_pct) for r in results.collect()}
    assert got == {
        "m.A.slow": (True, 2, None, 75.0), "m.A.kept": (False, 0, "baseline_measurement_failed", 0.0), "m.top": (False, 0, "no_spec", 0.0),
        "m.top.inner": (True, 1, None, 25.0), "main.go": (False, 2, None, 0.0),
    }
    scalars = {r.project: r for r in summary.project_summary(results, ["project"]).collect()}
    assert scalars["one.zip"].total_co2_saved_kg == 4.0 and scalars["two.zip"].functions_optimized == 0

    tree = {(r.project, r.file): (bytes(r.content).decode(), r.patched) for r in lifecycle.mirrored(results, files).collect()}
    assert set(tree) == {
        ("one.zip", f) for f in ("proj/requirements.txt", "proj/m.py", "proj/tests/test_m.py", "proj/bad.py", "readme")
    } | {("two.zip", "main.py"), ("two.zip", "venv/lib.py")}
    assert [k for k, v in tree.items() if v[1]] == [("one.zip", "proj/m.py")]
    patched = tree[("one.zip", "proj/m.py")][0]
    ast.parse(patched)
    assert "    def slow(self, n):\n        return n * (n - 1) // 2\n\n    def kept(self)" in patched
    assert "def top():\n    def inner():\n        return 1 + 1\n    return inner\n" in patched
    assert tree[("two.zip", "main.py")][0] == "def go():\n    return 0"
    in_place = {r.file: r.text for r in lifecycle.rewritten_in_place(results, files).collect()}
    assert set(in_place) == {"m.py"} and "    def slow(self, n):\n        return n * (n - 1) // 2\n" in in_place["m.py"]
    assert "return 2" in in_place["m.py"]

    ends = keyed([("one.zip", "m.A.slow", 18.0, None), ("one.zip", "m.top.inner", 3.0, "boom"), ("one.zip", "m.top", 99.0, "x")], "elapsed_s double, error_text string")
    failed = lifecycle.results_of(functions, files, responses, log, attempts, codes, ends)
    reasons = {r.id: (r.success, r.baseline_emissions_kg, r.skip_reason) for r in failed.collect()}
    assert reasons["m.A.slow"] == (False, None, "timeout") and reasons["m.top.inner"] == (False, None, "error: boom")
    assert reasons["m.top"] == (False, None, "no_spec") and reasons["main.go"] == (False, 4.0, None)

    # Names of three parts or inside functions are not found by the any-depth rule.
    compat = {r.file: r.patched for r in lifecycle.mirrored(results.filter(F.col("id") == "m.top.inner"), files, "any").collect()}
    assert not any(compat.values())
