from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from thriftline.sources import archives, decode, documents, projects, requirements, tree


def zipped(members):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in members:
            archive.writestr(name, data)
    return held.getvalue()


@pytest.fixture()
def archive_folder(tmp_path):
    big = [(f"src/m{n:04}.py", f"x = {n}\n") for n in range(500)]
    (tmp_path / "big.zip").write_bytes(zipped(big))
    members = [("a/", ""), ("a/__init__.py", ""), ("../up.py", "u"), ("/abs.py", "v"), ("a/./b.py", "w"), ("é.py", "ü".encode())]
    (tmp_path / "odd.zip").write_bytes(zipped(members))
    with pytest.warns(UserWarning):
        (tmp_path / "twice.zip").write_bytes(zipped([("f.py", "old"), ("f.py", "new")]))
    (tmp_path / "broken.zip").write_bytes(b"PK not really")
    (tmp_path / "_under.zip").write_bytes(zipped([("x.py", "1")]))
    return tmp_path


def test_archives_by_file_and_by_content(spark, archive_folder):
    by_file = archives.read_archives(spark, str(archive_folder)).collect()
    table = spark.read.format("binaryFile").load(str(archive_folder))
    by_content = archives.expand_archives(table).collect()

    def rows(found):
        return {(r.archive.rsplit("/", 1)[1], r.file): bytes(r.content) for r in found if r.error is None}

    assert rows(by_file) == rows(by_content)
    odd = {k[1]: v for k, v in rows(by_file).items() if k[0] == "odd.zip"}
    assert odd == {"a/__init__.py": b"", "up.py": b"u", "abs.py": b"v", "a/b.py": b"w", "é.py": "ü".encode()}
    assert rows(by_file)[("twice.zip", "f.py")] == b"new"
    assert sum(k[0] == "big.zip" for k in rows(by_file)) == 500
    for found in (by_file, by_content):
        assert [r.archive.rsplit("/", 1)[1] for r in found if r.error] == ["broken.zip"]


def test_members_of_one_archive_are_read_by_many_tasks(spark, archive_folder):
    found = archives.read_archives(spark, str(archive_folder / "big.zip"), tasks=6)
    tasks = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 3 and sum(r["count"] for r in tasks) == 500


def test_loads_hold_about_the_same_bytes(spark, tmp_path):
    """One archive with most bytes, hundreds of small ones, members of very different sizes."""
    rows = [("a.zip", n, f"m{n}", 40_000 - 90 * n, True, None) for n in range(400)]
    rows += [(f"b{n:03}.zip", 0, "m", n * n % 9_000, True, None) for n in range(300)] + [("c.zip", None, None, None, None, "broken")]
    listed = spark.createDataFrame(rows, "archive string, position bigint, file string, n_bytes bigint, stored boolean, error string")
    loaded = archives.with_loads(listed, 16, ["archive", "position", "file"])
    dealt = loaded.repartitionById(16, "load").withColumn("task", F.spark_partition_id())
    sums = {r.task: (r.b, r.loads) for r in dealt.groupBy("task").agg(F.sum("n_bytes").alias("b"), F.count_distinct("load").alias("loads")).collect()}
    mean = sum(b for b, _ in sums.values()) / 16
    assert len(sums) == 16 and max(b for b, _ in sums.values()) <= 2 * mean and {n for _, n in sums.values()} == {1}
    assert archives.with_loads(listed.limit(0), 16, ["archive", "position", "file"]).collect() == []


def test_pieces_give_the_members(spark, tmp_path):
    big, small = bytes(range(256)) * 700, b"x" * 1000
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        archive.writestr("stored.bin", big, zipfile.ZIP_STORED)
        archive.writestr("packed.bin", big, zipfile.ZIP_DEFLATED)
        archive.writestr("exact.bin", small, zipfile.ZIP_STORED)
        archive.writestr("none.bin", b"", zipfile.ZIP_DEFLATED)
    (tmp_path / "a.zip").write_bytes(held.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"PK no")
    found = archives.read_pieces(spark, str(tmp_path), tasks=8, piece=1000)
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    assert [r.archive.rsplit("/", 1)[1] for r in rows if r.error] == ["bad.zip"]
    joined = {}
    for r in sorted((r for r in rows if not r.error), key=lambda r: (r.file, r.start)):
        assert r.start == len(joined.get(r.file, b"")) and len(r.content) <= 1000
        joined[r.file] = joined.get(r.file, b"") + bytes(r.content)
    assert joined == {"stored.bin": big, "packed.bin": big, "exact.bin": small, "none.bin": b""}
    assert len({r.task for r in rows if r.file == "stored.bin"}) > 2 and len({r.task for r in rows if r.file == "packed.bin"}) == 1


def test_tree_scan(spark, tmp_path):
    for name in [
        "p/__init__.py", "p/_private.py", "p/a/b/c/d/e/deep.py", "p/tests/t.py", "p/venv/x.py", "p/readme.md", "p/x_test.py",
        "q/m.py", "p/venv/tests/t.py",
    ]:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    roots = spark.createDataFrame([("p", f"{tmp_path}/p"), ("q", f"file://{tmp_path}/q/"), ("none", f"{tmp_path}/none")], "project string, uri string")
    for levels in (0, 2, 9):
        assert tree.list_tree(spark, roots, levels).count() == 9
    sources = {(r.project, r.file): bytes(r.content).decode() for r in tree.scan_sources(spark, roots).collect()}
    assert sources == {
        ("p", f): f"p/{f}" for f in ("__init__.py", "_private.py", "a/b/c/d/e/deep.py")
    } | {("q", "m.py"): "q/m.py"}
    assert {(r.project, r.file) for r in tree.scan_tests(spark, roots).collect()} == {("p", "tests/t.py"), ("p", "x_test.py")}
    counts = {r.project: (r.source_files, r.test_files) for r in tree.count_files(tree.list_tree(spark, roots), ["project"]).collect()}
    assert counts == {"p": (3, 2), "q": (1, 0)}


def test_decode(spark):
    rows = [("ok", "é\r\nb\rc\n".encode()), ("bad", b"\xff\xfe"), ("bom", b"\xef\xbb\xbfx"), ("nul", b"a\x00b"), ("empty", b"")]
    decoded = decode.decode(spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "file string, content binary"))
    assert {r.file: r.text for r in decode.accepted(decoded).collect()} == {"ok": "é\nb\nc\n", "empty": ""}
    assert {r.file: r.reason for r in decode.rejected(decoded, ["file"]).collect()} == {
        "bad": "not valid UTF-8", "bom": "byte-order mark", "nul": "NUL character",
    }


def test_documents(spark, tmp_path):
    document = {
        "project_root": "/p", "generated_at": "2024-01-01T00:00:00",
        "functions": [{"id": "a", "success": True, "baseline_emissions_kg": 1.5}, {"id": "b", "extra": 1}],
    }
    (tmp_path / "r.json").write_text(json.dumps(document, indent=2))
    rows = documents.result_documents(spark, str(tmp_path / "r.json")).collect()
    assert [(r.project_root, r.id, r.success, r.baseline_emissions_kg) for r in rows] == [("/p", "a", True, 1.5), ("/p", "b", None, None)]
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        documents.result_documents(spark, str(tmp_path / "absent.json"))


def test_required_tools(spark):
    lines = spark.createDataFrame(
        [("a", 1, "PyTest-cov>=1 # x"), ("a", 2, "pip install codecarbon"), ("b", 1, "codecarbon==2"), ("b", 2, "my-pytest")],
        "project string, line_no int, line string",
    )
    clean = requirements.clean_requirements(lines, ["project"])
    all_projects = spark.createDataFrame([("a",), ("b",), ("none",)], "project string")
    full = requirements.with_required_tools(clean, all_projects, ["project"])
    assert {(r.project, r.spec, r.added) for r in full.collect()} == {
        ("a", "PyTest-cov>=1", False), ("a", "codecarbon", True), ("b", "codecarbon==2", False), ("b", "my-pytest", False),
        ("b", "pytest", True), ("none", "pytest", True), ("none", "codecarbon", True),
    }


def test_project_roots_and_requirements(spark):
    trees = {
        "top": ["a.py", "x/requirements.txt"], "req": ["b/requirements.txt", "a/m.py", "requirements.txt"], "py": ["c/d/e.py", "b/readme", ".h/requirements.txt"],
        "none": ["readme"], "hidden": [".h/a.py"], "deep": ["a/x/requirements.txt", "b/m.py"],
    }
    files = spark.createDataFrame([(a, f) for a, fs in trees.items() for f in fs], "archive string, file string")
    roots = projects.find_project_roots(files)
    assert {r.archive: r.root for r in roots.collect()} == {"top": "", "req": "b", "py": "c", "none": "", "hidden": "", "deep": "b"}
    found = {r.archive: r.requirements_file for r in requirements.find_requirements(roots, files).collect()}
    assert found == {"top": None, "req": "b/requirements.txt", "py": None, "none": None, "hidden": None, "deep": None}
    parents = spark.createDataFrame([("req", "a"), ("req", "a/b"), ("req", "")], "archive string, root string")
    again = {r.root: r.requirements_file for r in requirements.find_requirements(parents, files).collect()}
    assert again == {"a": "requirements.txt", "a/b": None, "": "requirements.txt"}
