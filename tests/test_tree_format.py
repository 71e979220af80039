"""Source trees as a data source: rows, and what the options keep from being listed or opened."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import InputPartition

from thriftline.functions import paths
from thriftline.sources import files, tree_format

NAMES = [
    "p/__init__.py", "p/_private.py", "p/a/b/c/d/e/deep.py", "p/tests/t.py", "p/venv/x.py", "p/readme.md", "p/x_test.py",
    "p/venv/tests/t.py", "p/Tests/Up.py", "p/.git/config", "p/VENV/kept.py", "p/100% #1.py", "q/m.py", "r/venv", "stray.py",
]


@pytest.fixture()
def root(tmp_path):
    for name in NAMES:
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    (tmp_path / "in" / "empty").mkdir()
    return f"{tmp_path}/in"


def rows(df):
    return sorted((r.project, r.file) for r in df.collect())


def split(names):
    return sorted(tuple(n.split("/", 1)) for n in names if "/" in n)


def test_rows_and_flags_at_any_level_and_number_of_tasks(spark, root):
    for levels, tasks in ((0, 1), (1, 64), (2, 3), (9, 2)):
        found = tree_format.open_tree(spark, root, levels=levels, tasks=tasks)
        assert rows(found) == split(NAMES)
    kept = found.collect()
    assert all(bytes(r.content).decode() == f"{r.project}/{r.file}" and r.n_bytes == len(r.content) for r in kept)
    file = F.col("file")
    by_paths = found.select("file", paths.is_python(file), paths.is_excluded(file), paths.is_test_file(file)).collect()
    assert sorted(map(tuple, by_paths)) == sorted((r.file, r.is_python, r.excluded, r.is_test) for r in kept)
    assert tree_format.open_tree(spark, f"file://{root}/").count() == len(kept)


def test_options_give_the_same_rows_as_filters(spark, root):
    found = tree_format.open_tree(spark, root)
    for options, condition in (
        ({"excluded": False}, "NOT excluded"),
        ({"excluded": True, "levels": 0}, "excluded"),
        ({"excluded": False, "is_test": False}, "NOT excluded AND NOT is_test"),
        ({"is_test": True, "ends": ".py"}, "is_test AND file LIKE '%.py'"),
        ({"projects": ["q", "r", "absent"], "is_python": True}, "project IN ('q', 'r') AND is_python"),
        ({"projects": []}, "false"),
    ):
        narrow = tree_format.open_tree(spark, root, **options)
        assert rows(narrow) == rows(found.where(condition)), condition


def test_one_dataframe_under_several_filters(spark, root):
    """What one query filters must not act on the next over the same DataFrame."""
    found = tree_format.open_tree(spark, root, content=False)
    held = spark.createDataFrame(found.collect(), found.schema)
    for condition in ("NOT excluded", "is_test OR excluded", "project = 'q'", "true", "file LIKE '%.py' AND NOT is_test"):
        assert rows(found.where(condition)) == rows(held.where(condition)), condition
        both = found.where(condition).union(found.where("excluded"))
        assert rows(both) == rows(held.where(condition).union(held.where("excluded"))), condition


def test_names_only(spark, root):
    found = tree_format.open_tree(spark, root, content=False)
    assert "content" not in found.columns and rows(found) == split(NAMES)
    assert {r.n_bytes for r in found.where("project = 'q'").collect()} == {6}


def test_empty_and_missing_roots(spark, tmp_path):
    for root in (tmp_path, tmp_path / "absent"):
        assert tree_format.open_tree(spark, str(root)).count() == 0
    with pytest.raises(Exception, match="tasks of 1 or more"):
        tree_format.open_tree(spark, str(tmp_path), tasks=0).count()
    with pytest.raises(Exception, match="neither true nor false"):
        tree_format.open_tree(spark, str(tmp_path), excluded="no").count()


def test_what_options_rule_out_is_neither_listed_nor_opened(root, monkeypatch):
    listed, opened = [], []
    children, read_bytes = files.children, files.read_bytes
    monkeypatch.setattr(files, "children", lambda uri: listed.append(uri[len(root) + 1 :]) or children(uri))
    monkeypatch.setattr(files, "read_bytes", lambda uri: opened.append(uri[len(root) + 1 :]) or read_bytes(uri))
    reader = tree_format.TreeReader(root, 1, 4, True, ["p", "r"], ".py", {"excluded": False, "is_test": False})
    chunks = reader.partitions()
    assert 1 < len(chunks) <= 4 and all(isinstance(c, InputPartition) for c in chunks)
    assert sorted(listed) == ["", "p", "r"]
    found = sorted(r["file"] for c in chunks for batch in reader.read(c) for r in batch.to_pylist())
    assert found == sorted(["__init__.py", "_private.py", "a/b/c/d/e/deep.py", "VENV/kept.py", "100% #1.py"])
    assert sorted(opened) == sorted(f"p/{f}" for f in found)
    assert not {"q", "p/venv", "p/tests", "p/Tests", "p/.git"} & set(listed) and {"p/a/b", "p/VENV"} <= set(listed)


def test_large_folders_come_in_bounded_batches(root, monkeypatch):
    monkeypatch.setattr(tree_format, "BATCH_BYTES", 20)
    reader = tree_format.TreeReader(root, 0, 1, True, None, "", {})
    batches = list(reader.read(reader.partitions()[0]))
    assert len(batches) > 5 and sum(b.num_rows for b in batches) == len(split(NAMES))
