"""What keeps tasks small: how rows are dealt out, and how much a step holds at a time."""

from __future__ import annotations

import itertools
import json
import tracemalloc
import zipfile

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from thriftline import schemas
from thriftline.operators import catalog, overlaps
from thriftline.operators.numbering import numbered
from thriftline.plans import savings_queries
from thriftline.session import slots, spread
from thriftline.sinks import documents as document_sink
from thriftline.sources import archives, files, split_json, tree, tree_format
from thriftline.streaming import expiring


def test_rows_that_only_name_work_are_dealt_out(spark):
    dealt = spread(spark.range(400), "id").withColumn("task", F.spark_partition_id())
    assert dealt.select("task").distinct().count() == slots(spark)


def test_state_that_ends_is_kept_without_python(spark, tmp_path):
    """Numbers that do not count publish nothing, but their rows are in the state until it ends."""
    schema = "f int, attempt int, test_passed boolean, emissions_kg double, landed_at timestamp"
    landed = spark.range(500).selectExpr("int(id) f", "int(id % 4) attempt", "true", "double(id)", "timestamp'2024-01-01'").toDF(*[c.split()[0] for c in schema.split(", ")])
    landed.write.parquet(str(tmp_path / "landed"))
    query = expiring.publish_expiring(spark.readStream.schema(schema).parquet(str(tmp_path / "landed")), ["f"], str(tmp_path / "out"), str(tmp_path / "progress"))
    query.awaitTermination()
    assert {p.stateOperators[0].operatorName for p in query.recentProgress if p.stateOperators} == {"stateStoreSave"}
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) == 500
    assert expiring.current(spark, str(tmp_path / "out"), ["f"]).count() == 250


def _one_range_files(n, size):
    for at in range(0, n, size):
        ids = range(at, min(at + size, n))
        yield pd.DataFrame({"file_id": [f"f{i:09}" for i in ids], "block": 0, "start": 1, "end": 5})


def test_summaries_hold_one_file():
    tracemalloc.start()
    rows = sum(len(f) for f in overlaps._summaries(_one_range_files(20_000, 500)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 20_000 and peak < 8 << 20


@pytest.mark.parametrize("size", [1, 3, 100])
def test_summaries_do_not_depend_on_frames(size):
    rows = [("a", 0, 1, 9), ("a", 0, 3, 4), ("a", 0, 10, 12), ("a", 1, 11, 20), ("b", 1, 1, 2), ("b", 2, 5, 6), ("b", 2, 6, 9)]
    frame = pd.DataFrame(rows, columns=["file_id", "block", "start", "end"])
    found = pd.concat(overlaps._summaries(frame[at : at + size] for at in range(0, len(frame), size)))
    assert [tuple(r) for r in found.itertuples(index=False)] == _brute_summaries(rows)


def _brute_summaries(rows):
    """For each stretch of entries of a file and block that leave alike: its last start and their reach."""
    found = []
    for key, group in itertools.groupby(rows, key=lambda r: r[:2]):
        spans = [r[2:] for r in group]
        reaches = []
        for i in range(len(spans)):
            reach = None
            for start, end in spans[i:]:
                if reach is None or start > reach:
                    reach = end
            reaches.append((spans[i][0], reach))
        found += [(*key, s, r) for n, (s, r) in enumerate(reaches) if n + 1 == len(reaches) or reaches[n + 1][1] != r]
    return found


def test_archives_are_listed_by_a_fixed_number_of_tasks(spark, tmp_path, monkeypatch):
    for n in range(400):
        with zipfile.ZipFile(tmp_path / f"a{n}.zip", "w") as archive:
            archive.writestr("m.py", str(n))
    assert archives.list_archives(spark, str(tmp_path)).count() == 400
    monkeypatch.setattr(archives, "list_members", lambda names: names)
    names = archives.list_archives(spark, str(tmp_path))
    assert names.rdd.getNumPartitions() <= slots(spark) and names.count() == 400


def test_archives_are_found_by_tasks_as_spark_finds_them(spark, tmp_path, monkeypatch, capsys):
    names = ["a.zip", "b é%20#.zip", "d/e/f/g.zip", "d/e.zip/z.zip", "A.ZIP", "n.txt", ".h.zip", ".h/x.zip"]
    names += ["_h.zip", "_h/x.zip", "_k=1/x.zip", "_k=1.zip", "_metadata/x.zip", "_metadata.zip", "c._COPYING_/x.zip"]
    for name in names:
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"not empty")
    (tmp_path / "in/empty.zip").touch()
    (tmp_path / "nothing").mkdir()
    monkeypatch.setattr(archives, "list_members", lambda names: names)
    by_spark = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true")
    for path, n in (("in", 7), ("in/", 7), ("in/a.zip", 1), ("in/_h.zip", 0), ("in/_h", 1), ("in/n.txt", 0), ("i*/{a,b*}.zip", 2), ("in/*", 10), ("nothing", 0)):
        found = archives.list_archives(spark, f"{tmp_path}/{path}")
        assert sorted(r.path for r in found.collect()) == sorted(r.path for r in by_spark.load(f"{tmp_path}/{path}").select("path").collect())
        assert found.count() == n
        found.explain()
        assert "FileScan" not in capsys.readouterr().out
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        archives.list_archives(spark, str(tmp_path / "absent"))


def test_rows_of_a_frame_are_grouped_by_archive_in_order():
    frame = pd.DataFrame({"archive": ["b", "a", "b", "c"], "position": [2, 1, 0, None], "error": [None, None, None, "bad"]})
    found = {uri: group for uri, group in archives._by_archive(frame, ["error", "position"], ["position"])}
    assert list(found) == ["a", "b", "c"] and [row[1] for row in found["b"]] == [0, 2] and found["c"][0][0] == "bad"


def test_a_catalogue_is_made_of_a_frame_by_slices():
    frame = pd.DataFrame({"project": "p", "file": [str(n) for n in range(20)], "text": ["x" * 1_000_000] * 19 + [None]})
    parts = list(catalog._slices(frame))
    assert len(parts) > 3 and pd.concat(parts).equals(frame) and max(len(p) for p in parts) <= 5


def test_landed_attempts_lie_in_as_many_files_as_tasks(spark, tmp_path, monkeypatch):
    spark.range(2000).selectExpr("id l_orderkey", "int(id % 3) l_linenumber").write.parquet(str(tmp_path / "lineitem.parquet"))
    seen = {}

    def streamed(_, folder, schema, options):
        seen.update(n=spark.read.parquet(folder).select(F.input_file_name()).distinct().count(), each=int(options["maxFilesPerTrigger"]))
        raise InterruptedError

    monkeypatch.setattr(savings_queries, "_streamed", streamed)
    with pytest.raises(InterruptedError):
        savings_queries.r1_late_baselines(spark, str(tmp_path))
    assert seen["n"] == slots(spark) and -(-seen["n"] // seen["each"]) == 4


def test_records_of_a_split_document_have_their_place(spark, tmp_path):
    records = [{"id": f"i{n}", "file": "x" * (n % 50)} for n in range(300)]
    (tmp_path / "p.json").write_text(json.dumps({"project_root": "p", "generated_at": "t", "functions": records}))
    read = split_json.read_split_documents(spark, str(tmp_path), schemas.RESULT_DOCUMENT, size=700, places=True)
    at = numbered(read.select("uri", "place", "id"), ["uri"], [F.col("place")])
    assert [r.id for r in at.orderBy("position").collect()] == [f"i{n}" for n in range(300)]


def test_small_members_make_small_frames():
    rows = ((f"a{n}.zip", "m.py", 1, b"x", None) for n in range(100_000))
    assert max(map(len, archives._in_batches(rows, schemas.ARCHIVE_MEMBER.names, 3))) <= 20_000


def test_folders_are_walked_without_holding_their_files(monkeypatch, tmp_path):
    taken = []

    def entries(uri):
        for n in range(1000):
            taken.append(n)
            yield f"{n}.py", False, 1

    monkeypatch.setattr(files, "children", entries)
    reader = tree_format.TreeReader("/r", 1, 4, False, None, "", {})
    assert len(list(itertools.islice(reader._walk([("p", "", "/r/p", True, 0)]), 5))) == 5 and len(taken) <= 6
    folder = pd.DataFrame([("p", "", 0, "/r/p", True)] * 25, columns=["project", "file", "n_bytes", "uri", "is_dir"])
    assert [len(f) for f in tree._walk(iter([folder]))] == [len(f) for f in tree._list_level(iter([folder]))] == [10_000, 10_000, 5_000]


def test_entries_of_a_folder(tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "_a.py").write_text("xyz")
    (tmp_path / "gone").symlink_to(tmp_path / "nowhere")
    assert sorted(files.children(str(tmp_path))) == [("_a.py", False, 3), ("b", True, 0), ("gone", False, 0)]
    assert list(files.children(str(tmp_path / "missing"))) == []


def test_lines_of_one_project_are_not_joined_in_one_task(spark, tmp_path):
    records = spark.range(500).selectExpr("IF(id < 490, 'p', NULL) project", "concat('i', id) id", "'f' file")
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.RESULT if f.name not in ("id", "file")]
    document_sink.write_result_documents(records.select("project", "id", "file", *columns), str(tmp_path / "lines"), "t")
    texts = document_sink.document_texts(spark, str(tmp_path / "lines"))
    assert "project" not in next(line for line in texts._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)
    found = {}
    for row in texts.orderBy("place").collect():
        found[row.project] = found.get(row.project, "") + row.value
    assert {p: len(json.loads(text)["functions"]) for p, text in found.items()} == {"p": 490, None: 10}
