from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from thriftline.llm import secrets, simhash
from thriftline.session import written

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], SF), name))
    raw, clean, single, redacted, mixed, packed = seen
    for df in seen[1:5]:
        assert df.columns == docs.columns
    assert clean.join(raw, raw.columns, "left_anti").count() == 0 and clean.count() < raw.count()
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(clean).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(groups.values()))
    before = {r.doc_id: r.text for r in single.collect()}
    for r in redacted.collect():
        assert r.text == secrets.redacted(before[r.doc_id]) and r.n_chars == len(r.text)
        assert secrets.secrets(r.text)[0] == []
    copies = mixed.groupBy("doc_id").count().collect()
    assert copies and max(r["count"] for r in copies) <= 2
    assert mixed.join(redacted, redacted.columns, "left_anti").count() == 0
    ids = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    assert ids == {r.doc_id for r in copies}
    whole = corpus_pipeline.run(spark, SF)
    assert whole.columns == packed.columns and whole.count() == packed.count()


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for table in ("pages", "embeddings", "conversations", "documents"):
        duck.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(str(dict(sorted(zip(columns, row)))) for row in cursor.fetchall())
    assert sorted(str(dict(sorted(r.asDict().items()))) for r in df.collect()) == want


def test_every_operator_is_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names


ODD = [
    (1, None, "en", "a", 1), (2, "", None, None, None), (None, "a text without an id " * 9, "en", "a", 5), (3, "tie tie", "de", "b", 7),
    (3, "tie tie", "de", "b", 7), (4, "w é " * 60_000, "fr", "hot", 9), (5, "tie tie", "de", "b", 7), (6, " \t\n", "", "", 3),
    (7, "password = hunter2hunter2 and more", "en", "a", 2), (None, None, None, None, None),
]


def test_every_stage_takes_odd_rows_clashing_columns_and_empty_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _fp string, _row int, copies int, score string, k bigint"
    odd = spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in ODD], schema)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            docs = written(stage(spark, docs, SF), name)
            if name == "packing":
                assert docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
            else:
                assert docs.columns == odd.columns and [f.dataType for f in docs.schema] == [f.dataType for f in odd.schema]
            if name == "near_duplicates":
                kept = sorted(str(r.doc_id) for r in docs.collect())
                # 2 and 6 have no words, like 1; 5 and one row of 3 repeat the other; the row without id or text is like 1.
                assert kept == (["1", "3", "4", "7", "None"] if before.count() else [])
            if name == "secrets":
                assert all("hunter2" not in (r.text or "") for r in docs.collect())
