from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from thriftline.llm import fim

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
LINE = re.compile("[^\n-\r]*[\n-\r]|[^\n-\r]+")
COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def by_hand(doc_id, text, pattern=TOKEN):
    """The contract, read with a regular expression."""
    text = text or ""
    units = pattern.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(part) for part in (units[:a], units[a:b], units[b:]))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc_id, len(units), "plain", None, None, text)
    if h[3] % 100 < 80:
        return (doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


def block_rows(rows, unit="word"):
    raw = [(t or "").encode() for _, t in rows]
    offsets = np.cumsum([0, *map(len, raw)]).astype(np.int64)
    found = fim.transform([i for i, _ in rows], np.frombuffer(b"".join(raw), np.uint8), offsets, unit, 50, 80, 42)
    found["output"] = [o.decode() for o in found["output"]]
    return list(zip([i for i, _ in rows], *(found[c] for c in COLUMNS[1:])))


@given(st.lists(st.integers(0, 7), max_size=300), st.integers(0, 8), st.integers(0, 8))
@settings(max_examples=60, deadline=None)
def test_ranks_equal_counts(symbols, low, high):
    low, high = sorted((low, high))
    matrix = fim.WaveletMatrix(np.array(symbols, dtype=np.uint8), 3)
    at = np.arange(len(symbols) + 1)
    want = [sum(low <= s < high for s in symbols[:i]) for i in range(len(symbols) + 1)]
    assert matrix.count(((low, high),), at).tolist() == want


@given(st.lists(st.text("aé€𝄞 \t\n\r\x0b\x1f\x85 <PSM>", max_size=40), min_size=1, max_size=30))
@settings(max_examples=100, deadline=None)
def test_blocks_equal_a_regular_expression(texts):
    rows = list(enumerate(texts))
    assert block_rows(rows) == [by_hand(*r) for r in rows]
    assert block_rows(rows, "line") == [by_hand(*r, LINE) for r in rows]


ODD = [
    (1, None), (2, ""), (None, "no id but text"), (3, " \t\n "), (4, "has <M> in it"), (5, "a<S a>P> <"), (6, "wört " * 50_000),
    (7, "x" * 300_000), (7, "tie"), (7, "tie"), *((i, f"word{i} \n two  three\tfour é{i} ") for i in range(8, 200)),
]


def test_rows_and_round_trip(spark):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in ODD], "doc_id bigint, text string, output string, n int, form string")
    made = fim.transformed(docs)
    got = [tuple(r) for r in made.collect()]
    key = lambda r: (str(r[0]), str(r[5]))
    assert made.columns == COLUMNS and sorted(got, key=key) == sorted((by_hand(*r) for r in ODD), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = made.select(fim.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(r.t for r in back) == sorted(t or "" for _, t in ODD)
    assert fim.transformed(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        fim.transformed(docs, unit="page")


def test_small_blocks_change_nothing(spark, monkeypatch):
    rows = [(i, f"w{i} é " * (i % 50)) for i in range(300)]
    whole = block_rows(rows)
    monkeypatch.setattr(fim, "BLOCK", 64)
    offsets = np.cumsum([0, *(len(t.encode()) for _, t in rows)])
    cuts = list(fim._blocks(offsets))
    assert len(cuts) > 100 and cuts[0][0] == 0 and cuts[-1][1] == 300 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert [r for a, b in cuts for r in block_rows(rows[a:b])] == whole


def test_query_equals_the_contract(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = entry.queries()["op13_fill_in_middle"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        _, n, form, prefix, middle, output = by_hand(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
