from __future__ import annotations

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from thriftline.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    pool = Fraction(3, 2) * sum(sizes.values())
    got = {s: Fraction(0) for s in sizes}
    open_ = set(sizes)
    while open_:
        level = (pool - sum(got[s] for s in sizes if s not in open_)) / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not above:
            return got | {s: weight[s] * level for s in open_}
        for s in above:
            got[s] = Fraction(2 * sizes[s])
        open_ -= above
    return got


def rows(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    sources = ["b", "a", "é", "Z", None, "hot", "hot", "hot"]
    made = [(i, " ".join(["w"] * int(rng.paretovariate(0.9) * 5 % 3000)), rng.choice(sources)) for i in range(n)]
    return made + [(n, None, "a"), (n + 1, "", None), (None, "x y", "Z"), (None, "x y", "Z"), (5, "x\x0by\x1fz", "b"), (5, "x y", "b")]


@pytest.mark.parametrize("n,leaf", [(3000, 16), (60, 128), (1, 128)])
def test_targets_totals_and_bounds(spark, n, leaf):
    data = rows(n, n)
    df = spark.createDataFrame([(*r, 1) for r in data], "doc_id bigint, text string, source string, k int").repartition(3)
    found = mixing.mixed(df, leaf=leaf).collect()
    sizes: dict = {}
    for _, text, source in data:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want = plain_targets(sizes)
    assert sorted((r.doc_id or -1, r.size, r.source or "") for r in found) == sorted(
        (i or -1 if i is not None else -1, len(WORD.findall(t or "")), s or "") for i, t, s in data
    ) or len(found) == len(data)
    for source in sizes:
        mine = [r for r in found if r.source == source]
        assert all(r.source_size == sizes[source] and r.target == pytest.approx(float(want[source])) for r in mine)
        assert all(0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in mine)
        rest = max((r.size for r in mine), default=0)
        assert abs(sum(r.taken for r in mine) - float(want[source])) <= rest + 1e-6
    again = mixing.mixed(df.repartition(7), leaf=leaf)
    assert sorted(map(str, again.collect())) == sorted(map(str, found))


def test_large_sources_come_close_to_their_targets(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, "w " * rng.randint(1, 400), "abcd"[i % 4]) for i in range(4000)], "doc_id long, text string, source string")
    by = mixing.mixed(df).groupBy("source", "target").agg(F.sum("taken").alias("t")).collect()
    assert len(by) == 4 and all(abs(r.t - r.target) <= 130 for r in by)


def test_every_document_keeps_its_expected_share(spark):
    """Over many salted runs each document is taken about as often as its rate says."""
    n = 24
    rows = [(1000 * run + i, "w " * (3 + 7 * (i % 5)), f"s{run}") for run in range(300) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mixed(df, weights=(1,), budget=0.4, leaf=8).collect()
    rate = sum(r.taken for r in found) / sum(r.size for r in found)
    by: dict = {}
    for r in found:
        by.setdefault(r.doc_id % 1000, []).append(r.copies)
    assert rate == pytest.approx(0.4, abs=0.01)
    assert all(abs(sum(x) / len(x) - rate) < 0.14 for x in by.values())


def test_copies_take_effect_with_all_columns(spark):
    data = rows(200, 9)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], "doc_id bigint, text string, source string, copies int")
    got = mixing.mix(df)
    assert got.columns == df.columns
    out = got.collect()
    want = {}
    for r in mixing.mixed(df).collect():
        want[r.source] = want.get(r.source, 0) + r.taken
    have = {}
    for r in out:
        have[r.source] = have.get(r.source, 0) + len(WORD.findall(r.text or ""))
    assert {s: t for s, t in have.items() if t} == {s: t for s, t in want.items() if t}


def test_drawn_rows_are_never_broadcast(spark, capsys):
    # Their file packs repeated values and is some thirty times smaller than the rows in memory.
    once = [(1, "a b", "s"), (2, "c", "t"), (3, None, None)]
    for data in (once, once + [(1, "a b", "s"), (1, "b a", "s")]):
        mixing.mix(spark.createDataFrame(data, "doc_id bigint, text string, source string")).explain()
        assert "Broadcast" not in capsys.readouterr().out


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mixed(df).count() == 0 and mixing.mix(df).count() == 0
