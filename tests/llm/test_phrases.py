from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from thriftline.llm import phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def by_hand(rows, least, top):
    """The contract, one text after the other."""
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    chosen = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    found = []
    for (lang, words), a in chosen.items():
        longer = [
            f for (other, around), f in chosen.items()
            if other == lang and len(around) > len(words) and any(around[i : i + len(words)] == words for i in range(len(around)))
        ]
        if any(100 * f >= 80 * a for f in longer):
            continue
        cuts = [(counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(cuts))
        found.append((lang, -score, -a, " ".join(words).encode(), left, right))
    ranked = []
    for lang in totals:
        for rank, (_, score, a, phrase, left, right) in enumerate(sorted(f for f in found if f[0] == lang)[:top], 1):
            ranked.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(ranked)


PASSAGE = " ".join(f"p{i}" for i in range(60))


def corpus_rows(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(60):
        words = rng.choices(["a", "b", "c", "D", "é", "ß.", "e,f", "g\th", "x!"], weights=[9, 6, 4, 3, 2, 1, 1, 1, 1], k=rng.randint(0, 60))
        rows.append((rng.choice(["en", "de", None]), " ".join(words)))
    rows += [("en", f"q{i} {PASSAGE} z{i}") for i in range(4)] + [("en", PASSAGE[: len(PASSAGE) // 2])]
    rows += [("de", None), ("de", ""), ("empty", " \t.;"), (None, "same same same same same same"), ("", "odd " * 5)]
    rows += [("de", "tie one. tie two. tie one. tie two. tie one. tie two"), ("de", "\x1c\x85  x y z ")] * 3
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus_rows(3)


def frame(spark, rows):
    schema = "lang string, text string, doc_id bigint, head string, f int, path string, word string"
    return spark.createDataFrame([(*r, 1, "x", 2, "y", "z") for r in rows], schema)


@pytest.mark.parametrize("top, size", [(2000, 8 << 20), (5, 200)])
def test_equals_counting_by_hand(spark, rows, top, size):
    got = phrases.collocations(frame(spark, rows), least=3, top=top, size=size)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == by_hand(rows, 3, top)


def test_empty_table(spark, rows):
    assert phrases.collocations(frame(spark, rows).limit(0)).collect() == []


def test_a_repeated_passage_is_one_path(spark):
    found = phrases.graph(frame(spark, [("en", f"q{i} {PASSAGE} z{i}") for i in range(4)]), least=3)
    assert [(r.f, r.edges) for r in phrases.paths(found).collect()] == [(4, 57)]
    assert found.nodes.where("inner").count() == 56 and found.nodes.count() == 58
    # Where two of four leave it half-way the passage is three paths.
    texts = [f"q{i} {PASSAGE} z{i}" if i % 2 else f"q{i} " + PASSAGE.replace("p30 ", "elsewhere ") for i in range(6)]
    found = phrases.graph(frame(spark, [("en", t) for t in texts]), least=3)
    assert sorted((r.f, r.edges) for r in phrases.paths(found).collect()) == [(3, 4), (3, 4), (6, 26), (6, 27)]


def test_grams_of_a_block():
    ids = np.array([1, 2, 1, 2, 1, 2, 0, 3, 0, 4, 5, 6, 0])
    pack = lambda a, b: a << 32 | b
    head, tail, count = phrases.longest_grams(ids, np.array([pack(1, 2), pack(2, 1), pack(4, 5)]))
    got = {(h, t): c for h, t, c in zip(head.tolist(), tail.tolist(), count.tolist())}
    assert got == {
        (pack(1, 2), pack(1, 2)): 2, (pack(1, 2), 0): 1, (pack(2, 1), pack(2, 1)): 1, (pack(2, 1), pack(2, 0)): 1, (pack(4, 5), 0): 1,
    }
    assert [len(x) for x in phrases.longest_grams(np.zeros(3, dtype=np.int64), np.zeros(0, dtype=np.int64))] == [0, 0, 0]
    assert [len(x) for x in phrases.longest_grams(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] == [0, 0, 0]


def test_blocks_take_little_more_room_than_their_words_tell():
    rng = np.random.default_rng(1)
    # 40,000 words with the frequencies of a text: some 11 bits each, where four bytes were written.
    drawn = (40_000 ** rng.random(300_000)).astype(int)
    texts = [" ".join(f"w{i}" for i in some).encode() for some in np.split(drawn, 300)]
    words, counts, places = phrases._block(texts)
    assert len(places) < 2.2 * len(drawn)
    assert counts.tolist() == sorted(counts.tolist(), reverse=True)
    named = np.array([phrases._END, *words.to_pylist()], dtype=object)
    assert named[phrases.unpacked(places)].tolist() == [w for t in texts for w in phrases.words_and_ends(t)]
    assert sum(counts) == len(drawn)
    for numbers in ([], [0], [1, 2**31 - 1, 255, 256, 0]):
        assert phrases.unpacked(phrases.packed(np.array(numbers, dtype=np.int32))).tolist() == numbers


def test_numbers_come_back_to_the_blocks_without_a_join_of_their_words(spark, rows, monkeypatch):
    plans = {}

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().analyzed().toString()
        return kept(df, label)

    kept = phrases.written
    monkeypatch.setattr(phrases, "written", seen)
    phrases.graph(frame(spark, rows), least=3)
    # By block only, and the sizes of the tasks before.
    assert plans["coded"].count("Join ") == 1 and plans["numbered"].count("Join ") == 1


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 2**62 + 1, 2**62 + 12345, 2**63 - 1
    row = spark.range(1).select(phrases._score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first()
    assert row.s == 2_000_000 * a // (left + right)
    row = spark.createDataFrame([(2**62, 2**62 // 5 * 4), (2**62, 2**62 // 5 * 4 + 4)], "f bigint, _longer bigint")
    assert [r.x for r in row.select(phrases._absorbed().alias("x")).collect()] == [100 * (2**62 // 5 * 4) >= 80 * 2**62, True]


def test_query_equals_the_contract(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = entry.queries()["op12_phrases"](spark, sf)
    assert sorted(tuple(r) for r in got.collect()) == by_hand(rows, 30, 2000)
