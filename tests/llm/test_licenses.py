from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from thriftline.llm import licenses

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def base_by_hand(text):
    """The contract's base: where the words of a phrase stand one after the other."""
    words = words_of(text)
    places = [
        (i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def least_edits(pattern, text):
    """Fewest edits between ``pattern`` and any stretch of ``text`` (the textbook recurrence)."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        above, row[0] = row[0], 0
        for j, p in enumerate(pattern, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (c != p))
        best = min(best, row[-1])
    return best


def edited(rng, phrase, n, keep):
    """``n`` random edits outside the stretches of ``keep``."""
    held = {i for k in keep for m in re.finditer(rf"\b{k}\b", phrase) for i in range(m.start() - 1, m.end() + 1)}
    free = [i for i in range(1, len(phrase) - 1) if i not in held]
    chars = list(phrase)
    for i in rng.sample(free, n):
        chars[i] = rng.choice(["", "x", chars[i] + "z"])
    return "".join(chars)


def found(text, search=licenses.Search()):
    return licenses.found_in(search, text.encode())


def test_every_notice_within_its_edits_is_found():
    rng = random.Random(5)
    for notice in licenses.NOTICES:
        for _ in range(40):
            n = rng.randint(0, notice.errors())
            inside = edited(rng, notice.phrase, n, notice.keys)
            before, after = (" ".join(rng.choice(["lorem", "ipsum", "the", "license", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(2))
            text = f"{before} {inside} {after}"
            # Taking out a word of one letter also joins two blanks, so edits are counted in the joined words.
            least = least_edits(notice.phrase, licenses.joined_words(text.encode())[1])
            rows = [r["errors"] for r in found(text)[1] if r["phrase"] == notice.phrase]
            assert least > notice.errors() or min(rows) == least, (notice, inside)


def test_nothing_beyond_the_edits_is_found():
    rng = random.Random(6)
    vocabulary = sorted({w for n in licenses.NOTICES for w in n.phrase.split()} | {"mpl", "mitt", "lizense", "a", "is"})
    for _ in range(150):
        text = " ".join(rng.choice(vocabulary) for _ in range(30))
        _, joined = licenses.joined_words(text.encode())
        rows = found(text)[1]
        for r in rows:
            notice = next(n for n in licenses.NOTICES if n.phrase == r["phrase"])
            stretch = joined[1:].split(" ")[r["first_word"] : r["first_word"] + r["words"]]
            assert least_edits(notice.phrase, " ".join(stretch)) <= r["errors"] <= notice.errors()
            assert set(notice.keys) <= set(stretch)
        for notice in licenses.NOTICES:
            if not notice.keys and least_edits(notice.phrase, joined) <= notice.errors():
                assert notice.phrase in {r["phrase"] for r in rows}


def test_spans_point_into_the_text():
    text = "Über: Released UNDER\n the (MIT) Licence, or Apache-License, Version 2.0; CC BY-NC 4.0"
    rows = found(text)[1]
    assert [(r["label"], text[r["start"] : r["end"]], r["errors"], r["whole"]) for r in rows if r["base"]] == [
        ("mit", "UNDER\n the (MIT) Licence", 1, False), ("apache-2", "Apache-License, Version 2", 0, True), ("cc-by-nc", "CC BY-NC", 0, True),
    ]
    assert [r["first_word"] for r in rows if r["whole"] and r["base"]] == [7, 12]


@pytest.mark.parametrize("text", ["under the mpl license", "under the mitt license", "acc by nc", "cc by nca", "cc by n c", "apache license version 3", "version 2"])
def test_other_licences_are_not_misspelt_ones(text):
    assert found(text)[1] == []


def test_overlapping_unedited_places_all_count():
    search = licenses.Search([licenses.Notice("x", "ab cd ab", (), True)])
    assert [r["first_word"] for r in found("ab cd ab cd ab cd ab", search)[1] if r["whole"]] == [0, 2, 4]


def test_a_very_common_line_takes_one_window_a_place():
    text = "Released under the MIT Licensed work. " * 5_000
    rows = [r for r in found(text)[1] if r["phrase"] == "under the mit license"]
    assert len(rows) == 5_000 and all(r["errors"] == 0 and not r["whole"] for r in rows)


ODD = [
    (1, None), (2, ""), (None, "cc by nc"), (3, " . "), (4, "under the MIT license " * 400), (5, "w " * 200_000 + "CC-BY-NC"),
    (6, "tie cc by nc"), (6, "tie cc by nc"), (7, "Apache license, verzion 2 applies"), (8, "plain text"),
]


def test_rows(spark):
    schema = "doc_id bigint, text string, n_words string, matches int, label string"
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in ODD], schema)
    rows = licenses.scanned(docs).select("doc_id", "n_words", licenses.label_list(licenses.base_places(F.col("matches"))).alias("b"), licenses.label_list(F.col("matches")).alias("l"))
    got = sorted((str(r.doc_id), r.n_words, r.b, r.l) for r in rows.collect())
    want = []
    for doc_id, text in ODD:
        n, _, _, _, labels = base_by_hand(text)
        want.append((str(doc_id), n, labels, "apache-2" if doc_id == 7 else labels))
    assert got == sorted(want)
    assert licenses.scanned(docs.limit(0)).collect() == []


def test_query_equals_the_contract(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = entry.queries()["op11_licenses"](spark, sf).collect()
    assert len(rows) == len(texts) and any(r.n_base for r in rows)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_by_hand(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")
