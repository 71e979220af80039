"""Licence notices in texts, also where a few characters are off.

A text is read as its words in lower case (runs of ASCII letters, digits and characters beyond ASCII) joined
by blanks.  A notice is a short phrase and may have one edit (an inserted, deleted or replaced character)
for every :data:`SPACING` of its characters, ``k`` in all.  Cut into ``k + 1`` pieces, at least one
piece of any such match stands unedited: the pieces are the seeds, and one Aho-Corasick automaton finds
the seeds of all notices in one pass.  Around a seed the match can only lie in a window of the notice's length
and ``k`` characters to either side; there the regex library looks for the best match with at most ``k``
errors.  Words that tell licences apart (``mit``, a version) must stand unedited in the match, so ``mpl``
is never a misspelt ``mit``.  Windows are about as long as their notice, and seeds that expect a match in the same place share one.

Defined results: a NULL or empty text has no words and no match; matches of one notice that overlap
count once, the one with the fewest errors and then the first, but every unedited place of whole words counts;
repeated rows are searched each; no documents give no rows.  Memory is a few times the longest text and its matches.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftline.llm import corpus

#: Characters of a notice for each edit it may have.
SPACING = 10


@dataclass(frozen=True)
class Notice:
    """A phrase of lower-case words, its label, the words that must stand unedited, and whether it belongs to the base."""

    label: str
    phrase: str
    keys: tuple[str, ...] = ()
    base: bool = False

    def errors(self, spacing: int = SPACING) -> int:
        return len(self.phrase) // spacing

    def pieces(self, spacing: int = SPACING) -> list[tuple[int, str]]:
        """``(offset, piece)``: one piece more than there may be edits."""
        n = self.errors(spacing) + 1
        cuts = [len(self.phrase) * i // n for i in range(n + 1)]
        return [(a, self.phrase[a:b]) for a, b in itertools.pairwise(cuts)]


# Phrases and labels of the base, then further notices.
NOTICES = (
    Notice("mit", "under the mit license", ("mit",), True),
    Notice("apache-2", "apache license version 2", ("2",), True),
    Notice("cc-by-nc", "cc by nc", ("cc", "by", "nc"), True),
    Notice("mit", "mit license", ("mit",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    Notice("apache-2", "apache license 2", ("2",)),
    Notice("bsd", "redistribution and use in source and binary forms"),
    Notice("bsd", "bsd 2 clause license", ("bsd", "2")),
    Notice("bsd", "bsd 3 clause license", ("bsd", "3")),
    Notice("gpl-2", "gnu general public license version 2", ("gnu", "2")),
    Notice("gpl-3", "gnu general public license version 3", ("gnu", "3")),
    Notice("lgpl", "gnu lesser general public license", ("gnu", "lesser")),
    Notice("agpl", "gnu affero general public license", ("gnu", "affero")),
    Notice("mpl-2", "mozilla public license version 2", ("2",)),
    Notice("epl-2", "eclipse public license version 2", ("2",)),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose"),
    Notice("cc-by-nc", "creative commons attribution noncommercial"),
    Notice("cc-by-sa", "creative commons attribution sharealike"),
    Notice("cc-by-nd", "creative commons attribution noderivatives"),
    Notice("cc-by-sa", "cc by sa", ("cc", "by", "sa")),
    Notice("cc-by-nd", "cc by nd", ("cc", "by", "nd")),
    Notice("cc0", "cc0 1 0 universal", ("cc0",)),
    Notice("public-domain", "released into the public domain"),
)

_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_PLAIN = bytes.maketrans(_SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(_SEPARATORS) + bytes(range(0x61, 0x7B)))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")

#: notice, errors, whether whole words stand unedited, first and last place in the joined words
Match = tuple[int, int, bool, int, int]


def joined_words(text: bytes) -> tuple[int, str]:
    """Number of words and the words, with one blank before each and one behind the last."""
    found = text.translate(_PLAIN).split()
    return len(found), (b" ".join([b"", *found, b""])).decode("utf-8", "replace")


class Search:
    """The notices with their automaton and patterns, built once a task."""

    def __init__(self, notices: Iterable[Notice] = NOTICES, spacing: int = SPACING):
        self.notices = tuple(notices)
        self.errors = [n.errors(spacing) for n in self.notices]
        self.patterns = [
            regex.compile(f"(?:{regex.escape(n.phrase, literal_spaces=True)}){{e<={k}}}", regex.BESTMATCH)
            for n, k in zip(self.notices, self.errors)
        ]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(self.notices):
            for offset, piece in notice.pieces(spacing):
                seeds.setdefault(piece, []).append((i, offset))
            # The notice with nothing off, as whole words, is a seed of its own.
            seeds.setdefault(f" {notice.phrase} ", []).append((i, -1))
        self.automaton = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()

    def _verified(self, text: str, i: int, first: int, last: int) -> Match | None:
        """The best match of notice ``i`` that would begin, but for edits, between ``first`` and ``last``."""
        notice, k = self.notices[i], self.errors[i]
        start = max(first - k, 0)
        window = text[start : last + len(notice.phrase) + k]
        if any(key not in window for key in notice.keys):
            return None
        at = window.find(notice.phrase)
        if at >= 0:
            errors, a, b = 0, start + at, start + at + len(notice.phrase)
        elif k and (m := self.patterns[i].search(window)):
            errors, a, b = sum(m.fuzzy_counts), start + m.start(), start + m.end()
        else:
            return None
        # Blanks at the ends belong to no word; the words the match touches must hold the keys.
        while a < b and text[a] == " ":
            a += 1
        while b > a and text[b - 1] == " ":
            b -= 1
        if notice.keys and not set(notice.keys) <= set(text[text.rfind(" ", 0, a) + 1 : text.find(" ", b)].split()):
            return None
        return i, errors, False, a, b

    def matches(self, text: str) -> list[Match]:
        """Matches in joined words, by place."""
        expected: dict[int, list[int]] = {}
        exact: list[Match] = []
        for end, (length, uses) in self.automaton.iter(text):
            start = end - length + 1
            for i, offset in uses:
                if offset < 0:
                    exact.append((i, 0, True, start + 1, end))
                else:
                    expected.setdefault(i, []).append(start - offset)
        taken = {(i, a) for i, _, _, a, _ in exact}
        found = list(exact)
        for i, starts in expected.items():
            near: list[Match] = []
            for first, last in _groups(sorted(starts), self.errors[i]):
                match = self._verified(text, i, first, last)
                if match is not None:
                    near.append(match)
            near.extend(m for m in exact if m[0] == i)
            found.extend(m for m in _apart(near) if not m[2] and (i, m[3]) not in taken)
        return sorted(found, key=lambda m: (m[3], m[4], m[0]))


def _groups(starts: list[int], reach: int) -> Iterator[tuple[int, int]]:
    """Neighbouring places at most ``reach`` apart, as first and last."""
    first = last = starts[0]
    for start in starts[1:]:
        if start - first > reach:
            yield first, last
            first = start
        last = start
    yield first, last


def _apart(found: list[Match]) -> Iterator[Match]:
    """Of matches that overlap the one with the fewest errors, then the first."""
    best: Match | None = None
    for match in sorted(set(found), key=lambda m: (m[3], m[4], not m[2])):
        if best is not None and match[3] < best[4]:
            if (match[1], not match[2]) < (best[1], not best[2]):
                best = match
            continue
        if best is not None:
            yield best
        best = match
    if best is not None:
        yield best


_MATCH = pa.struct(
    [
        ("label", pa.string()), ("phrase", pa.string()), ("base", pa.bool_()), ("whole", pa.bool_()), ("errors", pa.int32()),
        ("similarity", pa.float64()), ("first_word", pa.int64()), ("words", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
    ]
)
SCHEMA = (
    "doc_id bigint, n_words bigint, matches array<struct<label: string, phrase: string, base: boolean, whole: boolean, "
    "errors: int, similarity: double, first_word: bigint, words: bigint, start: bigint, end: bigint>>"
)


def found_in(search: Search, text: bytes) -> tuple[int, list[dict]]:
    """Words of a text and its matches; ``start`` and ``end`` are code points of the text itself."""
    n_words, joined = joined_words(text)
    matches = search.matches(joined)
    if not matches:
        return n_words, []
    blanks = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), dtype="<u4") == 32)
    bounds = [m.span() for m in _WORD.finditer(text.decode("utf-8", "replace"))]
    rows = []
    for i, errors, whole, a, b in matches:
        notice = search.notices[i]
        first, last = int(np.searchsorted(blanks, a)) - 1, int(np.searchsorted(blanks, b - 1)) - 1
        rows.append(
            {
                "label": notice.label, "phrase": notice.phrase, "base": notice.base, "whole": whole, "errors": errors,
                "similarity": 1 - errors / len(notice.phrase), "first_word": first, "words": last - first + 1,
                "start": bounds[first][0], "end": bounds[last][1],
            }
        )
    return n_words, rows


def scanned(docs: DataFrame, notices: Iterable[Notice] = NOTICES, spacing: int = SPACING) -> DataFrame:
    """``(doc_id, n_words, matches)`` of every document; ``whole`` marks unedited places of whole words."""
    listed = tuple(notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(listed, spacing)
        for batch in batches:
            counts, rows = [], []
            for text in batch.column(1):
                n, found = found_in(search, text.as_py())
                counts.append(n)
                rows.append(found)
            made = [batch.column(0), pa.array(counts, pa.int64()), pa.array(rows, pa.list_(_MATCH))]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_words", "matches"])

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), corpus.text_bytes().alias("_text"))
    return given.mapInArrow(run, SCHEMA)


def base_places(matches: Column) -> Column:
    """The unedited whole-word places of base notices."""
    return F.filter(matches, lambda m: m["base"] & m["whole"])


def label_list(matches: Column) -> Column:
    """Distinct labels in order, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")
