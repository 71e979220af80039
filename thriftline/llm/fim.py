"""Fill-in-the-middle: texts cut at word or line ends and put together in another order.

The bytes of a block of texts form one sequence of small symbols: the class of each byte
(blank, line break, first byte of a character, further byte) and whether white space or the
end of the text follows it.  A wavelet matrix over the symbols answers how many symbols of a range stand
before a position, three bit vectors a query.  Sums of such ranks count what cuts need:
word ends are first or further bytes before white space, line ends are breaks, characters are all
but further bytes.  A cut behind ``k`` units is found by bisection on that count, for all texts of
the block at once.

A text's units are its words with the white space before each (white space at the end is a unit of its
own) or its lines with their breaks.  The digest of seed and ``doc_id`` draws two cuts among the units, the
form and so the output: ``psm`` is prefix, suffix, middle and ``spm`` is suffix, prefix, middle, each part behind
its mark; ``plain`` is the text itself.  Texts that hold a mark stay plain, so an output can always be read back.

Defined results: a NULL or empty text is plain with no units; a NULL ``doc_id`` is drawn for as an empty
number; repeated rows get equal rows; one text may have any length and is in memory whole, with about three
times its size for the matrix; no documents give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftline.llm import corpus

SEED = 42
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, how many are cut, and how many of those put the suffix first.
CUT_PERCENT = 50
SPM_PERCENT = 80

#: Bytes of text under one matrix; a longer text has one of its own.
BLOCK = 8 << 20

_BLANK, _BREAK, _FIRST, _FURTHER = range(4)
_ENDS = 4  # added to the class where white space or nothing follows
_LEVELS = 3
#: Symbol ranges whose counts are the boundaries of a unit.
UNITS = {"word": ((_ENDS + _FIRST, _ENDS + _FURTHER + 1),), "line": ((_BREAK, _BREAK + 1), (_ENDS + _BREAK, _ENDS + _BREAK + 1))}
_FURTHER_BYTES = ((_FURTHER, _FURTHER + 1), (_ENDS + _FURTHER, _ENDS + _FURTHER + 1))

_CLASS = np.full(256, _FIRST, dtype=np.uint8)
_CLASS[[0x20, 0x09]] = _BLANK
_CLASS[0x0A:0x0E] = _BREAK
_CLASS[0x80:0xC0] = _FURTHER


class Bits:
    """A bit vector that counts the ones before any position."""

    def __init__(self, ones: np.ndarray):
        packed = np.packbits(ones, bitorder="little")
        words = np.zeros(len(ones) // 64 + 1, dtype="<u8")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Counts of symbol ranges before any position of a sequence of numbers below ``2 ** levels``."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels = []
        for bit in reversed(range(levels)):
            ones = (symbols >> bit & 1).astype(bool)
            zeros = symbols[~ones]
            self.levels.append((bit, Bits(ones), len(zeros)))
            symbols = np.concatenate([zeros, symbols[ones]])

    def below(self, bound: int, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` symbols are less than ``bound``."""
        if bound >> len(self.levels):
            return at
        start = np.zeros(1, dtype=np.int64)
        stop, found = at, np.zeros_like(at)
        for bit, ones, zeros in self.levels:
            first, last = ones.rank(start), ones.rank(stop)
            if bound >> bit & 1:
                found = found + (stop - last) - (start - first)
                start, stop = zeros + first, zeros + last
            else:
                start, stop = start - first, stop - last
        return found

    def count(self, ranges: tuple[tuple[int, int], ...], at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` symbols lie in one of the ``ranges``."""
        return sum(self.below(stop, at) - self.below(start, at) for start, stop in ranges)


class Block:
    """Texts that follow each other in ``data``, text ``i`` from ``offsets[i]`` to ``offsets[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str = "word"):
        self.starts, self.stops = offsets[:-1], offsets[1:]
        classes = _CLASS[data]
        white = classes < _FIRST
        ends = np.append(white[1:], True) if len(white) else white
        ends[self.stops[self.stops > self.starts] - 1] = True
        self.matrix = WaveletMatrix(classes + _ENDS * ends.astype(np.uint8), _LEVELS)
        self.ranges = UNITS[unit]
        self.skipped = self.matrix.count(self.ranges, self.starts)
        self.bounds = self.matrix.count(self.ranges, self.stops) - self.skipped
        # What follows the last boundary is a unit as well.
        full = self.stops > self.starts
        last = np.where(full, self.stops - 1, self.starts)
        self.units = self.bounds + (full & (self.matrix.count(self.ranges, last) - self.skipped == self.bounds))

    def cut(self, k: np.ndarray) -> np.ndarray:
        """Where the first ``k[i]`` units of text ``i`` end: the least place with ``k[i]`` boundaries before it."""
        low, high = self.starts.copy(), self.stops.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self.matrix.count(self.ranges, middle) - self.skipped >= k
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low

    def characters(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        further = self.matrix.count(_FURTHER_BYTES, stop) - self.matrix.count(_FURTHER_BYTES, start)
        return stop - start - further


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers below ``2 ** 32`` from the digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def _holds_mark(text: bytes) -> bool:
    return b"<" in text and any(mark.encode() in text for mark in (PREFIX, SUFFIX, MIDDLE))


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about :data:`BLOCK` bytes."""
    at = 0
    while at < len(offsets) - 1:
        stop = max(int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1, at + 1)
        yield at, stop
        at = stop


def _views(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow column of binaries, in place."""
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), places


def transform(ids: list, data: np.ndarray, offsets: np.ndarray, unit: str, cut_percent: int, spm_percent: int, seed: int) -> dict[str, list]:
    """Forms, parts and outputs of the texts of one block."""
    block = Block(data, offsets, unit)
    drawn = np.array([draws(i, seed) for i in ids], dtype=np.int64).reshape(-1, 4)
    chosen = np.sort(drawn[:, :2] % (block.units[:, None] + 1), axis=1)
    first, second = block.cut(chosen[:, 0]), block.cut(chosen[:, 1])
    prefix, middle = block.characters(block.starts, first), block.characters(first, second)
    found: dict[str, list] = {name: [] for name in ("n", "form", "prefix_chars", "middle_chars", "output")}
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    whole = data.tobytes()
    for i, (start, stop, a, b) in enumerate(zip(block.starts.tolist(), block.stops.tolist(), first.tolist(), second.tolist())):
        text = whole[start:stop]
        plain = not text or drawn[i, 2] % 100 >= cut_percent or _holds_mark(text)
        form = "plain" if plain else "spm" if drawn[i, 3] % 100 < spm_percent else "psm"
        head, body, tail = whole[start:a], whole[a:b], whole[b:stop]
        found["n"].append(int(block.units[i]))
        found["form"].append(form)
        found["prefix_chars"].append(None if plain else int(prefix[i]))
        found["middle_chars"].append(None if plain else int(middle[i]))
        found["output"].append(text if plain else p + head + s + tail + m + body if form == "psm" else s + tail + p + head + m + body)
    return found


SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
)


def transformed(
    docs: DataFrame, unit: str = "word", cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED
) -> DataFrame:
    """Every document as ``(doc_id, n, form, prefix_chars, middle_chars, output)``; part sizes are NULL where it is plain."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit: {unit}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _views(batch.column(1))
            for start, stop in _blocks(offsets):
                own = offsets[start : stop + 1]
                ids = batch.column(0).slice(start, stop - start)
                found = transform(ids.to_pylist(), data[own[0] : own[-1]], own - own[0], unit, cut_percent, spm_percent, seed)
                output = pa.array(found.pop("output"), pa.binary()).cast(pa.string(), safe=False)
                made = [pa.array(found[f.name], f.type) for f in list(_ARROW)[1:-1]]
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *made, output], schema=_ARROW)

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), corpus.text_bytes().alias("_text"))
    return given.mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from.  Marks begin with the only ``<`` they have, so none can arise at a seam."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.element_at(parts, i)
    return (
        F.when(form == "psm", F.concat(part(2), part(4), part(3)))
        .when(form == "spm", F.concat(part(3), part(4), part(2)))
        .otherwise(output)
    )
