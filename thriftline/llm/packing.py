"""Packing documents into token sequences by sum-of-squares online packing.

Tokens of a document are its ids and one end id.  A document's full windows of ``WINDOW`` tokens are
sequences of their own; what remains, shorter than a window, is placed whole into a
partly filled window.  The level array counts the open windows of every fill level; a
remainder goes to the level (a new window is level zero) for which the sum of the
squared counts afterwards is least, the fullest of equal ones.  With sizes of any mix this
keeps few windows open.  When a task's rows end, the pieces of its open windows are
laid end to end and cut at window borders, so a task pads one window at most.

Everything is local to a task: no shuffle, and memory for the open windows only.  Sequence ids carry the
task's partition number in their upper bits.

Ids are those that ``tokenizers`` gives with the vocabulary file.  Plain text (ASCII, Latin letters, common
punctuation, no very long word, no special token's string) goes through ``tiktoken`` with the same
vocabulary as ranks, which gives the same ids in a fifth of the time; all other text goes
through ``tokenizers`` itself.

Defined results: a NULL or empty text is one end id; a NULL id is kept; repeated rows are packed each; no
documents give no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from thriftline.llm import corpus

WINDOW = 1024
END_ID = 0
VOCABULARY = "byte_bpe_50k"
_ROWS = 4096
_PARTITION_SHIFT = 33
# Anything that the two tokenizers might split differently, or that only one is fast at.
_UNUSUAL = re.compile("[^\n\x20-\x7e\u00a1-\u00ac\u00ae-\u024f\u2013\u2014\u2018-\u201e\u2022\u2026\u20ac]|\\S{1000}")

_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = ", ".join(f"{c} bigint" for c in _COLUMNS)


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str = VOCABULARY):
        self.general = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        self.special = [t.content for t in self.general.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding(
            vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def __call__(self, text: str) -> bytes:
        if _UNUSUAL.search(text) or any(s in text for s in self.special):
            ids = self.general.encode(text, add_special_tokens=False).ids
        else:
            ids = self.plain.encode_ordinary(text)
        return np.asarray(ids, dtype="<u4").tobytes()


class Piece:
    """A run of one document's ids."""

    __slots__ = ("doc_id", "start", "ids", "doc_tokens")

    def __init__(self, doc_id: int | None, start: int, ids: bytes, doc_tokens: int):
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, at: int) -> tuple[Piece, Piece]:
        head = Piece(self.doc_id, self.start, self.ids[: 4 * at], self.doc_tokens)
        return head, Piece(self.doc_id, self.start + at, self.ids[4 * at :], self.doc_tokens)


class Packer:
    """Online packing of pieces no longer than a window; closed windows come out at once."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.levels = np.zeros(window, dtype=np.int64)  # open windows by fill level
        self.open: dict[int, list[list[Piece]]] = {}

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put a piece where the sum of squared counts is least; the window if that fills it."""
        size, counts = len(piece), self.levels
        if size == self.window:
            return [piece]
        # From level h to h + size: one fewer of h, one more of h + size, which does not count when full.
        after = np.zeros(self.window - size + 1, dtype=np.int64)
        after[:-1] = 2 * counts[size:] + 1
        change = after + 1 - 2 * counts[: self.window - size + 1]
        change[0] -= 1 - 2 * counts[0]
        usable = counts[: self.window - size + 1] > 0
        usable[0] = True
        change[~usable] = np.iinfo(np.int64).max
        level = len(change) - 1 - int(np.argmin(change[::-1]))
        held: list[Piece] = []
        if level:
            held = self.open[level].pop()
            counts[level] -= 1
        held.append(piece)
        full = level + size
        if full == self.window:
            return held
        self.open.setdefault(full, []).append(held)
        counts[full] += 1
        return None

    def rest(self) -> Iterator[list[Piece]]:
        """What the open windows hold, end to end and cut at window borders; only the last is not full."""
        now: list[Piece] = []
        room = self.window
        for level in sorted(self.open, reverse=True):
            for held in self.open[level]:
                for piece in held:
                    while len(piece) > room:
                        head, piece = piece.cut(room)
                        yield [*now, head]
                        now, room = [], self.window
                    now.append(piece)
                    room -= len(piece)
                    if not room:
                        yield now
                        now, room = [], self.window
        if now:
            yield now
        self.open = {}
        self.levels[:] = 0


def _packed(window: int, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = Encoder(vocabulary), Packer(window)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << _PARTITION_SHIFT
        rows: list[tuple] = []
        end = np.asarray([END_ID], dtype="<u4").tobytes()

        def close(pieces: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for p in pieces:
                rows.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, sequence, offset))
                offset += len(p)
            sequence += 1

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, _COLUMNS)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py().decode("utf-8", "replace")) + end
                tokens = len(ids) // 4
                for start in range(0, tokens, window):
                    piece = Piece(doc_id, start, ids[4 * start : 4 * (start + window)], tokens)
                    if full := packer.place(piece):
                        close(full)
                if len(rows) >= _ROWS:
                    yield flush()
        for pieces in packer.rest():
            close(pieces)
        if rows:
            yield flush()

    return run


def packed(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a piece: where it is cut from its document and where it lies in its sequence."""
    narrow = docs.select(F.col("doc_id").cast("bigint"), corpus.text_bytes())
    return narrow.mapInArrow(_packed(window, vocabulary), SCHEMA)
