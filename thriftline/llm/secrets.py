"""Secrets in texts, in clear and under nested encodings.

Three kinds are looked for in every layer: assignments (a key word, a separator, a value of at
least six characters), access keys and long runs of hex digits.  A layer is a text and, for each of its
characters, the stretch of the document it came from.  The document is the first layer on a
worklist; a layer taken from the list is scanned, then decoded in every way that applies:

* percent escapes and Unicode escapes are replaced in the whole layer;
* runs of base64 digits, also wrapped into lines of any width, are layers at each of the four alignments that has a
  readable stretch; unreadable bytes part such stretches;
* stretches of UTF-16 are layers of their own;
* base64 or percent-escaped bytes with the mark of gzip, zlib, bzip2, xz or zstandard, at their start or further on (zlib
  there with its common 32 KB window), are decompressed piece by piece, each piece a layer that overlaps the one before it;
  streams may follow each other.

A layer whose text and place were seen before is dropped, so the worklist ends at a fixpoint even
where layers decode to each other.  What follows from one decompressed piece is done before the next piece is taken, so
memory does not grow with what a compressed run unpacks to.  Findings are mapped back to code points of the document; what
compression hides gets the span of the compressed run.

Defined results: a NULL or empty text has no secrets (and stays as it is when redacted); equal spans of one
kind count once; repeated rows are scanned each; no documents give no rows.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from thriftline.llm import corpus

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE = 6

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:\r?\n[ \t]*[A-Za-z0-9+/_-]++)+={0,2}")
_BLANK = re.compile(r"\s+")
#: The shortest secret, ``token=abcdef``, has twelve characters, more when encoded; zero bytes may stand between them.
_READABLE = re.compile(rb"[\x00\t-\r -~]{12}")
_WIDE = re.compile("(?:[\t-\r -~]\0){11,}[\t-\r -~]")
#: Starts of compressed streams that other bytes may precede.
_MARK = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")
_ZEROS = re.compile(rb"\0*")

#: Characters of one decompressed piece, and how far neighbouring pieces overlap.
PIECE = 1 << 20
OVERLAP = 1 << 16
#: Compressed bytes handed over at once: a start that is none fails within the first.
FEED, MOST_FEED = 1 << 12, 1 << 18


def matches(text: str) -> Iterator[tuple[int, int, int]]:
    """``(kind, start, end)`` of the secrets that stand in ``text`` itself; kinds are positions in ``KINDS``."""
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= MIN_VALUE:
            yield 0, m.start(), m.end()
    for m in _ACCESS.finditer(text):
        yield 1, m.start(), m.end()
    for m in _HEX.finditer(text):
        yield 2, m.start(), m.end()


class Layer:
    """A decoded text; character ``i`` came from code points ``starts[i]`` to ``ends[i]`` of the document."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            at = np.arange(len(self.text) + 1)
            return at[:-1], at[1:]
        return self.starts, self.ends

    def replaced(self, pattern: re.Pattern, decode) -> Layer | None:
        """The layer with every match decoded in place; ``None`` when nothing changes."""
        parts, starts, ends, at, changed = [], [], [], 0, False
        own_starts, own_ends = self.bounds()
        for m in pattern.finditer(self.text):
            decoded = decode(m)
            if decoded is None:
                continue
            new, first, last = decoded  # characters, and each one's place within the match
            parts += [self.text[at : m.start()], new]
            starts += [own_starts[at : m.start()], own_starts[m.start() + first]]
            ends += [own_ends[at : m.start()], own_ends[m.start() + last - 1]]
            at, changed = m.end(), True
        if not changed:
            return None
        parts.append(self.text[at:])
        return Layer("".join(parts), np.concatenate([*starts, own_starts[at:]]), np.concatenate([*ends, own_ends[at:]]))


def _characters(data: bytes) -> tuple[str, np.ndarray, np.ndarray]:
    """UTF-8 to text (unreadable bytes as U+FFFD), with the first and last byte of each character."""
    text = data.decode("utf-8", "replace")
    if text.isascii():
        at = np.arange(len(text) + 1)
        return text, at[:-1], at[1:]
    if "\ufffd" in text:
        text = data.decode("latin-1")
        at = np.arange(len(text) + 1)
        return text, at[:-1], at[1:]
    ends = np.cumsum([len(c.encode()) for c in text])
    return text, np.concatenate([[0], ends[:-1]]), ends


def _percent(m: re.Match) -> tuple[str, np.ndarray, np.ndarray]:
    text, first, last = _characters(bytes.fromhex(m[0].replace("%", "")))
    return text, 3 * first, 3 * last


def _escape(m: re.Match):
    digits = next(g for g in m.groups() if g is not None)
    code = int(digits, 10 if m.lastindex == 6 else 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return chr(code), np.array([0]), np.array([m.end() - m.start()])


def _fed(data: bytes, at: int) -> Iterator[bytes]:
    size = FEED
    while at < len(data):
        yield data[at : at + size]
        at, size = at + size, min(4 * size, MOST_FEED)


def _inflate(data: bytes, at: int, bits: int, begun: set[int]) -> Iterator[bytes]:
    mark = data[at : at + 2]
    while data.startswith(mark, at):
        step, fed = zlib.decompressobj(bits), at
        for pending in _fed(data, at):
            fed += len(pending)
            while (piece := step.decompress(pending, PIECE)) or step.unconsumed_tail:
                if piece:
                    yield piece
                pending = step.unconsumed_tail
            if step.eof:
                break
        at = fed - len(step.unused_data)
        begun.add(at)


def _stepwise(start, data: bytes, at: int, mark: bytes, begun: set[int]) -> Iterator[bytes]:
    """Pieces of all streams that follow each other; zeros between them are padding."""
    while data.startswith(mark, at):
        step, fed = start(), at
        for pending in _fed(data, at):
            fed += len(pending)
            while True:
                if piece := step.decompress(pending, PIECE):
                    yield piece
                pending = b""
                if step.eof or step.needs_input:
                    break
            if step.eof:
                break
        at = _ZEROS.match(data, fed - len(step.unused_data)).end()
        begun.add(at)


def _unzstd(data: bytes, at: int) -> Iterator[bytes]:
    with zstandard.ZstdDecompressor().stream_reader(memoryview(data)[at:], read_across_frames=True) as source:
        while piece := source.read(PIECE):
            yield piece


def decompressed(data: bytes, at: int = 0, begun: set[int] | None = None) -> Iterator[bytes] | None:
    """Pieces of what stands in ``data`` from ``at`` if it has the mark of a compressed stream there.

    ``begun`` gets the places where one stream ends and another may follow.
    """
    begun = set() if begun is None else begun
    head = data[at : at + 7]
    if head[:2] == b"\x1f\x8b":
        return _inflate(data, at, 31, begun)
    if head[:3] == b"BZh":
        return _stepwise(bz2.BZ2Decompressor, data, at, head[:3], begun)
    if head[:6] == b"\xfd7zXZ\x00":
        return _stepwise(lzma.LZMADecompressor, data, at, head[:6], begun)
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return _unzstd(data, at)
    if len(head) > 6 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0:
        return _inflate(data, at, 15, begun)
    return None


_BROKEN = (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError)


def _streams(data: bytes, start: int, end: int) -> Iterator[Iterator[Layer]]:
    """The pieces of the compressed streams of a run, not begun yet; nothing for a run without a mark."""
    if decompressed(data) is not None or _MARK.search(data, 1):
        yield _unpacked(data, start, end)


def _unpacked(data: bytes, start: int, end: int) -> Iterator[Layer]:
    """Layers of the compressed streams of a run, also behind other bytes; a broken one gives what comes before the break."""
    begun: set[int] = set()
    for at in itertools.chain((0,), (m.start() for m in _MARK.finditer(data, 1))):
        if at in begun or (pieces := decompressed(data, at, begun)) is None:
            continue
        before = ""
        try:
            for piece in pieces:
                text = before + _characters(piece)[0]
                yield Layer(text, np.broadcast_to(start, len(text)), np.broadcast_to(end, len(text)))
                before = text[-OVERLAP:]
        except _BROKEN:
            continue


def _from_base64(layer: Layer, digits: str, places: np.ndarray) -> Iterator[Layer | Iterator[Layer]]:
    """What base64 ``digits`` hold at each alignment; ``places`` are the digits' places in the layer.

    Unreadable bytes stay as characters that no pattern matches, so they part the readable stretches.
    """
    digits = digits.rstrip("=").replace("-", "+").replace("_", "/")
    starts, ends = layer.bounds()
    for shift in range(4):
        body = digits[shift:]
        body = body[:-1] if len(body) % 4 == 1 else body
        if len(body) < 12:
            return
        try:
            data = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
        except binascii.Error:
            continue
        run = places[shift : shift + len(body)]
        yield from _streams(data, int(starts[run[0]]), int(ends[places[-1]]))
        if not _READABLE.search(data):
            continue
        text, first, last = _characters(data)
        # Byte i of a group of three needs digits i and i + 1 of its four.
        head = run[first * 4 // 3]
        tail = run[np.minimum(-(-last * 4 // 3), len(run)) - 1]
        yield Layer(text, starts[head], ends[tail])


def _from_wide(layer: Layer) -> Iterator[Layer]:
    """Stretches of UTF-16 of either byte order: readable characters with a zero byte between them."""
    starts, ends = layer.bounds()
    for m in _WIDE.finditer(layer.text):
        at = slice(m.start(), m.end(), 2)
        yield Layer(layer.text[at], starts[at], ends[at])


def decoded(layer: Layer) -> Iterator[Layer | Iterator[Layer]]:
    """Every layer that ``layer`` decodes to in one step; compressed streams as iterators over their pieces."""
    text = layer.text
    if "%" in text:
        for m in _PERCENT.finditer(text):
            if len(m[0]) >= 30:
                yield from _streams(bytes.fromhex(m[0].replace("%", "")), *layer.span(m.start(), m.end()))
        if (new := layer.replaced(_PERCENT, _percent)) is not None:
            yield new
    if "\\" in text or "&#" in text:
        if (new := layer.replaced(_ESCAPE, _escape)) is not None:
            yield new
    if "\0" in text:
        yield from _from_wide(layer)
    for m in _BASE64.finditer(text):
        yield from _from_base64(layer, m[0], np.arange(m.start(), m.end()))
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            digits = _BLANK.sub("", m[0])
            if len(digits) >= 16:
                shown = np.frombuffer(m[0].encode(), dtype=np.uint8) > 32
                yield from _from_base64(layer, digits, m.start() + np.flatnonzero(shown))


Span = tuple[int, int, int]


def secrets(text: str) -> tuple[list[Span], list[Span]]:
    """``(kind, start, end)`` found in the text itself and found in any layer, by start, kind and end."""
    by_start = lambda s: (s[1], s[0], s[2])
    base = sorted(matches(text), key=by_start)
    found, seen = set(base), set()
    work: list[Layer | Iterator[Layer]] = [Layer(text)]

    def add(new: Layer) -> None:
        if not new.text:
            return
        place = new.span(0, len(new.text))
        mark = hashlib.blake2b(f"{place}{new.text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if mark not in seen:
            seen.add(mark)
            found.update((kind, *new.span(start, end)) for kind, start, end in matches(new.text))
            work.append(new)

    while work:
        taken = work.pop()
        if isinstance(taken, Layer):
            for new in decoded(taken):
                if isinstance(new, Layer):
                    add(new)
                else:
                    work.append(new)
        elif (piece := next(taken, None)) is not None:
            work.append(taken)
            add(piece)
    return base, sorted(found, key=by_start)


def span_list(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


def redacted(text: str, mark: str = "[redacted]") -> str:
    """The text with every secret's stretch replaced; stretches that touch or overlap become one."""
    parts, at = [], 0
    merged: list[list[int]] = []
    for _, start, end in secrets(text)[1]:
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        parts += [text[at:start], mark]
        at = end
    return "".join([*parts, text[at:]])


def _measured(texts: Iterable[bytes]) -> dict[str, list]:
    found: dict[str, list] = {n: [] for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
    for text in texts:
        base, every = secrets(text.decode("utf-8", "replace"))
        for kind, name in enumerate(KINDS):
            found[f"n_{name}"].append(sum(s[0] == kind for s in base))
        found["base_sha256"].append(hashlib.sha256(span_list(base).encode()).hexdigest())
        found["spans"].append(span_list(every))
    return found


def scanned(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of every document."""
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return corpus.each_text(docs, [F.col("doc_id").cast("bigint").alias("doc_id")], _measured, schema)


@F.pandas_udf(StringType())
def _redact(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else redacted(t) for t in texts], dtype="object")


def without_secrets(docs: DataFrame) -> DataFrame:
    """The documents with every secret redacted, layers included; ``n_chars`` follows the text where there is one."""
    clean = docs.withColumn("text", _redact("text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.length("text").cast(kind))
    return clean.select(*docs.columns)
