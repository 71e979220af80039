"""Chat formatting with a template that is called as a black box.

The template is any function from a list of turns to a text.  Its output for each prefix of a conversation is
compared with the output for the prefix before: where the one continues the other, what was added is
the new turn's span; where it does not, the template rewrites history, and only turns whose
prefixes still begin the final text can be located.  Within an assistant turn's span two probes that
differ in one character show where the turn's own text begins and ends; that is what the loss covers.

The template here marks turns with control strings and escapes those inside texts: a backslash
doubles, and one is put after the first character of every control string, so that reading back is exact and no
text can open or close a turn.

A conversation is the unit of work: its rows meet in one task, in the order of ``turn`` (NULL first), then role
and text, and prefixes cost the square of its number of turns.  Conversations are streamed, one in memory
at a time.

Defined results: a NULL text is empty; a NULL role is a role with an empty name; repeated rows and tied turns are
turns each; rows without a ``conv_id`` form one conversation; no rows give no conversations.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

_CONTROL = re.compile(r"<(?=/?s>)|\[(?=/?(?:INST|SYS|ROLE)\])")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
PROBES = ("0", "1")
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\g<0>\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def template(turns: list[Turn]) -> str:
    """One marked block a turn."""
    blocks = []
    for role, text in turns:
        body = escape(text)
        if role == "user":
            blocks.append(f"<s>[INST] {body} [/INST]")
        elif role == "system":
            blocks.append(f"<s>[SYS] {body} [/SYS]")
        elif role == LOSS_ROLE:
            blocks.append(f"<s>{body}</s>")
        else:
            blocks.append(f"<s>[ROLE] {escape(role)} [/ROLE]{body}</s>")
    return "".join(blocks)


def read_back(formatted: str) -> list[Turn]:
    """The turns that :func:`template` was given."""
    turns = []
    for block in formatted.split("<s>")[1:]:
        if block.startswith("[INST] "):
            role, body = "user", block[len("[INST] ") : -len(" [/INST]")]
        elif block.startswith("[SYS] "):
            role, body = "system", block[len("[SYS] ") : -len(" [/SYS]")]
        elif block.startswith("[ROLE] "):
            name, body = block[len("[ROLE] ") : -len("</s>")].split(" [/ROLE]", 1)
            role = unescape(name)
        else:
            role, body = LOSS_ROLE, block[: -len("</s>")]
        turns.append((role, unescape(body)))
    return turns


class Formatted:
    """A rendered conversation: turn spans, loss spans and the first turn that changed what stood before."""

    def __init__(self, text: str, spans: list[tuple[int, int] | None], loss: list[tuple[int, int]], rewritten_at: int | None):
        self.text, self.spans, self.loss, self.rewritten_at = text, spans, loss, rewritten_at


def _own_text(render: Template, before: list[Turn], role: str, start: int, end: int) -> tuple[int, int] | None:
    """Where the text of a turn spanning ``start`` to ``end`` lies, from two probes in its place."""
    one, other = (render([*before, (role, p)]) for p in PROBES)
    if len(one) != len(other) or one[:start] != other[:start]:
        return None
    differ = [i for i in range(start, len(one)) if one[i] != other[i]]
    if len(differ) != 1:
        return None
    after = len(one) - differ[0] - 1
    return (differ[0], end - after) if differ[0] <= end - after else None


def format_turns(turns: list[Turn], render: Template = template) -> Formatted:
    """Render all prefixes and compare each with the one before."""
    borders: list[int | None] = [0]
    rewritten_at, before = None, ""
    for k in range(1, len(turns) + 1):
        now = render(turns[:k])
        if not now.startswith(before):
            rewritten_at = k - 1 if rewritten_at is None else rewritten_at
            # Earlier borders beyond the part that stayed are no longer places in the text.
            same = next((i for i, (x, y) in enumerate(zip(before, now, strict=False)) if x != y), min(len(before), len(now)))
            borders = [b if b is not None and b <= same else None for b in borders]
        borders.append(len(now))
        before = now
    spans: list[tuple[int, int] | None] = [
        (a, b) if a is not None and b is not None else None for a, b in itertools.pairwise(borders)
    ]
    loss = []
    for k, (span, (role, _)) in enumerate(zip(spans, turns, strict=True)):
        if role == LOSS_ROLE and span is not None and (own := _own_text(render, turns[:k], role, *span)):
            loss.append(own)
    return Formatted(before, spans, loss, rewritten_at)


_SCHEMA = (
    "conv_id bigint, text string, roles array<string>, starts array<bigint>, ends array<bigint>, "
    "loss_starts array<bigint>, loss_ends array<bigint>, rewritten_at int"
)


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    """Runs of rows of one conversation, which may lie across batches."""
    key, turns = None, []
    for batch in batches:
        for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if turns and conv_id != key:
                yield key, turns
                turns = []
            key = conv_id
            turns.append((role, text))
    if turns:
        yield key, turns


def formatted(conversations: DataFrame, render: Template = template) -> DataFrame:
    """One row a conversation: its text, each turn's role and span, the spans under the loss.

    Spans that cannot be located are NULL in ``starts`` and ``ends``; ``rewritten_at`` is the first turn
    that changed what stood before it, NULL for a template that only ever appends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[] for _ in range(8)]
        kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), *[pa.list_(pa.int64())] * 4, pa.int32()]
        names = [part.split()[0] for part in _SCHEMA.split(", ")]
        held = 0
        for conv_id, turns in _conversations(batches):
            made = format_turns(turns, render)
            row = (
                conv_id, made.text, [r for r, _ in turns], [s and s[0] for s in made.spans], [s and s[1] for s in made.spans],
                [a for a, _ in made.loss], [b for _, b in made.loss], made.rewritten_at,
            )
            for column, value in zip(rows, row, strict=True):
                column.append(value)
            held += len(made.text)
            if held > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)
                rows, held = [[] for _ in range(8)], 0
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)

    return (
        conversations.select(
            F.col("conv_id").cast("bigint").alias("conv_id"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
            F.col("turn").alias("turn"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
        .mapInArrow(run, _SCHEMA)
    )


def digests(made: DataFrame) -> DataFrame:
    """What reading back gives: turns from the text, assistant texts from the loss spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            ids, texts, starts, ends = (c.to_pylist() for c in batch.columns)
            for text, a, b in zip(texts, starts, ends, strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[i:j]) for i, j in zip(a, b, strict=True))
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                out["loss_chars"].append(len(loss))
                out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
                out["formatted_chars"].append(len(text))
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, pa.int64()), **out})

    schema = (
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
    return made.select("conv_id", "text", "loss_starts", "loss_ends").mapInArrow(run, schema)
