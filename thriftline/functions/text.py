"""Expressions over source text, model responses and requirement lines.

Lines break at ``\\n``, ``\\r\\n`` and ``\\r`` only, which is how Python numbers the
lines of a module.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from thriftline import fixed_values as fixed

# Characters that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BREAK = r"\r\n|\n|\r"
_FENCE = r"(?s)```(?:python)?\n(.*?)```"
_TAGGED_FENCE = r"(?s)```python" + _WS + r"*(.*?)```"
_FROM_CODE_LINE = (
    r"(?sm)^" + _WS + r"*(?:" + "|".join(fixed.CODE_LINE_STARTS) + r").*\z"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n|\r", "\n")


def split_lines(text: Column) -> Column:
    """Lines without their ends; a final line end does not open another line."""
    body = F.regexp_replace(text, r"(?:\r\n|\n|\r)\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, _BREAK, -1))


def keep_line_ends(text: Column) -> Column:
    """Lines with their ``\\n`` kept, for newline-normalised text."""
    return F.filter(F.split(text, r"(?<=\n)", -1), lambda line: line != "")


def count_lines(text: Column) -> Column:
    return F.size(split_lines(text))


def slice_lines(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first..last`` (1-based, inclusive) joined by ``\\n``."""
    length = F.greatest(last - first + 1, F.lit(0)).cast("int")
    return F.array_join(F.slice(split_lines(text), first.cast("int"), length), "\n")


def leading_space(line: Column) -> Column:
    return F.regexp_extract(line, r"\A(" + _WS + r"*)", 1)


def indent_of(text: Column, line_no: Column) -> Column:
    """Leading whitespace of a line; empty past the end, all of a blank line."""
    return F.coalesce(leading_space(F.get(split_lines(text), (line_no - 1).cast("int"))), F.lit(""))


def apply_indent(code: Column, indent: Column) -> Column:
    """Indent every line unless the first one already has the indent."""

    def body(bound: Column) -> Column:
        ready = (
            (bound["indent"] == "")
            | (F.size(bound["lines"]) == 0)
            | F.startswith(F.get(bound["lines"], F.lit(0)), bound["indent"])
        )
        shifted = F.transform(bound["lines"], lambda line: F.concat(bound["indent"], line))
        return F.when(ready, bound["code"]).otherwise(F.array_join(shifted, "\n"))

    return let(
        F.struct(code.alias("code"), split_lines(code).alias("lines"), indent.alias("indent")),
        body,
    )


def reindent(code: Column, target: Column) -> Column:
    """Replace the indent of the first non-blank line by ``target`` on every line."""

    def shift(line: Column, bound: Column) -> Column:
        kept = F.concat(bound["target"], F.substring(line, F.length(bound["base"]) + 1, F.length(line)))
        return (
            F.when(strip(line) == "", F.lit(""))
            .when(F.startswith(line, bound["base"]), kept)
            .otherwise(F.concat(bound["target"], F.ltrim(line, F.lit(WHITESPACE))))
        )

    lines = F.split(code, "\n", -1)
    base = leading_space(F.get(F.filter(lines, lambda line: strip(line) != ""), F.lit(0)))
    bound = F.struct(
        lines.alias("lines"), F.coalesce(base, F.lit("")).alias("base"), target.alias("target")
    )
    return let(bound, lambda b: F.array_join(F.transform(b["lines"], lambda line: shift(line, b)), "\n"))


def dedent_indent(code: Column, spaces: Column) -> Column:
    """Drop the common leading blanks, then indent non-blank lines by ``spaces``."""
    lines = F.split(code, "\n", -1)
    solid = F.filter(lines, lambda line: F.rlike(line, F.lit(r"[^ \t]")))
    indents = F.transform(solid, lambda line: F.regexp_extract(line, r"\A([ \t]*)", 1))

    def margin(span: Column) -> Column:
        # The common prefix of all indents is that of the least and the greatest.
        common = F.filter(
            F.sequence(F.lit(0), F.length(span["lo"])),
            lambda n: F.left(span["lo"], n) == F.left(span["hi"], n),
        )
        return F.coalesce(F.array_max(common), F.lit(0))

    def shift(line: Column, bound: Column) -> Column:
        blank = ~F.rlike(line, F.lit(r"[^ \t]"))
        cut = F.substring(line, bound["margin"] + 1, F.length(line))
        padded = F.when(strip(cut) == "", cut).otherwise(F.concat(bound["pad"], cut))
        return F.when(blank, F.lit("")).otherwise(padded)

    span = let(indents, lambda i: F.struct(F.array_min(i).alias("lo"), F.array_max(i).alias("hi")))
    bound = F.struct(
        lines.alias("lines"),
        F.coalesce(let(span, margin), F.lit(0)).alias("margin"),
        F.repeat(F.lit(" "), spaces.cast("int")).alias("pad"),
    )
    return let(bound, lambda b: F.array_join(F.transform(b["lines"], lambda line: shift(line, b)), "\n"))


def extract_code(raw: Column) -> Column:
    """Code of a model response: first fence, else from the first code-like line, else all."""
    bare = strip(raw)
    return (
        F.when(F.rlike(raw, F.lit(_FENCE)), strip(F.regexp_extract(raw, _FENCE, 1)))
        .when(
            F.rlike(bare, F.lit(_FROM_CODE_LINE)),
            strip(normalize_newlines(F.regexp_extract(bare, _FROM_CODE_LINE, 0))),
        )
        .otherwise(bare)
    )


def extract_tagged_code(raw: Column) -> Column:
    """Code of the first fence tagged ``python``, else the trimmed response."""
    tagged = F.rtrim(F.regexp_extract(raw, _TAGGED_FENCE, 1), F.lit("\n"))
    return F.when(F.rlike(raw, F.lit(_TAGGED_FENCE)), tagged).otherwise(strip(raw))


def truncate(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def requirement_of(line: Column) -> Column:
    """The part of a requirements line before its comment, stripped."""
    return strip(F.substring_index(line, fixed.COMMENT_MARK, 1))


def is_requirement(spec: Column) -> Column:
    return (spec != "") & ~F.startswith(spec, F.lit(fixed.INSTALLER_PREFIX))


def benchmark_call(name: Column, n_args: Column) -> Column:
    """A call with one constant per positional parameter; one when the count is unknown."""
    count = F.coalesce(n_args, F.lit(1)).cast("int")
    arguments = F.array_join(F.array_repeat(F.lit(fixed.BENCHMARK_ARGUMENT), count), ", ")
    return F.concat(name, F.lit("("), arguments, F.lit(")"))


def _fenced(code: Column) -> Column:
    return F.concat(F.lit("```python\n"), F.coalesce(code, F.lit("")), F.lit("\n```"))


def spec_request(id_: Column, file: Column, code: Column) -> Column:
    """Text that asks for tests of one function."""
    return F.concat(
        F.lit("Tests wanted for "), id_, F.lit(" in "), file, F.lit(":\n"), _fenced(code)
    )


def rewrite_request(code: Column, attempt: Column, reason: Column, output: Column, spec: Column) -> Column:
    """Text that asks for a cheaper rewrite; a retry adds reason, test output and tests."""
    first = F.concat(F.lit("Cheaper rewrite wanted:\n"), _fenced(code))
    retry = F.concat(
        F.lit("\nThe last try was refused: "),
        F.coalesce(reason, F.lit("")),
        F.lit("\nTest output:\n"),
        truncate(output, fixed.TEST_OUTPUT_CHARS),
        F.lit("\nTests to pass:\n"),
        _fenced(spec),
    )
    again = (attempt > 1) & (F.coalesce(output, F.lit("")) != "")
    return F.concat(first, F.when(again, retry).otherwise(F.lit("")))
