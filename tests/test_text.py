"""Text expressions against the behaviour of Python's own string functions."""

from __future__ import annotations

import re
import textwrap

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thriftline.functions import paths
from thriftline.functions import text as tx

TEXTS = [
    "", "a", "a\n", "\n", "\n\n", "a\nb", "a\nb\n", "a\r\nb", "a\rb\r", " \n x\n", "a\x0cb\n", "\t\tx\n  y", "ab\n\ncd\n\n",
    "   ", "  a\n    b\n  c\n", "　x ", "﻿x",
]


def python_lines(text):
    """Lines as the Python tokenizer counts them."""
    parts = re.split(r"\r\n|\n|\r", text)
    return parts[:-1] if parts[-1] == "" else parts


def test_split_lines(column):
    assert column([(t,) for t in TEXTS], "t string", tx.split_lines(F.col("t"))) == [python_lines(t) for t in TEXTS]


def test_count_lines(column):
    assert column([(t,) for t in TEXTS], "t string", tx.count_lines(F.col("t"))) == [len(python_lines(t)) for t in TEXTS]


def test_form_feed_is_not_a_line_end(column):
    assert column([("a\x0cb\nc",)], "t string", tx.count_lines(F.col("t"))) == [2]


def test_strip_removes_what_python_strips(column):
    everything = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    rows = [(t,) for t in TEXTS] + [(everything + "x y" + everything,)]
    assert column(rows, "t string", tx.strip(F.col("t"))) == [t.strip() for (t,) in rows]


def test_keep_line_ends_rebuilds_the_text(column):
    texts = [t.replace("\r\n", "\n").replace("\r", "\n") for t in TEXTS]
    rows = [(t,) for t in texts]
    assert column(rows, "t string", F.array_join(tx.keep_line_ends(F.col("t")), "")) == texts


def test_slice_lines(column):
    text = "l1\nl2\nl3"
    rows = [(text, 1, 1), (text, 2, 3), (text, 3, 9), (text, 4, 5), (text, 3, 2)]
    sliced = tx.slice_lines(F.col("t"), F.col("a"), F.col("b"))
    assert column(rows, "t string, a int, b int", sliced) == ["l1", "l2\nl3", "l3", "", ""]


def test_indent_of(column):
    text = "a\n    b\n\t\tc\n   \n d"
    rows = [(text, n) for n in range(1, 8)]
    assert column(rows, "t string, n int", tx.indent_of(F.col("t"), F.col("n"))) == ["", "    ", "\t\t", "   ", " ", "", ""]


def test_apply_indent(column):
    rows = [("a\nb", "  "), ("  a\nb", "  "), ("", "  "), ("a\nb\n", ""), ("a\n\nb\n", "\t"), (" a", "  ")]
    got = column(rows, "c string, i string", tx.apply_indent(F.col("c"), F.col("i")))
    assert got == ["  a\n  b", "  a\nb", "", "a\nb\n", "\ta\n\t\n\tb", "   a"]


def test_reindent(column):
    rows = [
        ("def f():\n    return 1", "    "),
        ("    def f():\n        return 1\n\n", ""),
        ("\n\n  a\n b\n   c", "\t"),
        ("\ta\n\t\tb", "  "),
        ("   \n  ", "  "),
        ("", "  "),
    ]
    got = column(rows, "c string, i string", tx.reindent(F.col("c"), F.col("i")))
    assert got == [
        "    def f():\n        return 1", "def f():\n    return 1\n\n", "\n\n\ta\n\tb\n\t c", "  a\n  \tb", "\n", "",
    ]


DEDENT_CASES = [
    "  a\n    b\n  c", "\ta\n\t\tb", "a\n  b", "  a\n\n   \n  b\n", " \t a\n \tb", "    a\n\tb", "", "  \n  ", "   x",
]


def test_dedent_indent(column):
    rows = [(c, n) for c in DEDENT_CASES for n in (0, 3)]
    want = [textwrap.indent(textwrap.dedent(c), " " * n) if n else textwrap.dedent(c) for c, n in rows]
    got = column(rows, "c string, n int", tx.dedent_indent(F.col("c"), F.col("n")))
    assert got == want


def test_extract_code(column):
    cases = {
        "text\n```python\nx = 1\n```\nmore": "x = 1",
        "```\n  y = 2  \n```": "y = 2",
        "```python\n```": "",
        "```python x = 1\n```": "```python x = 1\n```",
        "Sure!\n\n  import os\nprint(1)\n": "import os\nprint(1)",
        "Note\r\n# c\r\nx": "# c\nx",
        "defer this": "defer this",
        "  plain  ": "plain",
        "a\n```python\none\n```\n```python\ntwo\n```": "one",
        "": "",
    }
    assert column([(c,) for c in cases], "t string", tx.extract_code(F.col("t"))) == list(cases.values())


def test_extract_tagged_code(column):
    cases = {
        "```python\n    x = 1\n    y\n\n```": "x = 1\n    y",
        "```\nx\n```": "```\nx\n```",
        " plain \n": "plain",
        "```python```": "",
    }
    assert column([(c,) for c in cases], "t string", tx.extract_tagged_code(F.col("t"))) == list(cases.values())


def test_requirements(column):
    lines = ["numpy==1.0  # pin", "pip install x", "# only", "\t padded \t", "", "git+https://h/x#egg=x", "pip", "  pip -U y"]
    specs = column([(l,) for l in lines], "l string", tx.requirement_of(F.col("l")))
    assert specs == ["numpy==1.0", "pip install x", "", "padded", "", "git+https://h/x", "pip", "pip -U y"]
    kept = column([(s,) for s in specs], "s string", tx.is_requirement(F.col("s")))
    assert kept == [True, False, False, True, False, True, True, False]


def test_benchmark_call(column):
    rows = [("f", 0), ("f", 1), ("f", 3), ("f", None)]
    got = column(rows, "n string, k int", tx.benchmark_call(F.col("n"), F.col("k")))
    assert got == ["f()", "f(97)", "f(97, 97, 97)", "f(97)"]


def test_rewrite_request_adds_the_retry_part_only_with_output(column):
    rows = [(1, "out"), (2, None), (2, ""), (2, "o" * 5000)]
    request = tx.rewrite_request(F.lit("code"), F.col("a"), F.lit("why"), F.col("o"), F.lit("spec"))
    first, none, empty, full = column(rows, "a int, o string", request)
    assert first == none == empty and "why" not in first
    assert full.startswith(first) and full.count("o" * 2000) == 1 and "o" * 2001 not in full and "spec" in full


def test_paths(column):
    cases = {
        "venv/a.py": (True, False), "Venv/a.py": (False, False), "TESTS/a.py": (False, True), "test_x.py": (False, True),
        "a/X_TEST.py": (False, True), "contest.py": (False, False), "spec/a.py": (False, True), "a/build/b.py": (True, False),
        "spec_a.py": (False, True), "a/b_spec.py": (False, True), "prebuild/a.py": (False, False), "latest/a.py": (False, False),
    }
    rows = [(c,) for c in cases]
    assert column(rows, "f string", paths.is_excluded(F.col("f"))) == [v[0] for v in cases.values()]
    assert column(rows, "f string", paths.is_test_file(F.col("f"))) == [v[1] for v in cases.values()]


def test_module_name_and_stem(column):
    rows = [("my-pkg/a-b.py",), ("a/__init__.py",), ("a/b.c.py",), (".hidden",), ("x/.py",), ("noext",)]
    assert column(rows, "f string", paths.module_name(F.col("f"))) == [
        "my_pkg.a_b", "a.__init__", "a.b.c", ".hidden", "x..py", "noext",
    ]
    assert column(rows, "f string", paths.stem(F.col("f"))) == ["a-b", "__init__", "b.c", ".hidden", ".py", "noext"]


def test_paths_sort_by_part(spark):
    files = spark.createDataFrame([("a-b/c.py",), ("a/z.py",), ("a.py",), ("a/b/c.py",)], "f string")
    got = [r.f for r in files.orderBy(paths.path_sort_key(F.col("f"))).collect()]
    assert got == ["a/b/c.py", "a/z.py", "a-b/c.py", "a.py"]


PIECES = st.lists(st.sampled_from(["a", " ", "  ", "\t", "\n", "def f():", "#", "é", "```", "python"]), max_size=14).map("".join)


@settings(max_examples=4, deadline=None)
@given(st.lists(PIECES, min_size=40, max_size=40))
def test_generated_texts(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i",
        "t",
        tx.split_lines(F.col("t")).alias("lines"),
        tx.strip(F.col("t")).alias("bare"),
        tx.dedent_indent(F.col("t"), F.lit(0)).alias("dedented"),
    )
    for row in frame.collect():
        assert row.lines == python_lines(row.t)
        assert row.bare == row.t.strip()
        assert row.dedented == textwrap.dedent(row.t)
