from __future__ import annotations

import ast
import sys

from pyspark.sql import functions as F

from thriftline.operators import catalog, generated

MODULE = '''import os

class A(object):
    """doc"""

    @property
    def x(self):
        return 1

    @x.setter
    def x(self, v):
        self._x = v

    class B:
        async def deep(self, *, k=1):
            def leaf(a, b=2, *c): return a
            return leaf

@deco(1)
def outer(p, q, /, r):
    def inner(z):
        return z
    return inner

if True:
    def hidden(): pass

def outer(): pass
'''


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "project string, file string, text string")


def test_catalogue_in_source_order(spark):
    extracted = catalog.extract_functions(files(spark, ("p", "pkg/my-mod.py", MODULE)))
    found = sorted(catalog.catalogue(extracted).collect(), key=lambda r: (r.line, r.end_line))
    assert [(r.qualified_name, r.line, r.end_line, r.depth, r.n_args) for r in found] == [
        ("A.x", 7, 8, 1, 1), ("A.x", 11, 12, 1, 2), ("A.B.deep", 15, 17, 2, 1), ("A.B.deep.leaf", 16, 16, 3, 2),
        ("outer", 20, 23, 0, 1), ("outer.inner", 21, 22, 1, 1), ("outer", 28, 28, 0, 0),
    ]
    assert found[0].id == "pkg.my_mod.A.x" and found[0].name == "x"
    assert found[0].function_code == "@property\ndef x(self):\n    return 1"
    assert {r.file for r in found} == {"pkg/my-mod.py"}


def test_unparsable_files_become_rows(spark):
    deep = "(" * 3000 + ")" * 3000
    extracted = catalog.extract_functions(
        files(spark, ("p", "a.py", "def f(:\n"), ("p", "b.py", "def g(): pass"), ("p", "__init__.py", ""), ("p", "c.py", deep))
    )
    assert [r.id for r in catalog.catalogue(extracted).collect()] == ["b.g"]
    assert {r.file for r in catalog.unparsable(extracted).collect()} == {"a.py", "c.py"}


def locate(spark, how):
    names = ["outer", "A.x", "A.deep", "B.deep", "deep", "leaf", "hidden", "outer.inner", "inner", "A.B.deep", "A.B.deep.leaf", "nope"]
    requests = spark.createDataFrame([("p", "m.py", n) for n in names], "project string, file string, qualified_name string")
    found = catalog.locate(requests, files(spark, ("p", "m.py", MODULE), ("p", "other.py", MODULE)), how)
    assert found.count() == len(names)
    assert {r.qualified_name for r in catalog.not_located(found).collect()} | {
        r.qualified_name for r in catalog.located(found).collect()
    } == set(names)
    return {r.qualified_name: (r.line, r.end_line) for r in catalog.located(found).collect()}


def test_locate_at_any_depth(spark):
    assert locate(spark, "any") == {
        "outer": (20, 23), "A.x": (7, 8), "A.deep": (15, 17), "B.deep": (15, 17), "deep": (15, 17), "leaf": (16, 16),
        "hidden": (26, 26), "inner": (21, 22),
    }


def test_locate_direct_members(spark):
    assert locate(spark, "direct") == {"outer": (20, 23), "A.x": (7, 8)}


def test_locate_by_catalogue(spark):
    assert locate(spark, "exact") == {
        "outer": (20, 23), "A.x": (7, 8), "outer.inner": (21, 22), "A.B.deep": (15, 17), "A.B.deep.leaf": (16, 16),
    }


def test_locate_tells_equal_names_apart_by_line(spark):
    asked = [("A.x", 11), ("A.x", 7), ("outer", 28), ("outer", 2)]
    requests = spark.createDataFrame([("p", "m.py", n, l) for n, l in asked], "project string, file string, qualified_name string, line int")
    found = catalog.locate(requests, files(spark, ("p", "m.py", MODULE)), "exact")
    assert {(r.qualified_name, r.line): r.end_line for r in found.collect()} == {
        ("A.x", 11): 12, ("A.x", 7): 8, ("outer", 28): 28, ("outer", 2): None,
    }
    assert catalog.not_located(found).count() == 1


def test_checked_responses(spark):
    raws = ["```python\nx = 1\n```", "```\ndef f(:\n```", "  ", "def ok(): pass", "x\x00y", None]
    frame = spark.createDataFrame([(i, r, "timed out" if i == 3 else None) for i, r in enumerate(raws)], "i int, raw string, fail string")
    plain = sorted(generated.check_generated(frame).collect(), key=lambda r: r.i)
    assert [r.status for r in plain] == ["generated", "failed", "failed", "generated", "failed", "failed"]
    assert plain[0].spec_code == "x = 1" and plain[0].error == "" and plain[1].spec_code == ""
    assert plain[2].error == "empty response" and "syntax error" in plain[1].error
    failed = sorted(generated.check_generated(frame, failure="fail").collect(), key=lambda r: r.i)
    assert (failed[3].status, failed[3].error, failed[3].spec_code) == ("failed", "timed out", "")


def test_phase_gate(column):
    rows = [("generated", "c", "t"), ("passed_existing", "c", "t"), ("failed", "c", "t"), (None, "c", "t"), ("generated", "", "t"), ("generated", "c", None)]
    got = column(rows, "s string, c string, t string", generated.passes_phase_gate(F.col("s"), F.col("c"), F.col("t")))
    assert got == [True, True, False, False, False, False]


def test_attach_specs_defaults(spark):
    functions = spark.createDataFrame([("a", 1), ("b", 2)], "id string, line int")
    specs = spark.createDataFrame([("a", "code", "generated", None)], "id string, spec_code string, status string, error string")
    got = {r.id: (r.spec_code, r.status, r.error) for r in generated.attach_specs(functions, specs, ["id"]).collect()}
    assert got == {"a": ("code", "generated", ""), "b": ("", "failed", "")}


def test_long_chains_are_written_without_recursion():
    """A chain takes no stack, and all code is written as ``ast.unparse`` writes it."""
    terms = " + ".join(f"x{n} * (y - {n}) ** -2 ** n" for n in range(3000))
    texts = [
        f"def long(x):\n    return {terms}\n",
        "def f(a):\n    return (a - (b - c)) - d, (a ** b) ** c, a ** (b ** c), -(a + b) * c, (-a) ** b, a << (b | c) & ~d ^ e\n",
        "def g(a):\n    return (lambda: a + b)() @ (a if b else c) % (yield) // (await_ or b), (a + b).c[d - 1](*e + f), not (a + b)\n",
        "async def h(a):\n    return await (a + b) + (await c) * 2, f'{a + (b - c):>{w - 1}} {(lambda x: x + 1)!r}', (a := b + c) - 1\n",
        "def i(a, b=1 - (2 - 3), *c: d | (e | f), **g) -> (h + i):\n    a += (b, c) + (d,)\n    return 1 .real + 2.5j - (a, *b + c)[0]\n",
    ]
    for text in texts:
        function = ast.parse(text).body[0]
        written = catalog._Writer().visit(function)
        assert (written, None) == catalog._unparse(function)
        limit = sys.getrecursionlimit()
        try:
            sys.setrecursionlimit(100_000)
            assert written == ast.unparse(function)
        finally:
            sys.setrecursionlimit(limit)
