"""Splicing against a plain list model."""

from __future__ import annotations

import random

import pytest

from thriftline.operators import overlaps, patching, routing
from thriftline.operators.numbering import numbered
from pyspark.sql import functions as F

FILES = "project string, file string, text string"
PATCHES = "project string, file string, start_line int, end_line int, code string, seq int"


def model(text, patches):
    """Replace from the bottom up in a list of lines."""
    lines = text.split("\n")
    lines = [l + "\n" for l in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    for first, last, code in sorted(patches, reverse=True):
        old = lines[first - 1]
        indent = old[: len(old) - len(old.lstrip())]
        new = code.split("\n")
        base = new[0][: len(new[0]) - len(new[0].lstrip())]
        shifted = [indent + l[len(base):] if l.strip() else "" for l in new]
        if shifted and shifted[-1] == "":
            shifted = shifted[:-1]
        lines[first - 1 : last] = [l + "\n" for l in shifted]
    return "".join(lines)


def run(spark, files, patches):
    got = patching.mirror(spark.createDataFrame(files, FILES), spark.createDataFrame(patches, PATCHES)).collect()
    return {r.file: r.text for r in got}


def test_pinned_cases(spark):
    files = [
        ("p", "last", "a\nb\nc"), ("p", "adjacent", "a\n  b\n  c\nd\n"), ("p", "nested", "a\nb\nc\nd\ne\n"),
        ("p", "plain", "x\r\ny"), ("p", ".git/config", "secret"), ("p", "a/.git/x", "secret"), ("p", ".gitignore", "keep"),
        ("p", "twice", "a\nb\n"), ("p", "ff", "a\x0cb\nc\n"),
    ]
    patches = [
        ("p", "last", 3, 3, "new\nlines", 1),
        ("p", "adjacent", 2, 2, "    B\n      B2", 1), ("p", "adjacent", 3, 3, "C\n", 1),
        ("p", "nested", 2, 4, "outer", 1), ("p", "nested", 3, 3, "inner\ninner", 2),
        ("p", "twice", 2, 2, "first", 1), ("p", "twice", 2, 2, "second", 2), ("p", "ff", 2, 2, "n", 1),
        ("p", "missing", 1, 1, "z", 1),
    ]
    assert run(spark, files, patches) == {
        "last": "a\nb\nnew\nlines\n", "adjacent": "a\n  B\n    B2\n  C\nd\n", "nested": "a\nouter\ne\n", "plain": "x\r\ny",
        ".gitignore": "keep", "twice": "a\nsecond\n", "ff": "a\x0cb\nn\n",
    }


def test_random_patches_agree_with_the_model(spark):
    rng = random.Random(3)
    files, patches, want = [], [], {}
    for n in range(150):
        size = rng.randint(1, 12)
        text = "\n".join(rng.choice(["", "  ", "\t"]) + "l" * rng.randint(1, 4) for _ in range(size)) + rng.choice(["", "\n"])
        own, at = [], 1
        while at <= size:
            if rng.random() < 0.5:
                last = min(size, at + rng.randint(0, 2))
                code = "\n".join(rng.choice(["", "  "]) * (i > 0) + f"n{i}" for i in range(rng.randint(1, 4))) + rng.choice(["", "\n"])
                own.append((at, last, code))
                at = last + 1
            else:
                at += 1
        files.append(("p", f"f{n}", text))
        patches += [("p", f"f{n}", *p, 1) for p in own]
        want[f"f{n}"] = model(text, own)
    assert run(spark, files, patches) == want
    only = patching.patched_files(spark.createDataFrame(files, FILES), spark.createDataFrame(patches, PATCHES))
    touched = {p[1] for p in patches}
    assert {r.file: r.text for r in only.collect()} == {f: t for f, t in want.items() if f in touched}


def test_shift_by_common_margin(spark):
    files = [("p", "f", "class A:\n\tdef f(self):\n\t\tpass\n")]
    patch = [("p", "f", 2, 3, "      # note\n    def f(self):\n        return 1\n\n", 1)]
    for shift, want in (
        (patching.by_common_margin, "class A:\n   # note\n def f(self):\n     return 1\n\n"),
        (patching.by_first_line, "class A:\n\t# note\n\tdef f(self):\n\t  return 1\n\n"),
    ):
        got = patching.patched_files(spark.createDataFrame(files, FILES), spark.createDataFrame(patch, PATCHES), shift=shift)
        assert [r.text for r in got.collect()] == [want]


def test_many_copies_of_one_patch_stay_one(spark):
    copies = spark.range(20_000).select(
        F.lit("p").alias("project"), F.lit("f").alias("file"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
        F.concat(F.lit("c"), F.col("id")).alias("code"), F.col("id").cast("int").alias("seq"),
    )
    found = patching.patched_files(spark.createDataFrame([("p", "f", "a\nb\n")], FILES), copies).collect()
    assert [r.text for r in found] == ["c19999\nb\n"]


def test_positions_in_a_hot_group(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 500)).alias("g"),
        F.hash("id").alias("h"), "id",
    )
    placed = numbered(rows, ["g"], [F.col("h").desc(), F.col("id")], size="n").toPandas()
    want = placed.sort_values(["g", "h", "id"], ascending=[True, False, True]).groupby("g").cumcount() + 1
    assert (placed["position"].sort_index() == want.sort_index()).all()
    assert (placed.groupby("g")["position"].max() == placed.groupby("g")["n"].first()).all()
    assert len(placed) == 30_000


def test_a_hot_group_is_cut_into_many_ranges(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(-1).alias("g"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = numbered(rows, ["g"], [F.col("id")], span="span")
        sizes = [r["count"] for r in placed.filter("g = -1").groupBy("span").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 1 and sum(sizes) == 13_334 and max(sizes) < 40_000 / 8 * 2


def test_a_patch_that_overlaps_only_dropped_ones_is_kept(spark):
    spans = [("a", 1, 5), ("a", 4, 10), ("a", 8, 12), ("b", 1, 2), ("b", 1, 9), ("b", 9, 9), ("b", 10, 10)]
    rows = spark.createDataFrame([(f, a, b, f"{a}", 1) for f, a, b in spans], "file string, start_line int, end_line int, code string, seq int")
    flags = {(r.file, r.start_line, r.end_line): r.inner for r in patching.with_overlap_flag(rows, ["file"]).collect()}
    assert {k for k, inner in flags.items() if not inner} == {("a", 1, 5), ("a", 8, 12), ("b", 1, 9), ("b", 10, 10)}
    assert {k for k, inner in flags.items() if inner} == {("a", 4, 10), ("b", 1, 2), ("b", 9, 9)}
    gone = patching.overlapped(rows, ["file"]).collect()
    assert {(r.file, r.start_line) for r in gone} == {("a", 4), ("b", 1), ("b", 9)} and all(r.reason for r in gone)


def test_positions_keep_a_null_group(spark):
    rows = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "g string, v int")
    got = {(r.g, r.v): r.position for r in numbered(rows, ["g"], [F.col("v")]).collect()}
    assert got == {(None, 1): 1, (None, 2): 2, ("a", 3): 1}


def test_routing_order_and_records(spark):
    functions = spark.createDataFrame(
        [
            ("p", "a", "f", "f.py", "generated", "t"), ("p", "b", "f", "gone.py", "generated", "t"), ("p", "c", None, "gone.py", "failed", "t"),
            ("p", "d", "f", "f.py", "generated", ""), ("p", "e", "f", "f.py", None, None),
        ],
        "project string, id string, name string, file string, status string, spec_code string",
    ).withColumn("function_code", F.lit("code"))
    files = spark.createDataFrame([("p", "f.py"), ("p", "f.py"), ("q", "gone.py")], "project string, file string")
    routed = routing.route(functions, files, ["project", "file"])
    assert {r.id: r.skip_reason for r in routed.collect()} == {
        "a": None, "b": "source_file_not_found", "c": "no_spec", "d": "no_spec", "e": "no_spec",
    }
    records = {r.id: r for r in routing.skipped_records(routed, ["project"]).collect()}
    assert set(records) == {"b", "c", "d", "e"} and records["c"].name == "" and records["e"].spec_code == ""
    assert records["b"].optimized_function_code == "code" and records["b"].baseline_emissions_kg is None
    assert (records["b"].reduction_pct, records["b"].success, records["b"].optimization_attempts) == (0.0, False, 0)


def standing(ranges):
    """The rule, one range after the other."""
    reach, flags = None, {}
    for start, end in sorted(ranges, key=lambda r: (r[0], -r[1])):
        inner = reach is not None and start <= reach
        flags[start, end] = inner
        reach = reach if inner else end
    return flags


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_many_ranges_are_followed_through_blocks(spark, blocks):
    rng = random.Random(blocks)
    files = {
        ("p", "hot"): {(a, a + rng.choice([0, 1, 5, 40, 400])) for a in (rng.randint(1, 3000) for _ in range(1500))},
        ("p", "nested"): {(n, 2000 - n) for n in range(1, 900)}, ("p", "chain"): {(3 * n, 3 * n + rng.randint(0, 4)) for n in range(700)},
        (None, "none"): {(1, 4), (3, 9), (9, 9)}, (None, None): {(1, 2), (2, 3)}, **{("q", f"f{n}"): {(1, n), (n, n + 1)} for n in range(1, 30)},
    }
    rows = [(*key, a, b, f"code {a}") for key, ranges in files.items() for a, b in ranges] + [("p", "hot", None, 3, "odd")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "project string, file string, start_line int, end_line int, code string")
    found = overlaps.overlap_flags(df, ["project", "file"], blocks).collect()
    got = {}
    for r in found:
        got.setdefault((r.project, r.file), {})[r.start_line, r.end_line] = r.inner
        assert r.start_line is None or r.code == f"code {r.start_line}"
    assert got["p", "hot"].pop((None, 3)) is False
    assert len(found) == len(rows) and got == {key: standing(ranges) for key, ranges in files.items()}


def test_covered_lines_are_those_in_a_range(spark):
    rng = random.Random(2)
    ranges = {f: [(a, a + rng.choice([-3, 0, 1, 62, 63, 64, 65, 500])) for a in (rng.randint(0, 3000) for _ in range(60))] for f in ("a", "b")}
    patches = spark.createDataFrame([(f, a, b) for f, found in ranges.items() for a, b in found] + [("a", None, 5)], "file string, start_line int, end_line int")
    lines = spark.createDataFrame([(f, n) for f in ("a", "b", "c") for n in range(0, 3700)] + [("a", None), (None, 3)], "file string, line_no int")
    got = {(r.file, r.line_no) for r in patching.uncovered_lines(lines, patches, ["file"]).collect()}
    free = {(f, n) for f in ("a", "b", "c") for n in range(0, 3700) if not any(a <= n <= b for a, b in ranges.get(f, []))}
    assert got == free | {("a", None), (None, 3)}


def test_patches_of_a_row_stand_by_the_same_rule(spark):
    rng = random.Random(9)
    files = {f"f{n}": {(a, a + rng.choice([0, 1, 3, 30])) for a in (rng.randint(1, 60) for _ in range(n))} for n in range(1, 40)}
    rows = [("p", f, a, b, f"{a}-{b}", 1) for f, ranges in files.items() for a, b in ranges]
    got = {r.file: [tuple(p) for p in r.patches] for r in patching.patches_per_file(spark.createDataFrame(rows, PATCHES)).collect()}
    assert got == {f: sorted((a, b, f"{a}-{b}") for (a, b), inner in standing(ranges).items() if not inner) for f, ranges in files.items()}
