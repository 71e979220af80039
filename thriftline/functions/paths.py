"""Expressions over relative POSIX paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from thriftline import fixed_values as fixed


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def parts(file: Column) -> Column:
    return F.split(file, "/")


def path_sort_key(file: Column) -> Column:
    """Paths order part by part, so ``a/z`` sorts before ``a-b/c``."""
    return parts(file)


def is_excluded(file: Column) -> Column:
    """Any part is on the exclusion list; case matters."""
    return F.arrays_overlap(parts(file), _words(fixed.EXCLUDED_PARTS))


def test_parts(file: Column) -> Column:
    """The path parts that name a test folder, once each."""
    return F.array_intersect(parts(F.lower(file)), _words(fixed.TEST_PARTS))


def is_test_file(file: Column) -> Column:
    lowered = F.lower(file)
    name = F.substring_index(lowered, "/", -1)
    verdict = F.arrays_overlap(parts(lowered), _words(fixed.TEST_PARTS))
    for prefix in fixed.TEST_PREFIXES:
        verdict = verdict | F.startswith(name, F.lit(prefix))
    for suffix in fixed.TEST_SUFFIXES:
        verdict = verdict | F.endswith(name, F.lit(suffix))
    return verdict


def is_python(file: Column) -> Column:
    return F.endswith(file, F.lit(".py"))


def is_hidden(name: Column) -> Column:
    return F.startswith(name, F.lit("."))


def module_name(file: Column) -> Column:
    """Dotted module of a path; only the last suffix goes, hyphens become underscores."""
    return F.translate(F.regexp_replace(file, r"([^/])\.[^./]+$", "$1"), "/-", "._")


def function_id(module: Column, qualified_name: Column) -> Column:
    return F.concat_ws(".", module, qualified_name)


def stem(file: Column) -> Column:
    return F.regexp_replace(F.substring_index(file, "/", -1), r"(.)\.[^.]+$", "$1")


def rebase(project_rel: Column, file: Column) -> Column:
    """Path below the archive root of a path below the project root."""
    return F.when(F.coalesce(project_rel, F.lit("")) == "", file).otherwise(F.concat_ws("/", project_rel, file))


def in_mirror(file: Column) -> Column:
    return ~F.array_contains(parts(file), fixed.UNMIRRORED_PART)
