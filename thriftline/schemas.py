"""Explicit schemas of the tables that stages hand to each other."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
}


def _struct(spec: str) -> T.StructType:
    """Flat schema from ``name type`` pairs, without needing a session."""
    pairs = (field.split() for field in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


ARCHIVE_MEMBER = _struct("archive string, file string, n_bytes bigint, content binary, error string")

TREE_FILE = _struct("project string, file string, n_bytes bigint, uri string")

SOURCE_FILE = _struct("project string, file string, n_bytes bigint, content binary")

FUNCTION = _struct(
    "project string, id string, name string, qualified_name string, file string, "
    "line int, end_line int, depth int, n_args int, function_code string, error string"
)

LOCATOR = _struct(
    "project string, file string, lookup_name string, direct boolean, line int, end_line int, error string"
)

SPEC_RESULT = _struct(
    "id string, name string, qualified_name string, file string, line int, end_line int, "
    "function_code string, spec_code string, status string, error string"
)

SPEC_DOCUMENT = T.StructType(
    [
        T.StructField("project_root", T.StringType()),
        T.StructField("generated_at", T.StringType()),
        T.StructField("functions", T.ArrayType(SPEC_RESULT)),
    ]
)

RESULT = _struct(
    "id string, name string, qualified_name string, file string, function_code string, "
    "spec_code string, optimized_function_code string, optimized_test_code string, "
    "baseline_emissions_kg double, optimized_emissions_kg double, reduction_pct double, "
    "success boolean, optimization_attempts int, skip_reason string"
)

RESULT_DOCUMENT = T.StructType(
    [
        T.StructField("project_root", T.StringType()),
        T.StructField("generated_at", T.StringType()),
        T.StructField("functions", T.ArrayType(RESULT)),
    ]
)
