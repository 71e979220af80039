"""Bytes of source files to text, with the undecodable ones set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thriftline.functions.text import normalize_newlines


def decode(files: DataFrame, content: str = "content") -> DataFrame:
    """Add ``text`` (line ends as ``\\n``) and ``reject_reason``; ``text`` is NULL when rejected.

    Text that starts with a byte-order mark or holds a NUL cannot be parsed as a
    module and is rejected here, before any Python worker sees it.
    """
    valid = F.try_validate_utf8(F.col(content).cast("string"))
    reason = (
        F.when(valid.isNull(), "not valid UTF-8")
        .when(F.startswith(valid, F.lit("\ufeff")), "byte-order mark")
        .when(F.contains(valid, F.lit("\x00")), "NUL character")
    )
    return files.withColumn("reject_reason", reason).withColumn(
        "text", F.when(F.col("reject_reason").isNull(), normalize_newlines(valid))
    )


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(decoded: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and reason of the files that were set aside."""
    return decoded.filter(F.col("reject_reason").isNotNull()).select(*keys, F.col("reject_reason").alias("reason"))
