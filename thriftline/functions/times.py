"""Texts of timestamps and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_text(at: Column, utc: bool = False) -> Column:
    """ISO 8601 text; the fraction shows only where there is one."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(at, "SSSSSS")
    text = F.concat(whole, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)))
    return F.concat(text, F.lit("+00:00")) if utc else text


def long_date(at: Column) -> Column:
    """``January 02, 2024``"""
    return F.date_format(at, "MMMM dd, yyyy")
