"""Tolerant casts: a bad value becomes null (or zero), never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(c: Column) -> Column:
    """Double, or null when the value is not a number."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def to_count(c: Column) -> Column:
    """Whole number, or null; decimals are cut towards zero."""
    return F.coalesce(c.try_cast("bigint"), c.try_cast("double").try_cast("bigint"))


def to_count_or_zero(c: Column) -> Column:
    return F.coalesce(to_count(c), F.lit(0).cast("bigint"))


def to_timestamp(c: Column) -> Column:
    """Timestamp, or null when the value cannot be read as one."""
    return c.try_cast("timestamp")
