"""Calendar parts; weeks start on Monday (0) and are ISO weeks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MICROS_PER_DAY = 86_400_000_000


def weekday(c: Column) -> Column:
    return F.weekday(c)


def is_weekend(c: Column) -> Column:
    return F.weekday(c) >= 5


def iso_week(c: Column) -> Column:
    return F.weekofyear(c)


def date_parts(c: Column) -> dict[str, Column]:
    return {
        "review_year": F.year(c),
        "review_month": F.month(c),
        "review_day_of_week": F.weekday(c),
    }


def weekday_name(index: Column) -> Column:
    """Name of day 0..6; any other index gives null."""
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    return F.when(index.between(0, 6), F.get(names, index.cast("int")))


def age_days(newest: Column, c: Column) -> Column:
    """Whole periods of 24 hours between ``c`` and ``newest``."""
    gap = F.unix_micros(newest.cast("timestamp")) - F.unix_micros(c.cast("timestamp"))
    return F.floor(gap / F.lit(MICROS_PER_DAY)).cast("int")
