"""Projections, filters and cleaners of the raw tables (all map-only)."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kudoscope.functions import categories, coerce, dates
from kudoscope.schemas import BUSINESS_RAW, REVIEWS_RAW, USERS_RAW

MIN_TEXT_LENGTH = 10  # fixed value: code points


def keep_known(df: DataFrame, expected: Iterable[str]) -> DataFrame:
    """Keep the expected columns that exist, in the expected order."""
    return df.select(*[c for c in expected if c in df.columns])


def require_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna(subset=[k for k in keys if k in df.columns])


def min_text_length(df: DataFrame, column: str = "text", n: int = MIN_TEXT_LENGTH) -> DataFrame:
    return df.where(F.length(column) >= n)


def clean_reviews(df: DataFrame, min_length: int = MIN_TEXT_LENGTH) -> DataFrame:
    """Keyed reviews with a readable date and a text of some length."""
    df = keep_known(df, REVIEWS_RAW.names)
    df = require_keys(df, ["review_id", "user_id", "business_id"])
    if "text" in df.columns:
        df = min_text_length(df.withColumn("text", F.col("text").cast("string")), "text", min_length)
    changes = dict.fromkeys(("useful", "funny", "cool"), coerce.to_count_or_zero)
    changes["stars"] = coerce.to_number
    df = df.withColumns({c: f(F.col(c)) for c, f in changes.items() if c in df.columns})
    if "date" in df.columns:
        df = df.withColumn("date", coerce.to_timestamp(F.col("date"))).where("date is not null")
        df = df.withColumns(dates.date_parts(F.col("date")))
    return df


def elite_columns(df: DataFrame, column: str = "elite") -> DataFrame:
    """``elite_raw`` (null spelled "None") and ``is_elite_ever``.

    An empty string counts as elite; a table without the column has no elite.
    """
    if column not in df.columns:
        return df.withColumns(
            {"elite_raw": F.lit(None).cast("string"), "is_elite_ever": F.lit(False)}
        )
    raw = F.coalesce(F.col(column).cast("string"), F.lit("None"))
    return df.withColumns({"elite_raw": raw, "is_elite_ever": F.lower(raw) != "none"})


def clean_users(df: DataFrame) -> DataFrame:
    df = require_keys(keep_known(df, USERS_RAW.names), ["user_id"])
    changes = {"yelping_since": coerce.to_timestamp, "average_stars": coerce.to_number}
    changes.update(
        dict.fromkeys(("review_count", "useful", "funny", "cool", "fans"), coerce.to_count)
    )
    df = df.withColumns({c: f(F.col(c)) for c, f in changes.items() if c in df.columns})
    return elite_columns(df)


def clean_business(df: DataFrame) -> DataFrame:
    df = require_keys(keep_known(df, BUSINESS_RAW.names), ["business_id"])
    changes = dict.fromkeys(("stars", "latitude", "longitude"), coerce.to_number)
    changes["review_count"] = coerce.to_count
    changes["is_open"] = coerce.to_count_or_zero
    changes["categories"] = lambda c: categories.split_list(c.cast("string"))
    return df.withColumns({c: f(F.col(c)) for c, f in changes.items() if c in df.columns})


CLEANERS = {"reviews": clean_reviews, "users": clean_users, "business": clean_business}


def fill_nulls(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """``fillna`` for the columns that exist (city -> "Unknown", text -> "" ...)."""
    return df.fillna({c: v for c, v in values.items() if c in df.columns})


def fill_date_parts(df: DataFrame, date: str = "date") -> DataFrame:
    """Take missing date parts from the date; add those that do not exist."""
    if date not in df.columns:
        return df
    parts = dates.date_parts(F.col(date))
    return df.withColumns(
        {c: F.coalesce(F.col(c), e) if c in df.columns else e for c, e in parts.items()}
    )


def valid_target(df: DataFrame, target: str, check: bool = False) -> DataFrame:
    """Rows whose target is finite and not negative.

    ``check`` raises when nothing remains (one early-stopping job).
    """
    y = F.col(target).cast("double")
    kept = df.where(y.isNotNull() & ~F.isnan(y) & (y >= 0) & (y < F.lit(float("inf"))))
    if check and kept.isEmpty():
        raise ValueError("no valid target value: all are missing, infinite or negative")
    return kept


def popular(df: DataFrame, at_least: int | None, votes: str = "total_votes") -> DataFrame:
    """Rows with enough votes; everything when no row or column would remain.

    Must run before the vote columns are dropped as leakage.
    """
    return popular_sides(df, at_least=at_least, votes=votes)[0]


def popular_sides(
    *sides: DataFrame, at_least: int | None, votes: str = "total_votes"
) -> tuple[DataFrame, ...]:
    """Rows with enough votes on every side, or, with a warning, all sides as
    they are if one of them would lose all its rows."""
    if not at_least or at_least <= 0:
        return sides
    if any(votes not in df.columns for df in sides):
        warnings.warn(f"no column {votes}: rows are not filtered by votes", stacklevel=2)
        return sides
    kept = tuple(df.where(F.coalesce(F.col(votes), F.lit(0)) >= at_least) for df in sides)
    if any(df.isEmpty() for df in kept):
        warnings.warn(f"no row has {at_least} votes: rows are not filtered by votes", stacklevel=2)
        return sides
    return kept


def cap_rows(df: DataFrame, n: int | None) -> DataFrame:
    """Row cap of a smoke run; no cap when ``n`` is empty."""
    return df.limit(n) if n else df
