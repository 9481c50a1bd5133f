"""Explicit schemas of the raw record files (no inference pass over the data)."""

from __future__ import annotations

from pyspark.sql.types import MapType, StringType, StructField, StructType


def _text_columns(names: str, maps: str = "") -> StructType:
    fields = [StructField(n, StringType()) for n in names.split()]
    fields += [StructField(n, MapType(StringType(), StringType())) for n in maps.split()]
    return StructType(fields)


# Column names of the public review dataset.  Numbers and dates
# are read as strings so that bad values are coerced by the cleaners instead
# of spoiling the whole record.
REVIEWS_RAW = _text_columns("review_id user_id business_id stars date text useful funny cool")
USERS_RAW = _text_columns(
    "user_id name review_count yelping_since useful funny cool fans elite average_stars"
)
BUSINESS_RAW = _text_columns(
    "business_id name city state stars review_count categories is_open latitude longitude",
    maps="attributes hours",
)
TIPS_RAW = _text_columns("user_id business_id text date compliment_count")

RAW_SCHEMAS = {
    "reviews": REVIEWS_RAW,
    "users": USERS_RAW,
    "business": BUSINESS_RAW,
    "tips": TIPS_RAW,
}
