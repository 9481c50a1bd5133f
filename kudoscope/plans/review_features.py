"""Full review feature table: text, sentiment, business and user columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kudoscope.functions import categories, dates, text, votes
from kudoscope.operators import clean, joins, sentiment
from kudoscope.plans.master import side_columns

# Columns taken from the side tables and their new names.
BUSINESS_COLUMNS = {
    "business_id": "business_id",
    "name": "business_name",
    "city": "city",
    "state": "state",
    "stars": "business_stars",
    "review_count": "business_review_count",
    "categories": "business_categories",
    "is_open": "business_is_open",
}
USER_COLUMNS = {
    "user_id": "user_id",
    "review_count": "user_review_count",
    "fans": "user_fans",
    "elite_raw": "user_elite_raw",
    "is_elite_ever": "user_is_elite_ever",
    "average_stars": "user_average_stars",
    "useful": "user_useful_votes",
    "funny": "user_funny_votes",
    "cool": "user_cool_votes",
}
TOP_CATEGORY_FLAGS = 15


def review_columns(reviews: DataFrame) -> DataFrame:
    """Row-wise part: date parts, weekend, targets, age and text statistics.

    The newest date is a one-value subquery; everything else is one projection.
    """
    df = clean.fill_date_parts(reviews)
    helpful = votes.clean_votes(F.col("useful"), "clip")
    new = {
        "review_is_weekend": F.coalesce(F.col("review_day_of_week") >= 5, F.lit(False)),
        "target_helpful_votes": helpful,
        "target_helpful_log1p": votes.log_votes(helpful),
    }
    if "date" in df.columns:
        newest = reviews.agg(F.max("date")).scalar()
        new["review_age_days"] = dates.age_days(newest, F.col("date"))
    return df.withColumns(new | text.text_stats(F.col("text")))


def attach_business(
    df: DataFrame, business: DataFrame, salt_by: str | None = None, hot_from: DataFrame | None = None
) -> DataFrame:
    df = joins.attach(df, side_columns(business, BUSINESS_COLUMNS), "business_id", "_business", salt_by, hot_from)
    reviews_of = F.coalesce("business_review_count", F.lit(0))
    return df.withColumns(
        {
            "business_review_count": reviews_of,
            "business_review_density": votes.density(reviews_of, F.col("text_len_words")),
            "business_category_count": categories.count(F.col("business_categories")),
        }
    )


def review_features(
    reviews: DataFrame,
    business: DataFrame,
    users: DataFrame | None = None,
    backend: str | None = "lexicon",
    key: str = "review_id",
    salt_by: str | None = "review_id",
    **sentiment_options,
) -> DataFrame:
    """Everything above in one plan; ``backend=None`` leaves sentiment out."""
    df = review_columns(reviews)
    if backend is not None:
        scores = sentiment.score_sentiment(reviews.select(key, "text"), key, "text", backend, **sentiment_options)
        df = joins.attach(df, scores, key, "_sent")
    df = attach_business(df, business, salt_by, reviews)
    df = _flag_top(df, reviews, business)
    if users is not None:
        df = joins.attach(df, side_columns(users, USER_COLUMNS), "user_id", "_user", salt_by, reviews)
    return df


def _flag_top(df: DataFrame, reviews: DataFrame, business: DataFrame) -> DataFrame:
    """Find the top categories from reviews per business, not from all rows.

    Reviews are first counted per business, so the category lists are expanded
    once per business instead of once per review.
    """
    per_business = reviews.where("business_id is not null").groupBy("business_id").agg(
        F.count("*").alias("n")
    )
    entries = business.join(per_business, "business_id").select(
        F.explode("categories").alias("token"), "n"
    )
    entries = entries.withColumn("token", text.strip(F.col("token"))).where("token <> ''")
    top = (
        entries.groupBy("token")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), F.asc("token"))
        .limit(TOP_CATEGORY_FLAGS)
    )
    tokens = [r["token"] for r in top.collect()]
    names = text.unique_names(f"cat_{text.slug_name(t)}" for t in tokens)
    flags = {
        n: categories.has(F.col("business_categories"), t) for n, t in zip(names, tokens)
    }
    return df.withColumns(flags) if flags else df
