"""Exploratory report: every aggregate as a lazy table over one review base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kudoscope.functions import categories, dates, text, votes
from kudoscope.operators import aggregates, clean, correlation, joins, ranks
from kudoscope.session import keep, release
from kudoscope.sources import sinks

# Correlated columns and report sizes.
CORRELATED = (
    "helpful", "stars", "cool", "funny", "text_len_words", "text_len_chars",
    "exclaim_count", "question_count", "caps_ratio", "sentiment_compound",
    "user_review_count", "user_fans", "user_average_stars",
)
TOP_CITIES, TOP_CATEGORIES, BINS = 15, 20, 50


def report_base(
    reviews: DataFrame,
    business: DataFrame,
    users: DataFrame | None = None,
    sentiment: DataFrame | None = None,
    salt_by: str | None = "review_id",
) -> DataFrame:
    """Review rows with helpful votes, calendar, text statistics and side columns.

    The text itself is dropped: only its statistics go on.
    """
    df = clean.fill_date_parts(reviews)
    helpful = votes.clean_votes(F.col("useful"), "clip")
    df = df.withColumns(
        {
            "helpful": helpful,
            "helpful_log1p": votes.log_votes(helpful),
            "month": F.col("review_month"),
            "weekday": dates.weekday_name(F.col("review_day_of_week")),
        }
        | text.text_stats(F.col("text"))
    ).drop("text")
    biz = business.select("business_id", "city", "state", "categories")
    df = joins.attach(df, biz, "business_id", "_business", salt_by, reviews)
    df = df.withColumn("city", F.coalesce("city", F.lit("Unknown")))
    if users is not None:
        side = users.select(
            "user_id",
            F.col("review_count").alias("user_review_count"),
            F.col("fans").alias("user_fans"),
            F.col("average_stars").alias("user_average_stars"),
        )
        df = joins.attach(df, side, "user_id", "_user", salt_by, reviews)
    if sentiment is not None:
        df = joins.attach(df, sentiment, "review_id", "_sent")
    return df


def report_tables(base: DataFrame) -> dict[str, DataFrame]:
    """Report tables by name; nothing runs until one is read or written."""
    tables = {
        "helpful_summary": aggregates.describe(base, ["helpful"], discrete=True),
        "helpful_histogram": aggregates.histogram(base, "helpful_log1p", BINS),
        "by_month": aggregates.mean_by_domain(base, "month", "helpful", range(1, 13)),
        "by_weekday": aggregates.mean_by_domain(base, "weekday", "helpful", dates.WEEKDAYS),
        "by_city": aggregates.group_summary(base, "city", "helpful", TOP_CITIES, discrete=True),
        "by_category": aggregates.list_summary(base, "categories", "helpful", TOP_CATEGORIES, discrete=True),
        "by_meta_category": aggregates.flag_means(
            base, categories.meta_flags(F.col("categories")), "helpful"
        ),
        "by_length_decile": aggregates.mean_by_bin(
            ranks.quantile_bin(
                base.select("text_len_words", "helpful"), "text_len_words", 10, "decile", discrete=True
            ),
            "decile",
            "helpful",
        ),
        "distinct_ids": aggregates.distinct_counts(base, ["business_id", "user_id"]),
    }
    if "user_fans" in base.columns:
        tables["by_fans"] = aggregates.fans_summary(base, "user_fans", "helpful")
    return tables


def correlations(base: DataFrame, key: str = "review_id") -> DataFrame:
    """Spearman matrix of the report's numeric columns."""
    return correlation.spearman_matrix(base, [c for c in CORRELATED if c in base.columns], key)


def run_report(base: DataFrame, folder: str) -> dict[str, str]:
    """Write every table; the base is computed once for all of them."""
    kept = keep(base)
    try:
        return {
            name: sinks.write_parquet(table, f"{folder}/{name}.parquet")
            for name, table in {**report_tables(kept), "spearman": correlations(kept)}.items()
        }
    finally:
        release(kept)
