"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from kudoscope.catalog.base import business, documents, review_base, reviews, sql, table
from kudoscope.catalog.registry import big, query, r6, tidy
from kudoscope.functions import categories, dates, text, votes

WORDS = r"regexp_extract_all(t, '\S+')"
STOPS = ("the", "and", "of", "to", "in", "is", "it", "that", "for", "on", "with", "as", "was", "at", "by")
STOP_SQL = ", ".join(f"'{w}'" for w in STOPS)
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]{2,}')"

TEXT_STATS_SQL = f"""{big('length(t)')} AS text_len_chars, {big(f'len({WORDS})')} AS text_len_words,
  {r6(f"CASE WHEN len({WORDS}) > 0 THEN length(array_to_string({WORDS}, '')) / len({WORDS}) ELSE 0 END")} AS avg_word_length,
  {r6(r"CASE WHEN length(t) > 0 THEN length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) / length(t) ELSE 0 END")} AS caps_ratio,
  {big("length(t) - length(replace(t, '!', ''))")} AS exclaim_count, {big("length(t) - length(replace(t, '?', ''))")} AS question_count"""


@query("H1_H2_H3_H4_H5_I1_text_stats", f"SELECT doc_id, {TEXT_STATS_SQL} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def text_stats(spark, sf):
    d = documents(spark, sf)
    return tidy(d.select("doc_id", *[e.alias(c) for c, e in text.text_stats(F.col("text")).items()]))


@query("H1_H5_conversation_text_stats", f"SELECT conv_id, turn, {TEXT_STATS_SQL} FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)")
def conversation_stats(spark, sf):
    d = table(spark, sf, "conversations")
    return tidy(d.select("conv_id", "turn", *[e.alias(c) for c, e in text.text_stats(F.col("text")).items()]))


@query("H3_mean_token_length", r"""SELECT doc_id, (round(CAST(CASE WHEN len(w) > 0 THEN length(array_to_string(w, '')) / len(w) ELSE 0 END AS DOUBLE), 6) + 0.0) AS avg_token_length
FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+') AS w FROM documents)""")
def mean_token_length(spark, sf):
    d = documents(spark, sf)
    return tidy(d.select("doc_id", text.mean_token_length(F.col("text")).alias("avg_token_length")))


@query("H6_slugs", r"""SELECT DISTINCT name, coalesce(nullif(regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{N}]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unk') AS slug
FROM (SELECT p_brand || ' & (' || p_name || ')' AS name FROM part UNION ALL SELECT '***' FROM part)""")
def slugs(spark, sf):
    p = table(spark, sf, "part")
    names = p.select(F.concat("p_brand", F.lit(" & ("), "p_name", F.lit(")")).alias("name")).unionByName(
        p.select(F.lit("***").alias("name"))
    )
    return names.distinct().select("name", text.slug(F.col("name")).alias("slug"))


@query("H7_primary_category_means", sql(f"""SELECT c AS primary_category, {r6('avg(useful)')} AS mean, {r6('median(useful)')} AS median, {big('count(*)')} AS n FROM p
WHERE c IN (SELECT c FROM p WHERE c IS NOT NULL GROUP BY c ORDER BY count(*) DESC, c LIMIT 10) GROUP BY c""",
    "p AS (SELECT useful, trim(string_split(categories, ',')[1]) AS c FROM review)"))
def primary_means(spark, sf):
    from kudoscope.operators.aggregates import group_summary

    df = review_base(spark, sf, ["city"]).select("useful", categories.primary(F.col("categories")).alias("primary_category"))
    return tidy(group_summary(df, "primary_category", "useful", 10, discrete=True))


@query("H8_lexical_features", f"""SELECT doc_id, {r6('CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0 END')} AS lexical_richness,
  {r6(f'CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: x IN ({STOP_SQL}))) / len(w) ELSE 0 END')} AS stopword_ratio
FROM (SELECT doc_id, {TOKENS} AS w FROM documents)""")
def lexical(spark, sf):
    d = documents(spark, sf).select("doc_id", text.tokens(F.col("text")).alias("w"))
    return tidy(d.select("doc_id", text.lexical_richness(F.col("w")).alias("lexical_richness"),
                         text.stop_word_ratio(F.col("w"), STOPS).alias("stopword_ratio")))


@query("H9_H10_H11_H12_calendar", sql(f"""SELECT {big('review_id')} AS review_id, {big('year(date)')} AS review_year, {big('month(date)')} AS review_month,
  {big('isodow(date) - 1')} AS review_day_of_week, {big('isodow(date) >= 6')} AS review_is_weekend, {big('week(date)')} AS review_weekofyear,
  dayname(date) AS weekday FROM review"""))
def calendar(spark, sf):
    d = F.col("date")
    df = reviews(spark, sf).withColumns(dates.date_parts(d))
    return tidy(df.select("review_id", "review_year", "review_month", "review_day_of_week",
                          dates.is_weekend(d).alias("review_is_weekend"), dates.iso_week(d).alias("review_weekofyear"),
                          dates.weekday_name(F.col("review_day_of_week")).alias("weekday")))


@query("H14_logs", f"""SELECT event_id, {r6('ln(1 + value)')} AS log_value, {r6('greatest(exp(ln(1 + value) - 1) - 1, 0)')} AS back FROM events WHERE value >= 0""")
def logs(spark, sf):
    e = table(spark, sf, "events").where("value >= 0")
    return tidy(e.select("event_id", votes.log_votes(F.col("value")).alias("log_value"),
                         votes.from_log(votes.log_votes(F.col("value")) - 1).alias("back")))


@query("H15_H16_H18_votes_and_targets", sql(f"""SELECT {big('review_id')} AS review_id, {r6('t')} AS total_votes,
  {r6('useful / (t + 1)')} AS ratio_useful, {r6('funny / (t + 1)')} AS ratio_funny, {r6('cool / (t + 1)')} AS ratio_cool,
  {r6('(useful + 1.0) / (t + 6)')} AS useful_rate_smoothed, {big('useful')} AS target_useful_votes, {big('useful > 0')} AS target_is_useful,
  {r6('ln(1 + useful)')} AS target_log1p FROM (SELECT *, CAST(useful + funny + cool AS DOUBLE) AS t FROM review)"""))
def vote_columns(spark, sf):
    total = votes.total_votes(*map(F.col, ("useful", "funny", "cool")))
    df = reviews(spark, sf).withColumn("total_votes", total)
    t = F.col("total_votes")
    return tidy(df.select(
        "review_id", "total_votes",
        *[votes.vote_ratio(F.col(c), t).alias(f"ratio_{c}") for c in ("useful", "funny", "cool")],
        votes.smoothed_rate(F.col("useful"), t).alias("useful_rate_smoothed"),
        *[e.alias(c) for c, e in votes.targets(F.col("useful")).items()],
        votes.log_votes(F.col("useful")).alias("target_log1p"),
    ))


@query("H17_exposure_rates", sql(f"""SELECT {big('review_id')} AS review_id, {r6('useful / (business_review_count + 1) * 100')} AS useful_per_100_reviews,
  {r6('coalesce(business_review_count, 0) / (coalesce(len(' + WORDS.replace('(t,', '(text,') + '), 0) + 1)')} AS business_review_density FROM review"""))
def exposure(spark, sf):
    df = review_base(spark, sf, ["business", "text"])
    words = text.word_count(text.filled(F.col("text")))
    n = F.col("business_review_count")
    return tidy(df.select("review_id", votes.per_hundred(F.col("useful"), n).alias("useful_per_100_reviews"),
                          votes.density(n, words).alias("business_review_density")))


@query("H19_category_count_and_flag", sql(f"""SELECT {big('business_id')} AS business_id, {big("CASE WHEN categories IS NULL THEN 0 ELSE len(string_split(categories, ',')) END")} AS category_count,
  {big("list_contains(list_transform(string_split(categories, ','), lambda x: trim(x)), 'ring')")} AS cat_ring FROM business"""))
def category_flags(spark, sf):
    b = business(spark, sf, counts=False).select("business_id", categories.split_list(F.col("categories")).alias("parts"))
    return tidy(b.select("business_id", categories.count(F.col("parts")).alias("category_count"),
                         categories.has(F.col("parts"), "ring").alias("cat_ring")))
