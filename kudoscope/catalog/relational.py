"""Queries of joins, aggregations, windows, sampling and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from kudoscope.catalog.base import business, documents, review_base, reviews, sql, table, users, with_text
from kudoscope.catalog.registry import big, query, r6, tidy
from kudoscope.functions import categories, dates, text, votes
from kudoscope.operators import aggregates, correlation, joins, ranks, reshape, sampling, sketches
from kudoscope.session import keep, work_folder
from kudoscope.sources import readers

# ---- joins ----------------------------------------------------------------


@query("C1_reviews_with_business", sql(f"""SELECT {big('review_id')} AS review_id, {big('business_id')} AS business_id,
  city, state, categories, {big('is_open')} AS is_open FROM review"""))
def attach_business(spark, sf):
    side = business(spark, sf, counts=False).select("business_id", "city", "state", "categories", "is_open")
    df = joins.attach(reviews(spark, sf), side, "business_id")
    return tidy(df.select("review_id", "business_id", "city", "state", "categories", "is_open"))


@query("C1_salted_business_join", sql(f"""SELECT {big('review_id')} AS review_id, city,
  {big('business_review_count')} AS review_count FROM review"""))
def attach_salted(spark, sf):
    side = business(spark, sf).select("business_id", "city", "review_count")
    df = joins.attach(reviews(spark, sf), side, "business_id", salt_by="review_id")
    return tidy(df.select("review_id", "city", "review_count"))


@query("C2_reviews_with_users", sql(f"""SELECT {big('v.review_id')} AS review_id, {big('v.useful')} AS useful,
  {big('u.fans')} AS fans, {big('w.useful')} AS useful_user, {r6('u.average_stars')} AS average_stars
FROM votes v LEFT JOIN users u ON u.user_id = v.user_id
LEFT JOIN (SELECT user_id, sum(useful) AS useful FROM votes GROUP BY user_id) w ON w.user_id = v.user_id"""))
def attach_users(spark, sf):
    base = reviews(spark, sf)
    given = base.groupBy("user_id").agg(F.sum("useful").alias("useful"))
    side = users(spark, sf).select("user_id", "fans", "average_stars").join(given, "user_id", "left")
    df = joins.attach(base, side, "user_id", "_user")
    return tidy(df.select("review_id", "useful", "fans", "useful_user", "average_stars"))


@query("C3_one_to_one_join", f"""SELECT d.doc_id, {big('d.n_chars')} AS n_chars, {big('l.quality')} AS quality, l.lang_sent
FROM documents d LEFT JOIN (SELECT doc_id, quality, CAST(toxic AS VARCHAR) AS lang_sent FROM labels) l ON l.doc_id = d.doc_id""")
def one_to_one(spark, sf):
    side = table(spark, sf, "labels").select("doc_id", "quality", F.col("toxic").cast("string").alias("lang"))
    docs = documents(spark, sf).select("doc_id", "n_chars", "lang")
    df = joins.attach_one_to_one(docs, side, "doc_id", "_sent")
    return tidy(df.select("doc_id", "n_chars", "quality", "lang_sent"))


@query("C3_repeated_keys", sql(f"""SELECT k AS key, {big('l')} AS left_rows, {big('r')} AS right_rows FROM (
  SELECT k, sum(l) AS l, sum(r) AS r FROM (
    SELECT user_id AS k, 1 AS l, 0 AS r FROM votes UNION ALL SELECT user_id, 0, 1 FROM users) GROUP BY k)
WHERE l > 1 OR r > 1"""))
def repeated(spark, sf):
    return tidy(joins.repeated_keys(reviews(spark, sf), users(spark, sf), "user_id"))


@query("C4_keep_matching_ids", sql(f"""SELECT {big('user_id')} AS user_id, {big('fans')} AS fans FROM users
WHERE user_id IN (SELECT user_id FROM votes WHERE useful >= 4)"""))
def keep_matching(spark, sf):
    ids = reviews(spark, sf).where("useful >= 4")
    return tidy(joins.keep_matching(users(spark, sf).select("user_id", "fans"), ids, "user_id"))


@query("C5_keep_top_cities", sql(f"""SELECT {big('review_id')} AS review_id, city FROM review WHERE city IN (
  SELECT city FROM review WHERE city IS NOT NULL GROUP BY city ORDER BY count(*) DESC, city LIMIT 10)"""))
def keep_top(spark, sf):
    df = review_base(spark, sf, ["city"]).select("review_id", "city")
    return tidy(joins.keep_top(df, aggregates.top_values(df, "city", 10), "city"))


@query("C6_columns_side_by_side", sql(f"""SELECT {big('review_id')} AS review_id, {big('year(date)')} AS review_year,
  {big('month(date)')} AS review_month, {big('isodow(date) - 1')} AS review_day_of_week,
  {big('useful')} AS target_useful_votes, {big('useful > 0')} AS target_is_useful FROM review"""))
def side_by_side(spark, sf):
    df = joins.add_columns(
        reviews(spark, sf), dates.date_parts(F.col("date")), votes.targets(F.col("useful"))
    )
    return tidy(df.select("review_id", "review_year", "review_month", "review_day_of_week", "target_useful_votes", "target_is_useful"))


# ---- aggregations ---------------------------------------------------------


@query("D1_mean_by_month", sql(f"""SELECT {big('m - 1')} AS position, {big('m')} AS month, {r6('avg(useful)')} AS mean
FROM (SELECT unnest(range(1, 13)) AS m) LEFT JOIN review ON month(date) = m GROUP BY m"""))
def by_month(spark, sf):
    df = reviews(spark, sf).select(F.month("date").alias("month"), "useful")
    return tidy(aggregates.mean_by_domain(df, "month", "useful", range(1, 13)))


@query("D1_mean_by_weekday", sql(f"""SELECT {big('d')} AS position,
  ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][d + 1] AS weekday, {r6('avg(useful)')} AS mean
FROM (SELECT unnest(range(0, 7)) AS d) LEFT JOIN review ON isodow(date) - 1 = d GROUP BY d"""))
def by_weekday(spark, sf):
    df = reviews(spark, sf).select(dates.weekday_name(F.weekday("date")).alias("weekday"), "useful")
    return tidy(aggregates.mean_by_domain(df, "weekday", "useful", dates.WEEKDAYS))


@query("D2_city_mean_median", sql(f"""SELECT city, {r6('avg(useful)')} AS mean, {r6('median(useful)')} AS median, {big('count(*)')} AS n
FROM review WHERE city IN (SELECT city FROM review WHERE city IS NOT NULL GROUP BY city ORDER BY count(*) DESC, city LIMIT 15)
GROUP BY city"""))
def city_summary(spark, sf):
    return tidy(aggregates.group_summary(review_base(spark, sf, ["city"]), "city", "useful", 15, discrete=True))


@query("D2_price_by_brand", f"""SELECT p_brand, {r6('avg(l_extendedprice)')} AS mean, {r6('median(l_extendedprice)')} AS median, {big('count(*)')} AS n
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand""")
def price_summary(spark, sf):
    """Median of a column with very many distinct values (bucketed running total)."""
    line = table(spark, sf, "lineitem").select("l_partkey", "l_extendedprice")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return tidy(aggregates.group_summary(line.join(part, "l_partkey"), "p_brand", "l_extendedprice"))


@query("D3_top_states", sql(f"SELECT state, {big('count(*)')} AS n FROM review WHERE state IS NOT NULL GROUP BY state ORDER BY count(*) DESC, state LIMIT 4"))
def top_states(spark, sf):
    return tidy(aggregates.top_values(review_base(spark, sf, ["city"]), "state", 4))


@query("D3_vote_value_counts", sql(f"SELECT {big('useful')} AS useful, {big('count(*)')} AS n FROM review GROUP BY useful"))
def vote_counts(spark, sf):
    return tidy(aggregates.value_counts(reviews(spark, sf), "useful"))


LISTED = "list_filter(list_transform(string_split(categories, ','), lambda x: trim(x)), lambda x: x <> '')"
ENTRY = f"entry AS (SELECT review_id, useful, unnest({LISTED}) AS category FROM review WHERE categories IS NOT NULL)"


@query("D4_top_categories", sql(f"SELECT category AS token, {big('count(*)')} AS n FROM entry GROUP BY category ORDER BY count(*) DESC, category LIMIT 10", ENTRY))
def top_categories(spark, sf):
    df = review_base(spark, sf, ["city"]).select(categories.split_list(F.col("categories")).alias("categories"))
    return tidy(aggregates.top_list_values(df, "categories", 10))


@query("D5_category_mean_median", sql(f"""SELECT category, {r6('avg(useful)')} AS mean, {r6('median(useful)')} AS median, {big('count(*)')} AS n
FROM entry WHERE category IN (SELECT category FROM entry GROUP BY category ORDER BY count(*) DESC, category LIMIT 20)
GROUP BY category""", ENTRY))
def category_summary(spark, sf):
    df = review_base(spark, sf, ["city"]).withColumn("categories", categories.split_list(F.col("categories")))
    return tidy(aggregates.list_summary(df, "categories", "useful", 20, discrete=True))


def _describe_sql(source: str, columns: list[str], percentiles: dict[str, float]) -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", {big(f'count({c})')} AS count, {r6(f'avg({c})')} AS mean, "
        f"{r6(f'stddev_samp({c})')} AS std, {r6(f'min({c})')} AS min, "
        + ", ".join(f"{r6(f'quantile_cont({c}, {p}::DOUBLE)')} AS {n}" for n, p in percentiles.items())
        + f", {r6(f'max({c})')} AS max FROM {source}"
        for c in columns
    ]
    return " UNION ALL ".join(parts)


@query("D6_describe_votes", sql(_describe_sql("review", ["useful", "funny", "cool"], {"p25": 0.25, "p50": 0.5, "p75": 0.75})))
def describe_votes(spark, sf):
    return tidy(aggregates.describe(reviews(spark, sf), ["useful", "funny", "cool"], discrete=True))


@query("D6_describe_prices", _describe_sql("lineitem", ["l_extendedprice", "l_quantity"], {"p1": 0.01, "p50": 0.5, "p95": 0.95, "p99": 0.99}))
def describe_prices(spark, sf):
    return tidy(aggregates.describe(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], (0.01, 0.5, 0.95, 0.99)))


@query("D7_distinct_counts", sql(f"SELECT {big('count(DISTINCT business_id)')} AS business_id, {big('count(DISTINCT user_id)')} AS user_id, {big('count(DISTINCT city)')} AS city FROM review"))
def distinct_counts(spark, sf):
    return tidy(aggregates.distinct_counts(review_base(spark, sf, ["city"]), ["business_id", "user_id", "city"]))


@query("D6_D7_monthly_sketches", f"""SELECT year, {big('count(*)')} AS rows, {big('count(*)')} AS count, {r6('min(o_totalprice)')} AS min, {r6('max(o_totalprice)')} AS max,
  1 AS quantiles_near, 1 AS distinct_near, 1 AS whole_near FROM (SELECT *, year(o_orderdate) AS year FROM orders) GROUP BY year""".replace("1 AS", "CAST(1 AS BIGINT) AS").replace("SELECT year,", "SELECT CAST(year AS BIGINT) AS year,"))
def monthly_sketches(spark, sf):
    """States of every month, stored, merged to years and once more to one row; the
    estimates against exact ranks (within 2 %) and exact distinct counts (within 5 %)."""
    o = table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "o_totalprice", "o_custkey")
    path = f"{work_folder(spark)}/states"
    sketches.states(o, ["o_totalprice"], ["o_custkey"], ["year", "month"]).write.parquet(path)
    years = sketches.merged(spark.read.parquet(path), ["year"])
    probabilities = (0.1, 0.25, 0.5, 0.75, 0.9)

    def near(estimated, by, rows):
        """Do the shares of rows below the estimates miss the probabilities by 2 %?"""
        shares = [F.avg((F.col("o_totalprice") <= F.col(f"p{p * 100:g}")).cast("double")).alias(f"s{i}") for i, p in enumerate(probabilities)]
        hits = rows.join(F.broadcast(estimated), by).groupBy(*by).agg(
            *shares, F.count_distinct("o_custkey").alias("exact"), F.max("distinct").alias("distinct"))
        good = [F.abs(F.col(f"s{i}") - p) <= 0.02 for i, p in enumerate(probabilities)]
        all_good = good[0]
        for g in good[1:]:
            all_good = all_good & g
        return hits.select(*by, all_good.alias("quantiles_near"),
                           (F.abs(F.col("distinct") - F.col("exact")) <= 0.05 * F.col("exact")).alias("distinct_near"))

    def figures(states, by):
        long = sketches.estimates(states, probabilities, by)
        prices = long.where("column = 'o_totalprice'").drop("column", "distinct")
        return prices.join(long.where("column = 'o_custkey'").select(*by, "distinct"), by) if by else prices

    per_year = figures(years, ["year"])
    whole = sketches.estimates(sketches.merged(years.withColumn("all", F.lit(1)), ["all"]), probabilities, ["all"])
    whole = whole.where("column = 'o_totalprice'").drop("column", "distinct").join(
        whole.where("column = 'o_custkey'").select("all", "distinct"), "all")
    all_near = near(whole, ["all"], o.withColumn("all", F.lit(1))).select(F.col("quantiles_near") & F.col("distinct_near"))
    out = per_year.join(near(per_year, ["year"], o), "year").withColumn("whole_near", all_near.scalar())
    return tidy(out.select("year", F.col("count").alias("rows"), "count", "min", "max", "quantiles_near", "distinct_near", "whole_near"))


@query("D6_describe_approximate", "SELECT t.\"column\", t.count, t.mean, t.std, t.min, t.max, CAST(1 AS BIGINT) AS near FROM (" + _describe_sql("lineitem", ["l_extendedprice", "l_quantity"], {"p50": 0.5}) + ") t")
def describe_approximate(spark, sf):
    """Sketched percentiles, compared with the shares of rows around them."""
    lines = table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity")
    found = aggregates.describe(lines, ["l_extendedprice", "l_quantity"], (0.01, 0.5, 0.99), approx=True)
    long = ranks.long_form(lines, ["l_extendedprice", "l_quantity"])
    shares = long.join(F.broadcast(found.select("column", "p1", "p50", "p99")), "column").groupBy("column").agg(*[
        F.avg((F.col("value") < F.col(f"p{p}")).cast("double")).alias(f"b{p}") for p in (1, 50, 99)
    ], *[F.avg((F.col("value") <= F.col(f"p{p}")).cast("double")).alias(f"u{p}") for p in (1, 50, 99)])
    near = F.lit(True)
    for p in (1, 50, 99):
        near = near & (F.col(f"b{p}") <= p / 100 + 0.02) & (F.col(f"u{p}") >= p / 100 - 0.02)
    return tidy(found.join(shares.select("column", near.alias("near")), "column").drop("p1", "p50", "p99"))


@query("D8_H13_age_from_newest", f"SELECT event_id, {big('floor((epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 86400000000)')} AS age_days FROM events")
def age_from_newest(spark, sf):
    e = table(spark, sf, "events")
    newest = e.agg(F.max("ts")).scalar()
    return tidy(e.select("event_id", dates.age_days(newest, F.col("ts")).alias("age_days")))


PAIRS = [("useful", "funny"), ("useful", "cool"), ("useful", "stars"), ("useful", "user_fans"), ("useful", "business_review_count")]


@query("D9_pearson", sql(" UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {r6(f'corr({a}, {b})')} AS correlation FROM review" for a, b in PAIRS)))
def pearson(spark, sf):
    return tidy(correlation.pearson(review_base(spark, sf, ["business", "users"]), PAIRS))


def _spearman_sql(source: str, a: str, b: str) -> str:
    return (
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {big('count(*)')} AS rows, {r6('corr(ra, rb)')} AS correlation FROM ("
        f"SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, "
        f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb "
        f"FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    )


@query("D10_spearman_pairs", sql(" UNION ALL ".join(_spearman_sql("review", a, b) for a, b in PAIRS)))
def spearman_pairs(spark, sf):
    return tidy(correlation.spearman(review_base(spark, sf, ["business", "users"]), PAIRS))


MATRIX = ["useful", "stars", "cool", "funny", "words", "chars", "user_average_stars"]


@query("D10_spearman_matrix", sql(
    " UNION ALL ".join(_spearman_sql("m", a, b) for a, b in [(a, b) for i, a in enumerate(MATRIX) for b in MATRIX[i + 1:]]),
    r"m AS (SELECT useful, stars, cool, funny, len(regexp_extract_all(text, '\S+')) AS words, length(text) AS chars, user_average_stars FROM review)"))
def spearman_matrix(spark, sf):
    df = review_base(spark, sf, ["users", "text"]).withColumns(
        {"words": text.word_count(F.col("text")), "chars": F.length("text")}
    )
    return tidy(correlation.spearman_matrix(df, MATRIX, "review_id"))


MISSING = ["review_id", "business_id", "city", "user_fans", "text"]


@query("D11_missing_counts", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {big(f'count(*) - count({c})')} AS missing FROM review" for c in MISSING)))
def missing(spark, sf):
    return tidy(aggregates.missing_counts(review_base(spark, sf, ["city", "users", "text"]).select(*MISSING)))


@query("D12_label_shares", f"SELECT event_type, {big('count(*)')} AS n, {r6('count(*) * 100.0 / (SELECT count(*) FROM events)')} AS percent FROM events GROUP BY event_type")
def label_shares(spark, sf):
    return tidy(aggregates.label_shares(table(spark, sf, "events"), "event_type"))


@query("D13_token_counts", f"""SELECT token, {big('count(*)')} AS n FROM (
  SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]{{2,}}')) AS token FROM documents)
GROUP BY token ORDER BY count(*) DESC, token LIMIT 30""")
def token_counts(spark, sf):
    return tidy(aggregates.token_counts(documents(spark, sf), "text", 30))


@query("D14_sentiment_summary", sql(f"""SELECT {big('count(*)')} AS total_reviews, {r6('avg(s)')} AS sentiment_score_mean, {r6('min(s)')} AS sentiment_score_min,
  {r6('max(s)')} AS sentiment_score_max, {r6('avg(useful)')} AS useful_votes_mean, {r6('median(s)')} AS sentiment_score_median,
  (SELECT string_agg(l || '=' || n, ', ' ORDER BY l) FROM (SELECT l, count(*) AS n FROM scored GROUP BY l)) AS label_counts
FROM scored""", """scored AS (SELECT useful, CASE WHEN useful > funny THEN 'POSITIVE' WHEN useful < funny THEN 'NEGATIVE' ELSE 'None' END AS l,
  (useful + 1.0) / (useful + funny + cool + 2) AS s FROM review)"""))
def summary(spark, sf):
    total = F.col("useful") + F.col("funny") + F.col("cool")
    df = reviews(spark, sf).select(
        "useful",
        F.when(F.col("useful") > F.col("funny"), "POSITIVE")
        .when(F.col("useful") < F.col("funny"), "NEGATIVE")
        .alias("sentiment_label"),
        ((F.col("useful") + 1.0) / (total + 2)).alias("sentiment_score"),
    )
    one = aggregates.sentiment_summary(df)
    labels = F.array_join(
        F.transform(F.map_entries("label_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ", "
    )
    return tidy(one.withColumn("label_counts", labels))


META = {"meta_rings": ("ring",), "meta_colours": ("red", "blue", "green"), "meta_sizes": ("small", "large"), "meta_absent": ("nowhere",)}


def _meta_sql() -> str:
    parts = []
    for name, members in META.items():
        flag = f"len(list_filter({LISTED}, lambda x: lower(x) IN ({', '.join(repr(m) for m in members)}))) > 0"
        parts.append(
            f"SELECT '{name}' AS flag, {r6(f'avg(CASE WHEN {flag} THEN useful END)')} AS mean, "
            f"{big(f'count(CASE WHEN {flag} THEN 1 END)')} AS count FROM review"
        )
    return " UNION ALL ".join(parts)


@query("D15_meta_category_means", sql(_meta_sql()))
def meta_means(spark, sf):
    df = review_base(spark, sf, ["city"])
    flags = categories.meta_flags(categories.split_list(F.col("categories")), META)
    return tidy(aggregates.flag_means(df, flags, "useful"))


def _histogram_sql(x: str, source: str, bins: int, ctes: str = "") -> str:
    return f"""{ctes}SELECT {big('b.bin')} AS bin, {r6('lo + b.bin * w')} AS low, {r6('lo + (b.bin + 1) * w')} AS high,
  {big('coalesce(n, 0)')} AS n, {r6('coalesce(n, 0) / (total * ((lo + (b.bin + 1) * w) - (lo + b.bin * w)))')} AS density
FROM (SELECT unnest(range(0, {bins})) AS bin) b
CROSS JOIN (SELECT min({x})::DOUBLE AS lo, (max({x})::DOUBLE - min({x})::DOUBLE) / {bins} AS w, count({x}) AS total FROM {source}) e
LEFT JOIN (SELECT CASE WHEN x < lo + k * w AND k > 0 THEN k - 1 WHEN x >= lo + (k + 1) * w AND k < {bins - 1} THEN k + 1 ELSE k END AS bin, count(*) AS n
  FROM (SELECT x, lo, (hi - lo) / {bins} AS w, least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1}) AS k
        FROM (SELECT {x}::DOUBLE AS x FROM {source}) d
        CROSS JOIN (SELECT min({x})::DOUBLE AS lo, max({x})::DOUBLE AS hi FROM {source}) m WHERE x IS NOT NULL)
  GROUP BY 1) c ON c.bin = b.bin"""


@query("D16_histogram_prices", _histogram_sql("o_totalprice", "orders", 50))
def price_histogram(spark, sf):
    return tidy(aggregates.histogram(table(spark, sf, "orders"), "o_totalprice", 50, density=True))


@query("D16_histogram_log_votes", sql(_histogram_sql("ln(1 + useful)", "review", 20)))
def vote_histogram(spark, sf):
    return tidy(aggregates.histogram(reviews(spark, sf), "useful", 20, log=True, density=True))


def _bin_sql(x: str, q: int) -> str:
    """Bin number of quantile bins over a CTE ``t``."""
    cuts = ", ".join(f"{i / q}" for i in range(q + 1))
    return (
        f"CASE WHEN {x} IS NOT NULL THEN len(list_filter(list_slice(edges, 2, len(edges) - 1), lambda v: v < {x})) END"
        f" AS bin FROM t CROSS JOIN (SELECT list_sort(list_distinct(quantile_cont({x}::DOUBLE, [{cuts}]))) AS edges FROM t) e"
    )


@query("D17_mean_by_length_decile", sql(
    f"SELECT {big('bin')} AS bin, {r6('avg(useful)')} AS mean, {big('count(*)')} AS n FROM (SELECT useful, {_bin_sql('words', 10)}) WHERE bin IS NOT NULL GROUP BY bin",
    r"t AS (SELECT useful, len(regexp_extract_all(text, '\S+')) AS words FROM review WHERE text IS NOT NULL)"))
def by_length(spark, sf):
    df = review_base(spark, sf, ["text"]).where("text is not null")
    # the edges and the bins are two passes over the two numbers
    df = keep(df.select("useful", text.word_count(F.col("text")).alias("words")))
    return tidy(aggregates.mean_by_bin(ranks.quantile_bin(df, "words", 10), "bin", "useful"))


@query("D17_mean_by_fans", sql(f"""SELECT {big('p')} AS position, label AS fans_bin, {r6('avg(useful)')} AS mean
FROM (VALUES (0, '0', -1, 0), (1, '1-5', 0, 5), (2, '6-20', 5, 20), (3, '21-100', 20, 100), (4, '100+', 100, 1000000000)) b(p, label, lo, hi)
LEFT JOIN review ON coalesce(user_fans, 0) > lo AND coalesce(user_fans, 0) <= hi GROUP BY p, label"""))
def by_fans(spark, sf):
    return tidy(aggregates.fans_summary(review_base(spark, sf, ["users"]), "user_fans", "useful"))


@query("D18_flag_over_votes", sql(f"SELECT {big('review_id')} AS review_id, {r6('CASE WHEN useful <> 0 THEN 1.0 / useful END')} AS useful_over_votes FROM review"))
def flag_ratio(spark, sf):
    flag = (F.col("useful") > 0).cast("int")
    return tidy(reviews(spark, sf).select("review_id", votes.flag_ratio(flag, F.col("useful")).alias("useful_over_votes")))


@query("D19_table_overview", f"""SELECT {big('p')} AS position, c AS "column", k AS type, (SELECT {big('count(*)')} FROM labels) AS rows
FROM (VALUES (0, 'doc_id', 'bigint'), (1, 'quality', 'int'), (2, 'toxic', 'int')) v(p, c, k)""")
def overview(spark, sf):
    return tidy(aggregates.table_overview(table(spark, sf, "labels").select(
        "doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))))


@query("D20_rows_per_quantile_bin", sql(
    f"SELECT {big('bin')} AS bin, {big('count(*)')} AS n FROM (SELECT {_bin_sql('useful', 10)}) WHERE bin IS NOT NULL GROUP BY bin",
    "t AS (SELECT useful FROM review)"))
def bin_rows(spark, sf):
    df = ranks.quantile_bin(reviews(spark, sf).select("useful"), "useful", 10, discrete=True)
    return tidy(aggregates.bin_counts(df, "bin"))


# ---- windows, ranks and bins ------------------------------------------------


@query("E1_E2_rank_in_business", sql(f"""SELECT {big('review_id')} AS review_id,
  {big('CASE WHEN useful IS NOT NULL AND business_id IS NOT NULL THEN count(useful) OVER (PARTITION BY business_id ORDER BY useful RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END')} AS useful_rank_in_business,
  {r6('CASE WHEN business_id IS NOT NULL THEN (rank() OVER (PARTITION BY business_id ORDER BY useful) + (count(*) OVER (PARTITION BY business_id, useful) - 1) / 2.0) / count(useful) OVER (PARTITION BY business_id) END')} AS useful_percentile_in_business
FROM review"""))
def rank_in_business(spark, sf):
    df = ranks.rank_in_group(
        reviews(spark, sf), "useful", "business_id", "review_id",
        "useful_rank_in_business", "useful_percentile_in_business",
    )
    return tidy(df.select("review_id", "useful_rank_in_business", "useful_percentile_in_business"))


@query("E3_average_rank_votes", sql(f"""SELECT {big('review_id')} AS review_id,
  {r6('rank() OVER (ORDER BY useful) + (count(*) OVER (PARTITION BY useful) - 1) / 2.0')} AS rank_avg FROM review"""))
def average_rank(spark, sf):
    df = ranks.average_rank(reviews(spark, sf), "useful", "review_id", discrete=True)
    return tidy(df.select("review_id", "rank_avg"))


@query("E3_average_rank_prices", f"SELECT o_orderkey, {r6('rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0')} AS rank_avg FROM orders")
def price_rank(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return tidy(ranks.average_rank(df, "o_totalprice", "o_orderkey").select("o_orderkey", "rank_avg"))


@query("E4_price_deciles", f"WITH t AS (SELECT o_orderkey, o_totalprice FROM orders) SELECT o_orderkey, {big('bin')} AS bin FROM (SELECT o_orderkey, {_bin_sql('o_totalprice', 10)})")
def price_bins(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return tidy(ranks.quantile_bin(df, "o_totalprice", 10).select("o_orderkey", "bin"))


@query("E5_fans_bins", sql("""SELECT CAST(user_id AS BIGINT) AS user_id, CASE WHEN coalesce(fans, 0) <= -1 THEN NULL WHEN coalesce(fans, 0) <= 0 THEN '0' WHEN fans <= 5 THEN '1-5'
  WHEN fans <= 20 THEN '6-20' WHEN fans <= 100 THEN '21-100' ELSE '100+' END AS fans_bin FROM users"""))
def fans_bins(spark, sf):
    return tidy(users(spark, sf).select("user_id", aggregates.fans_bin(F.col("fans")).alias("fans_bin")))


@query("E6_winsorized_events", f"SELECT event_id, {r6('least(value, (SELECT quantile_cont(value, 0.99) FROM events))')} AS value FROM events")
def winsorized(spark, sf):
    return tidy(ranks.winsorize(table(spark, sf, "events").select("event_id", "value"), ["value"], 0.99))


@query("E6_winsorized_log_votes", sql(f"""SELECT {big('review_id')} AS review_id, replace(vote, 'log1p_', '') AS vote_type, {r6('ln(1 + x)')} AS log1p_votes FROM (
  SELECT review_id, 'useful' AS vote, least(useful, (SELECT quantile_cont(useful, 0.99) FROM review)) AS x FROM review UNION ALL
  SELECT review_id, 'funny', least(funny, (SELECT quantile_cont(funny, 0.99) FROM review)) FROM review UNION ALL
  SELECT review_id, 'cool', least(cool, (SELECT quantile_cont(cool, 0.99) FROM review)) FROM review)"""))
def winsorized_votes(spark, sf):
    names = ["useful", "funny", "cool"]
    df = ranks.winsorize(reviews(spark, sf).select("review_id", *names), names, 0.99, discrete=True)
    logs = df.select("review_id", *[votes.log_votes(F.col(c)).alias(f"log1p_{c}") for c in names])
    return tidy(reshape.melt(logs, ["review_id"], [f"log1p_{c}" for c in names], "vote_type", "log1p_votes", "log1p_"))


@query("E7_one_random_business", sql(f"""SELECT {big('review_id')} AS review_id, {big('useful')} AS useful, {big('r')} AS useful_rank_in_business FROM (
  SELECT *, count(useful) OVER (PARTITION BY business_id ORDER BY useful RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM review)
WHERE business_id = (SELECT business_id FROM review WHERE business_id IS NOT NULL ORDER BY md5(concat('42:', CAST(business_id AS VARCHAR))) LIMIT 1)"""))
def random_business(spark, sf):
    df = reviews(spark, sf)
    return tidy(sampling.members_of_random_group(df, "business_id", "useful", "review_id", 42))


# ---- sort, limit, sampling, split -------------------------------------------


@query("F1_F2_head_by_key", f"SELECT o_orderkey, {r6('o_totalprice')} AS o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def head(spark, sf):
    return tidy(aggregates.first_members(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice"], 100, "o_orderkey"))


@query("F3_sample_500", "SELECT o_orderkey FROM orders ORDER BY md5(concat('42:', CAST(o_orderkey AS VARCHAR))), CAST(o_orderkey AS VARCHAR) LIMIT 500")
def small_sample(spark, sf):
    return sampling.sample_rows(table(spark, sf, "orders"), 500, "o_orderkey").select("o_orderkey")


@query("F3_sample_12000", "SELECT o_orderkey FROM orders ORDER BY md5(concat('7:', CAST(o_orderkey AS VARCHAR))), CAST(o_orderkey AS VARCHAR) LIMIT 12000")
def large_sample(spark, sf):
    """Larger than the top-n limit: the bucket threshold is used."""
    return sampling.sample_rows(table(spark, sf, "orders"), 12000, "o_orderkey", 7).select("o_orderkey")


SHARES = """sizes AS (SELECT y, count(*) AS n, sum(count(*)) OVER () AS total FROM labelled GROUP BY y),
shares AS (SELECT y, n, total, (total - ceil(total * 0.2)) AS train, (total - ceil(total * 0.2)) * n / total AS s FROM sizes),
quota AS (SELECT y, n - (floor(s) + CASE WHEN row_number() OVER (ORDER BY round(s - floor(s), 9) DESC, y) <= train - sum(floor(s)) OVER () THEN 1 ELSE 0 END) AS take FROM shares)"""


@query("F4_stratified_split", sql(
    f"SELECT {big('l.review_id')} AS review_id, {big('r <= take')} AS is_eval FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat('42:', CAST(review_id AS VARCHAR))), CAST(review_id AS VARCHAR)) AS r FROM labelled) l JOIN quota USING (y)",
    "labelled AS (SELECT review_id, CAST(useful > 0 AS INT) AS y FROM review)", SHARES))
def stratified_split(spark, sf):
    df = reviews(spark, sf).withColumns(votes.targets(F.col("useful")))
    return tidy(sampling.mark_evaluation(df, 0.2).select("review_id", "is_eval"))


@query("F4_hash_threshold_split", f"SELECT o_orderkey, {big('''CAST(concat('0x', substr(md5(concat('42:', CAST(o_orderkey AS VARCHAR))), 1, 5)) AS BIGINT) < 209715''')} AS is_eval FROM orders")
def threshold_split(spark, sf):
    train, held = sampling.approximate_split(table(spark, sf, "orders").select("o_orderkey"), 0.2, "o_orderkey")
    return tidy(train.withColumn("is_eval", F.lit(False)).unionByName(held.withColumn("is_eval", F.lit(True))))


@query("F5_stratified_sample", sql(
    f"SELECT {big('review_id')} AS review_id, {big('y')} AS target_is_useful FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat('42:', CAST(review_id AS VARCHAR))), CAST(review_id AS VARCHAR)) AS r FROM labelled) l JOIN quota USING (y) WHERE r <= take",
    "labelled AS (SELECT review_id, CAST(useful > 0 AS INT) AS y FROM review)",
    """shares AS (SELECT y, count(*) AS n, 2000 * count(*) / sum(count(*)) OVER () AS s FROM labelled GROUP BY y),
quota AS (SELECT y, floor(s) + CASE WHEN row_number() OVER (ORDER BY round(s - floor(s), 9) DESC, y) <= 2000 - sum(floor(s)) OVER () THEN 1 ELSE 0 END AS take FROM shares)"""))
def stratified_sample(spark, sf):
    df = reviews(spark, sf).withColumns(votes.targets(F.col("useful")))
    return tidy(sampling.stratified_sample(df, 2000, "review_id", "target_is_useful").select("review_id", "target_is_useful"))


@query("F6_extremes", f"""SELECT side, p_name || '#' || p_partkey AS label, {r6('p_retailprice')} AS value FROM (
  (SELECT 'high' AS side, * FROM part ORDER BY p_retailprice DESC, p_name || '#' || p_partkey LIMIT 25) UNION ALL
  (SELECT 'low' AS side, * FROM part ORDER BY p_retailprice, p_name || '#' || p_partkey LIMIT 25))""")
def extremes(spark, sf):
    df = table(spark, sf, "part").select(
        F.concat_ws("#", "p_name", F.col("p_partkey").cast("string")).alias("label"), F.col("p_retailprice").alias("value")
    )
    return tidy(aggregates.extremes(df, "value", "label", 25))


# ---- set operations and reshape ----------------------------------------------


@query("G1_union_by_name", f"""SELECT c_custkey AS key, c_name AS name, {r6('c_acctbal')} AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, {r6('s_acctbal')}, NULL FROM supplier""")
def union_by_name(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return tidy(reshape.union_by_name(c, s))


@query("G2_melt_votes", sql(f"""SELECT {big('review_id')} AS review_id, vote_type, {big('votes')} AS votes FROM (
  SELECT review_id, 'useful' AS vote_type, useful AS votes FROM review UNION ALL SELECT review_id, 'funny', funny FROM review
  UNION ALL SELECT review_id, 'cool', cool FROM review)"""))
def melt(spark, sf):
    df = reviews(spark, sf).select("review_id", *[F.col(c).alias(f"n_{c}") for c in ("useful", "funny", "cool")])
    return tidy(reshape.melt(df, ["review_id"], ["n_useful", "n_funny", "n_cool"], "vote_type", "votes", "n_"))


@query("G3_explode_categories", sql(f"SELECT {big('review_id')} AS review_id, category FROM entry", ENTRY))
def explode(spark, sf):
    df = review_base(spark, sf, ["city"]).select("review_id", categories.split_list(F.col("categories")).alias("parts"))
    return tidy(aggregates.explode_list(df, "parts", "category").select("review_id", "category"))


@query("G3_explode_keeping_empty", sql(f"SELECT {big('review_id')} AS review_id, category FROM entry UNION ALL SELECT {big('review_id')}, NULL FROM review WHERE categories IS NULL", ENTRY))
def explode_outer(spark, sf):
    df = review_base(spark, sf, ["city"]).select("review_id", categories.split_list(F.col("categories")).alias("parts"))
    return tidy(aggregates.explode_list(df, "parts", "category", keep_empty=True).select("review_id", "category"))


# ---- table reads that need no scratch files ------------------------------------


@query("A5_columns_and_head", f"SELECT doc_id, lang, {big('n_chars')} AS n_chars FROM documents ORDER BY doc_id LIMIT 250")
def columns_and_head(spark, sf):
    return tidy(readers.read_table(spark, f"{sf}/documents.parquet", ["doc_id", "lang", "n_chars"], 250, "doc_id"))


@query("A7_review_subset", sql(f"""SELECT {big('review_id')} AS review_id, {big('user_id')} AS user_id, {big('business_id')} AS business_id, text, {big('useful')} AS useful
FROM review WHERE useful > 0 ORDER BY md5(concat('42:', CAST(review_id AS VARCHAR))), CAST(review_id AS VARCHAR) LIMIT 1000"""))
def review_subset(spark, sf):
    df = with_text(reviews(spark, sf), spark, sf)
    return tidy(readers.review_subset(df, 1000, positive_only=True, seed=42))
