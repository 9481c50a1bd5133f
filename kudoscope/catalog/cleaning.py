"""Queries of projections, filters and cleaners."""

from __future__ import annotations

from pyspark.sql import functions as F

from kudoscope.catalog.base import business, documents, review_base, reviews, sql, table, users
from kudoscope.catalog.registry import big, query, r6, tidy
from kudoscope.functions import categories, coerce, votes
from kudoscope.operators import clean, encoders

# Raw text records derived from the tables: some votes, dates and keys are bad.
RAW_REVIEWS = """raw AS (
  SELECT CASE WHEN o_orderstatus <> 'P' OR o_totalprice < 400000 THEN CAST(o_orderkey AS VARCHAR) END AS review_id,
         CAST(o_custkey AS VARCHAR) AS user_id, o_orderpriority AS business_id,
         substr(o_orderpriority, 1, 1) AS stars,
         CASE WHEN o_orderstatus = 'P' AND o_totalprice < 100000 THEN 'notadate'
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
         text,
         CASE WHEN lang = 'en' THEN 'x' WHEN lang = 'de' THEN '3.7' WHEN lang = 'fr' THEN NULL
              ELSE CAST(n_chars AS VARCHAR) END AS useful,
         o_orderstatus AS funny, '-1' AS cool
  FROM orders LEFT JOIN documents ON doc_id = o_orderkey)"""


def raw_reviews(spark, sf):
    o = table(spark, sf, "orders")
    d = documents(spark, sf)
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return o.join(d, o.o_orderkey == d.doc_id, "left").select(
        F.when((status != "P") | (price < 400000), F.col("o_orderkey").cast("string")).alias("review_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_orderpriority").alias("business_id"),
        F.substring("o_orderpriority", 1, 1).alias("stars"),
        F.when((status == "P") & (price < 100000), "notadate")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("date"),
        "text",
        F.when(F.col("lang") == "en", "x")
        .when(F.col("lang") == "de", "3.7")
        .when(F.col("lang") == "fr", F.lit(None))
        .otherwise(F.col("n_chars").cast("string"))
        .alias("useful"),
        status.alias("funny"),
        F.lit("-1").alias("cool"),
        F.lit("ignored").alias("extra"),
    )


@query(
    "B1_B6_clean_reviews",
    f"""WITH {RAW_REVIEWS}
SELECT review_id, user_id, business_id, {r6("TRY_CAST(stars AS DOUBLE)")} AS stars,
  strftime(TRY_CAST(date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS date, text,
  {big("coalesce(trunc(TRY_CAST(useful AS DOUBLE)), 0)")} AS useful,
  {big("coalesce(trunc(TRY_CAST(funny AS DOUBLE)), 0)")} AS funny,
  {big("coalesce(trunc(TRY_CAST(cool AS DOUBLE)), 0)")} AS cool,
  {big("year(TRY_CAST(date AS TIMESTAMP))")} AS review_year,
  {big("month(TRY_CAST(date AS TIMESTAMP))")} AS review_month,
  {big("isodow(TRY_CAST(date AS TIMESTAMP)) - 1")} AS review_day_of_week
FROM raw WHERE review_id IS NOT NULL AND user_id IS NOT NULL AND business_id IS NOT NULL
  AND length(text) >= 10 AND TRY_CAST(date AS TIMESTAMP) IS NOT NULL""",
)
def clean_reviews(spark, sf):
    return tidy(clean.clean_reviews(raw_reviews(spark, sf)))


RAW_USERS = """raw AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS name,
         CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE CAST(c_acctbal AS VARCHAR) END AS review_count,
         CASE WHEN c_mktsegment = 'BUILDING' THEN '2010-02-03 04:05:06' ELSE c_name END AS yelping_since,
         CAST(c_nationkey AS VARCHAR) AS useful, CAST(NULL AS VARCHAR) AS funny, '12' AS cool, c_mktsegment AS fans,
         CASE c_mktsegment WHEN 'HOUSEHOLD' THEN NULL WHEN 'MACHINERY' THEN ''
              WHEN 'FURNITURE' THEN 'None' ELSE '2019,2020' END AS elite,
         CAST(c_acctbal AS VARCHAR) AS average_stars
  FROM customer)"""


@query(
    "B5_B7_clean_users",
    f"""WITH {RAW_USERS}
SELECT user_id, name, {big("trunc(TRY_CAST(review_count AS DOUBLE))")} AS review_count,
  strftime(TRY_CAST(yelping_since AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS yelping_since,
  {big("TRY_CAST(useful AS DOUBLE)")} AS useful, {big("TRY_CAST(funny AS DOUBLE)")} AS funny,
  {big("TRY_CAST(cool AS DOUBLE)")} AS cool, {big("TRY_CAST(fans AS DOUBLE)")} AS fans, elite,
  {r6("TRY_CAST(average_stars AS DOUBLE)")} AS average_stars,
  coalesce(elite, 'None') AS elite_raw,
  {big("lower(coalesce(elite, 'None')) <> 'none'")} AS is_elite_ever
FROM raw""",
)
def clean_users(spark, sf):
    c = table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    raw = c.select(
        F.col("c_custkey").cast("string").alias("user_id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") < 0, seg).otherwise(F.col("c_acctbal").cast("string")).alias("review_count"),
        F.when(seg == "BUILDING", "2010-02-03 04:05:06").otherwise(F.col("c_name")).alias("yelping_since"),
        F.col("c_nationkey").cast("string").alias("useful"),
        F.lit(None).cast("string").alias("funny"),
        F.lit("12").alias("cool"),
        seg.alias("fans"),
        F.when(seg == "HOUSEHOLD", F.lit(None))
        .when(seg == "MACHINERY", "")
        .when(seg == "FURNITURE", "None")
        .otherwise("2019,2020")
        .alias("elite"),
        F.col("c_acctbal").cast("string").alias("average_stars"),
    )
    return tidy(clean.clean_users(raw))


@query(
    "B5_B8_clean_business",
    f"""WITH raw AS (
  SELECT CAST(p_partkey AS VARCHAR) AS business_id, p_name AS name, p_brand AS city, p_type AS state,
    CASE WHEN p_size > 40 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS stars,
    CASE WHEN p_type = 'SMALL' THEN NULL WHEN p_type = 'ECONOMY' THEN ''
         ELSE concat(replace(p_name, ' ', ', '), ',, ', p_type, ' ') END AS categories,
    CASE WHEN p_size < 25 THEN '1' WHEN p_size < 30 THEN 'open' ELSE '0' END AS is_open
  FROM part)
SELECT business_id, name, city, state, {r6("TRY_CAST(stars AS DOUBLE)")} AS stars,
  CASE WHEN categories IS NULL OR categories = '' THEN ''
       ELSE array_to_string(list_transform(string_split(categories, ','), lambda x: trim(x)), '|') END AS categories,
  {big("coalesce(TRY_CAST(is_open AS DOUBLE), 0)")} AS is_open
FROM raw""",
)
def clean_business(spark, sf):
    size, kind = F.col("p_size"), F.col("p_type")
    raw = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("business_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("city"),
        kind.alias("state"),
        F.when(size > 40, F.col("p_brand")).otherwise(size.cast("string")).alias("stars"),
        F.when(kind == "SMALL", F.lit(None))
        .when(kind == "ECONOMY", "")
        .otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(",, "), kind, F.lit(" ")))
        .alias("categories"),
        F.when(size < 25, "1").when(size < 30, "open").otherwise("0").alias("is_open"),
    )
    return tidy(clean.clean_business(raw))


@query(
    "B1_keep_known_columns",
    "SELECT c_custkey, c_name, c_acctbal FROM customer",
)
def keep_known(spark, sf):
    return clean.keep_known(
        table(spark, sf, "customer"), ["c_custkey", "absent", "c_name", "c_acctbal"]
    )


@query("B2_require_keys", sql(f"SELECT {big('review_id')} AS review_id, {big('business_id')} AS business_id FROM review WHERE business_id IS NOT NULL"))
def require_keys(spark, sf):
    return tidy(clean.require_keys(reviews(spark, sf), ["review_id", "business_id"]).select("review_id", "business_id"))


@query(
    "B3_min_text_length",
    "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars FROM documents WHERE length(text) >= 200",
)
def min_text(spark, sf):
    kept = clean.min_text_length(documents(spark, sf), "text", 200)
    return tidy(kept.select("doc_id", F.length("text").alias("chars")))


@query(
    "B4_votes_to_count_or_zero",
    f"""SELECT event_id, {big("coalesce(trunc(TRY_CAST(CASE WHEN event_type = 'click' THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE)), 0)")} AS votes
FROM events""",
)
def count_or_zero(spark, sf):
    raw = F.when(F.col("event_type") == "click", F.col("event_type")).otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", coerce.to_count_or_zero(raw).alias("votes"))


@query(
    "B6_date_or_drop",
    """SELECT o_orderkey, strftime(TRY_CAST(d AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS date FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d
  FROM orders) WHERE TRY_CAST(d AS TIMESTAMP) IS NOT NULL""",
)
def date_or_drop(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    out = table(spark, sf, "orders").select("o_orderkey", coerce.to_timestamp(raw).alias("date"))
    return tidy(out.where("date is not null"))


@query(
    "B9_category_list",
    sql("""SELECT CAST(business_id AS BIGINT) AS business_id,
  array_to_string(list_filter(list_transform(string_split(concat(categories, ',,'), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS categories
FROM business"""),
)
def category_list(spark, sf):
    b = business(spark, sf, counts=False)
    parts = F.split(F.concat("categories", F.lit(",,")), ",")
    return tidy(b.select("business_id", categories.non_empty(parts).alias("categories")))


PARENTS = "('ring', 'widget', 'small')"


@query(
    "B10_normalized_categories",
    sql(f"""SELECT CAST(business_id AS BIGINT) AS business_id,
  array_to_string(list_filter(p, lambda x, i: list_position(list_transform(p, lambda y: lower(y)), lower(x)) = i), '|') AS categories
FROM (SELECT business_id, list_filter(list_transform(string_split(concat(categories, ', ', upper(categories)), ','), lambda x: trim(x)),
         lambda x: x <> '' AND lower(x) NOT IN {PARENTS}) AS p FROM business)"""),
)
def normalized(spark, sf):
    b = business(spark, sf, counts=False)
    raw = F.array(F.col("categories"), F.upper("categories"))
    return tidy(b.select("business_id", categories.normalize(raw, ("ring", "widget", "small")).alias("categories")))


@query(
    "B11_clean_votes",
    f"""SELECT event_id, {big("greatest(v, 0)")} AS clipped, {big("CASE WHEN v <> -1 THEN v END")} AS nulled,
  {big("v")} AS kept, {big("greatest(coalesce(CASE WHEN event_type <> 'view' THEN v END, 0), 0)")} AS zeroed
FROM (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN -1 ELSE CAST(floor(value) AS BIGINT) END AS v FROM events)""",
)
def vote_policies(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id",
        "event_type",
        F.when(F.col("event_type") == "error", -1).otherwise(F.floor("value")).cast("bigint").alias("v"),
    )
    v = F.col("v")
    return tidy(
        e.select(
            "event_id",
            votes.clean_votes(v, "clip").alias("clipped"),
            votes.clean_votes(v, "null").alias("nulled"),
            votes.clean_votes(v, "keep").alias("kept"),
            votes.clean_votes(F.when(F.col("event_type") != "view", v), "zero").alias("zeroed"),
        )
    )


@query("B12_vote_filters", sql(f"SELECT {big('review_id')} AS review_id, {big('useful')} AS useful, {r6('useful + funny + cool')} AS total_votes FROM review WHERE useful > 0 AND useful + funny + cool > 0"))
def vote_filters(spark, sf):
    df = reviews(spark, sf).withColumn("total_votes", votes.total_votes(*map(F.col, ("useful", "funny", "cool"))))
    return tidy(df.where("useful > 0 and total_votes > 0").select("review_id", "useful", "total_votes"))


@query("B13_valid_target", "SELECT event_id, round(v, 6) + 0.0 AS target FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN NULL WHEN event_type = 'error' THEN -value ELSE value END AS v FROM events) WHERE v >= 0")
def valid_target(spark, sf):
    v = F.when(F.col("event_type") == "click", F.lit(None)).when(
        F.col("event_type") == "error", -F.col("value")
    ).when(F.col("event_type") == "nan", F.lit(float("nan"))).otherwise(F.col("value"))
    e = table(spark, sf, "events").select("event_id", v.alias("target"))
    return tidy(clean.valid_target(e, "target", check=True))


@query("B14_popular_reviews", sql(f"SELECT {big('review_id')} AS review_id, {big('useful')} AS useful FROM review WHERE useful + funny + cool >= 3"))
def popular(spark, sf):
    df = reviews(spark, sf).withColumn("total_votes", votes.total_votes(*map(F.col, ("useful", "funny", "cool"))))
    return tidy(clean.popular(df, 3).select("review_id", "useful"))


@query("B15_fill_nulls", sql(f"SELECT {big('review_id')} AS review_id, coalesce(city, 'Unknown') AS city, {big('coalesce(business_stars, 0)')} AS business_stars, coalesce(text, '') AS text FROM review"))
def fill(spark, sf):
    df = review_base(spark, sf, ["business", "text"]).select("review_id", "city", "business_stars", "text")
    return tidy(clean.fill_nulls(df, {"city": "Unknown", "business_stars": 0, "text": "", "absent": 0}))


@query("B16_fill_date_parts", sql(f"""SELECT {big('review_id')} AS review_id,
  {big("CASE WHEN stars > 2 THEN stars ELSE year(date) END")} AS review_year, {big("month(date)")} AS review_month,
  {big("isodow(date) - 1")} AS review_day_of_week FROM review"""))
def fill_parts(spark, sf):
    df = reviews(spark, sf).withColumn("review_year", F.when(F.col("stars") > 2, F.col("stars")))
    return tidy(clean.fill_date_parts(df).select("review_id", "review_year", "review_month", "review_day_of_week"))


@query("B17_text_column", "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars FROM documents")
def text_column(spark, sf):
    from kudoscope.functions.text import text_column as find

    d = documents(spark, sf)
    return tidy(d.select("doc_id", F.length(find(d.columns)).alias("chars")))


@query("I11_numeric_features", sql(f"""SELECT {big('review_id')} AS review_id, {r6('stars')} AS stars, {r6('funny')} AS funny, {r6('cool')} AS cool,
  {r6('coalesce(is_open, 0)')} AS is_open, {r6('coalesce(business_stars, 0)')} AS business_stars,
  {r6('coalesce(business_review_count, 0)')} AS business_review_count, {r6('CAST(useful > 0 AS INT)')} AS flagged FROM review"""))
def numeric_features(spark, sf):
    df = review_base(spark, sf, ["business"]).withColumn("flagged", F.col("useful") > 0)
    names = encoders.numeric_columns(df, ["review_id", "user_id", "business_id", "useful"])
    return tidy(df.select("review_id", *[e.alias(c) for c, e in encoders.numeric_features(df, names).items()]))
