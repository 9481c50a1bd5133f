"""The given tables read as a review model (an order is a review, a part a
business, a customer a user; see FIXTURES.md)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan whose rows come from fewer tasks than cores is spread before costly row
    work; other scans stay as they are.

    A large file is cut into splits by its size, but a row group is read whole by one
    of them.  So the tasks that hold rows are counted, from the footers alone."""
    cores, tasks = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if tasks >= cores and df.select(F.spark_partition_id()).distinct().limit(cores).count() >= cores:
        return df
    return df.repartition(max(cores, tasks))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the votes of their line items (lines are folded per order
    before the join, so the join is one row to one row)."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_partkey").alias("business_id"),
        *[
            F.count_if(F.col("l_returnflag") == flag).alias(name)
            for name, flag in (("useful", "R"), ("funny", "A"), ("cool", "N"))
        ],
    )
    orders = spread(table(spark, sf_dir, "orders")).select(
        F.col("o_orderkey").alias("review_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").cast("timestamp").alias("date"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("stars"),
    )
    return orders.join(lines, orders.review_id == lines.l_orderkey, "left").select(
        "review_id",
        "user_id",
        "business_id",
        "date",
        "stars",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("useful", "funny", "cool")],
    )


def with_text(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), "text")
    return df.join(docs, "review_id", "left")


def business(spark: SparkSession, sf_dir: str, counts: bool = True) -> DataFrame:
    """Parts; ``categories`` is the raw comma text."""
    df = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("business_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("city"),
        F.col("p_type").alias("state"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(", "), F.col("p_type")).alias(
            "categories"
        ),
        F.col("p_size").alias("stars"),
        (F.col("p_retailprice") > 950).cast("bigint").alias("is_open"),
    )
    if not counts:
        return df
    n = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("business_id"))
        .agg(F.count("*").alias("review_count"))
    )
    return df.join(n, "business_id", "left")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("user_id"))
        .agg(F.count("*").alias("review_count"), F.avg("o_totalprice").alias("average_stars"))
    )
    df = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 100).cast("bigint").alias("fans"),
        F.col("c_mktsegment").alias("segment"),
    )
    return df.join(n, "user_id", "left")


def review_base(spark: SparkSession, sf_dir: str, sides: Iterable[str] = ()) -> DataFrame:
    """Reviews with the wanted sides: ``business``, ``users``, ``text``."""
    sides = set(sides)
    df = reviews(spark, sf_dir)
    if "business" in sides:
        side = business(spark, sf_dir).select(
            "business_id", "city", "state", "categories", "is_open",
            F.col("stars").alias("business_stars"),
            F.col("review_count").alias("business_review_count"),
        )
        df = df.join(side, "business_id", "left")
    elif "city" in sides:
        side = business(spark, sf_dir, counts=False).select("business_id", "city", "state", "categories")
        df = df.join(side, "business_id", "left")
    if "users" in sides:
        side = users(spark, sf_dir).select(
            "user_id",
            F.col("fans").alias("user_fans"),
            F.col("review_count").alias("user_review_count"),
            F.col("average_stars").alias("user_average_stars"),
        )
        df = df.join(side, "user_id", "left")
    return with_text(df, spark, sf_dir) if "text" in sides else df


REVIEW_CTES = """votes AS (
  SELECT o_orderkey AS review_id, o_custkey AS user_id, min(l_partkey) AS business_id,
         o_orderdate AS date, CAST(substr(o_orderpriority, 1, 1) AS INT) AS stars,
         count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS useful,
         count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS funny,
         count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS cool
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
  GROUP BY o_orderkey, o_custkey, o_orderdate, o_orderpriority),
business AS (
  SELECT p_partkey AS business_id, p_name AS name, p_brand AS city, p_type AS state,
         concat(replace(p_name, ' ', ', '), ', ', p_type) AS categories,
         p_size AS stars, CAST(p_retailprice > 950 AS BIGINT) AS is_open, n AS review_count
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) x
    ON l_partkey = p_partkey),
users AS (
  SELECT c_custkey AS user_id, CAST(floor(greatest(c_acctbal, 0) / 100) AS BIGINT) AS fans,
         c_mktsegment AS segment, n AS review_count, a AS average_stars
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS a
                           FROM orders GROUP BY o_custkey) y ON o_custkey = c_custkey),
review AS (
  SELECT v.*, b.city, b.state, b.categories, b.is_open, b.stars AS business_stars,
         b.review_count AS business_review_count, u.fans AS user_fans,
         u.review_count AS user_review_count, u.average_stars AS user_average_stars, d.text
  FROM votes v LEFT JOIN business b ON v.business_id = b.business_id
  LEFT JOIN users u ON v.user_id = u.user_id LEFT JOIN documents d ON d.doc_id = v.review_id)"""


def sql(body: str, *ctes: str) -> str:
    """Comparison SQL over the review model: optional further CTEs and a SELECT."""
    return "WITH " + ",\n".join([REVIEW_CTES, *ctes]) + "\n" + body
