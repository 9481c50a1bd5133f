"""Queries of readers, writers and jobs over files.

The given tables are written as raw JSON lines (or parquet shards) to a new
work folder and read back, so the file scans themselves are exercised.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kudoscope.catalog.base import business, reviews, sql, table, users, with_text
from kudoscope.catalog.cleaning import RAW_REVIEWS, raw_reviews
from kudoscope.catalog.features import SPLIT_CTES
from kudoscope.catalog.models import _text_rows
from kudoscope.catalog.registry import big, query, r6, tidy
from kudoscope.models import regression, text_models
from kudoscope.operators import clean, reshape, sampling
from kudoscope.plans import end_to_end, feature_matrix, master, sweep, training
from kudoscope.schemas import BUSINESS_RAW, REVIEWS_RAW
from kudoscope.session import keep, work_folder
from kudoscope.sources import files, ingest, readers, sinks


def raw_users(spark, sf):
    u = users(spark, sf)
    return u.select(
        F.col("user_id").cast("string"),
        F.col("review_count").cast("string"),
        F.col("fans").cast("string"),
        F.col("average_stars").cast("string"),
        F.lit("None").alias("elite"),
    )


def raw_business(spark, sf):
    b = business(spark, sf)
    return b.select(
        F.col("business_id").cast("string"), "name", "city", "state", "categories",
        F.col("stars").cast("string"), F.col("review_count").cast("string"), F.col("is_open").cast("string"),
        F.create_map(F.lit("WiFi"), F.lit("free")).alias("attributes"),
    )


def clean_raw_reviews(spark, sf):
    """Raw reviews of the whole review model (texts where there is one)."""
    df = with_text(reviews(spark, sf), spark, sf)
    return df.select(
        F.col("review_id").cast("string"), F.col("user_id").cast("string"), F.col("business_id").cast("string"),
        F.col("stars").cast("string"), F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"),
        F.coalesce("text", F.lit("no text was given")).alias("text"),
        *[F.col(c).cast("string") for c in ("useful", "funny", "cool")],
    )


@query("A1_find_raw_files", f"""SELECT 'business' AS dataset, {big('count(*)')} AS rows FROM part UNION ALL SELECT 'reviews', {big('count(*)')} FROM orders
UNION ALL SELECT 'users', {big('count(*)')} FROM customer UNION ALL SELECT 'tips', {big('0')}""")
def find_files(spark, sf):
    """Rows behind the files found: one dataset in a folder of its own, two
    under their flat names, one absent."""
    root = work_folder(spark)
    raw_users(spark, sf).write.json(f"{root}/users")
    raw_business(spark, sf).write.json(f"{root}/yelp_academic_dataset_business.json")
    clean_raw_reviews(spark, sf).write.option("compression", "gzip").json(f"{root}/yelp_academic_dataset_review.json.gz")
    found = files.find_raw_files(spark, root, ["review", "Businesses", "user", "tip"])
    lines = None
    for name, paths in found.items():
        read = spark.read.text(paths) if paths else spark.createDataFrame([], "value string")
        counted = read.agg(F.lit(name).alias("dataset"), F.count("*").alias("rows"))
        lines = counted if lines is None else lines.unionByName(counted)
    return tidy(lines)


@query("A2_json_lines_scan", f"""WITH {RAW_REVIEWS}
SELECT review_id, user_id, business_id, stars, date, text, useful, funny, cool FROM raw""")
def json_lines(spark, sf):
    path = f"{work_folder(spark)}/reviews"
    raw_reviews(spark, sf).write.option("compression", "gzip").json(path)
    return readers.read_json_lines(spark, path, REVIEWS_RAW)


@query("A2_bad_json_lines", f"""SELECT {big('count(*)')} AS rows, {big("count(*) FILTER (o_orderstatus = 'P')")} AS bad, {big("count(*) FILTER (o_orderstatus <> 'P')")} AS good FROM orders""")
def bad_lines(spark, sf):
    """Lines of open orders are not JSON; they are read as rows of nulls."""
    path = f"{work_folder(spark)}/lines"
    o = table(spark, sf, "orders")
    line = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("{bad "), F.col("o_orderpriority"))).otherwise(
        F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("review_id")))
    )
    o.select(line.alias("value")).write.text(path)
    df = readers.read_json_lines(spark, path, REVIEWS_RAW, keep_bad=True)
    return tidy(df.select("review_id", readers.BAD_RECORD).agg(
        F.count("*").alias("rows"), F.count_if(F.col(readers.BAD_RECORD).isNotNull()).alias("bad"),
        F.count("review_id").alias("good")))


@query("A3_A4_ingest_and_read_shards", sql(f"SELECT CAST(business_id AS VARCHAR) AS business_id, name, city, state, {big('review_count')} AS review_count FROM business"))
def ingest_shards(spark, sf):
    """Several raw files to shards, run twice (the second run finds nothing to do)."""
    root = work_folder(spark)
    raw_business(spark, sf).repartition(3, "business_id").write.json(f"{root}/raw/business")
    first = ingest.ingest(spark, f"{root}/raw", f"{root}/parquet", ["business"], rows_per_file=500)
    again = ingest.ingest(spark, f"{root}/raw", f"{root}/parquet", ["business"])
    if not first["business"] or again["business"]:
        raise AssertionError("a shard was missed or converted twice")
    df = readers.read_shards(spark, "business", f"{root}/parquet")
    return df.select("business_id", "name", "city", "state", F.col("review_count").cast("bigint").alias("review_count"))


@query("A4_union_of_shards", sql(f"""SELECT CAST(business_id AS VARCHAR) AS business_id, CASE WHEN {{0}} THEN name END AS name, {big('CASE WHEN NOT {0} THEN stars END')} AS stars
FROM business""").replace("{0}", "is_open = 1"))
def union_shards(spark, sf):
    """Shards with different columns are merged by name."""
    root = work_folder(spark)
    b = business(spark, sf, counts=False).withColumn("business_id", F.col("business_id").cast("string"))
    b.where("is_open = 1").select("business_id", "name").write.parquet(f"{root}/business/a.parquet")
    b.where("is_open <> 1").select("business_id", "stars").write.parquet(f"{root}/business/b.parquet")
    return tidy(readers.read_shards(spark, "business", root).select("business_id", "name", "stars"))


@query("A6_matching_json", sql("""SELECT CAST(business_id AS VARCHAR) AS business_id, city, categories FROM business
WHERE business_id IN (SELECT business_id FROM votes WHERE useful >= 5)"""))
def matching_json(spark, sf):
    path = f"{work_folder(spark)}/business"
    raw_business(spark, sf).write.json(path)
    ids = reviews(spark, sf).where("useful >= 5").select(F.col("business_id").cast("string"))
    return readers.read_matching_json(spark, path, BUSINESS_RAW, "business_id", ids, ["business_id", "city", "categories"])


@query("A8_A9_fallback_tables", sql(f"SELECT CAST(user_id AS VARCHAR) AS user_id, {big('fans')} AS fans, {big('CAST(0 AS BIGINT)')} AS is_elite_ever FROM users"))
def fallback_tables(spark, sf):
    """A cleaned table under its older name, found by the resolver."""
    root = work_folder(spark)
    sinks.write_parquet(clean.clean_users(raw_users(spark, sf)), f"{root}/users.parquet", max_rows=1000)
    if readers.read_clean(spark, "reviews", root) is not None:
        raise AssertionError("found a table that does not exist")
    if not readers.resolve_dataset(spark, root, "absent.parquet").endswith("users.parquet"):
        raise AssertionError("the fallback was not taken")
    df = readers.read_clean(spark, "users", root)
    return tidy(df.select("user_id", "fans", "is_elite_ever"))


@query("A10_summary_sink", sql(f"SELECT city, {big('count(*)')} AS n FROM business GROUP BY city"))
def summary_sink(spark, sf):
    """A small report written as CSV and JSON lines and read back from both."""
    root = work_folder(spark)
    report = business(spark, sf, counts=False).groupBy("city").agg(F.count("*").alias("n"))
    csv, jsonl = sinks.write_summary(report, f"{root}/summary")
    a = spark.read.option("header", True).schema("city string, n bigint").csv(csv)
    b = spark.read.schema("city string, n bigint").json(jsonl)
    return a.join(b, ["city", "n"])


@query("A11_feature_record", f"SELECT 'target_useful_votes' AS target, 'review_id' AS join_keys, {big('count(DISTINCT p_brand)')} AS cities, {big('count(DISTINCT p_brand) + 2')} AS features FROM part")
def feature_record(spark, sf):
    df = reviews(spark, sf).join(business(spark, sf, counts=False).select("business_id", "city"), "business_id", "left")
    df = df.select("review_id", "funny", "cool", "city", F.col("useful").alias("target_useful_votes"))
    tables = feature_matrix.feature_tables(df, df)
    path = sinks.write_json(tables.record(), f"{work_folder(spark)}/feature_schema.json")
    row = spark.read.json(path)
    return tidy(row.select("target", F.array_join("join_keys", ",").alias("join_keys"),
                           F.size("one_hot_maps.city").alias("cities"), F.size("feature_order").alias("features")))


@query("B18_capped_clean", f"SELECT {big('100')} AS rows")
def capped(spark, sf):
    rows = clean.cap_rows(clean_raw_reviews(spark, sf), 100)
    return tidy(clean.clean_reviews(rows.withColumn("business_id", F.coalesce("business_id", F.lit("-")))).agg(F.count("*").alias("rows")))


@query("J21_score_saved_model", f"SELECT {big('count(*)')} AS scored FROM labels JOIN documents USING (doc_id)")
def score_saved(spark, sf):
    """A model saved and loaded again scores every row."""
    folder = work_folder(spark)
    rows = _text_rows(spark, sf)
    run = training.train_model(rows, text_models.BINARY_TARGET, "logreg", "text_tfidf_plus_numeric", "doc_id", folder=folder)
    preds, _ = training.evaluate_saved(spark, f"{folder}/{run.name}", rows, text_models.BINARY_TARGET, "doc_id")
    return tidy(preds.agg(F.count_if(F.col("y_proba").between(0, 1)).alias("scored")))


@query("J21_held_out_metrics", f"""SELECT {big('ceil(count(*) * 0.2)')} AS eval_rows, {big('1')} AS metrics_equal, {big('1')} AS better_than_chance
FROM labels JOIN documents USING (doc_id)""")
def held_out_metrics(spark, sf):
    """A saved model scores rows that it was not fitted on; its metrics are those that
    plain aggregates over its predictions give."""
    folder = work_folder(spark)
    # the split is made once: all passes over its sides read kept rows
    marked = keep(sampling.mark_evaluation(_text_rows(spark, sf), 0.2, "doc_id", text_models.BINARY_TARGET))
    train, held = master.sides_of(marked)
    run = training.train_model(train, text_models.BINARY_TARGET, "logreg", "text_tfidf", "doc_id", folder=folder)
    preds, found = training.evaluate_saved(spark, f"{folder}/{run.name}", held, text_models.BINARY_TARGET, "doc_id")
    hit = (F.col("y_true") == F.col("y_pred")).cast("double")
    own = preds.agg(F.struct(
        F.avg(hit).alias("accuracy"), F.avg(F.when(F.col("y_true") == 1, hit)).alias("recall"),
        F.avg(F.when(F.col("y_pred") == 1, hit)).alias("precision")).alias("o"))
    table = found.withColumn("o", own.scalar())
    same = F.lit(True)
    for m in ("accuracy", "recall", "precision"):
        same = same & (F.abs(F.col(m) - F.coalesce(F.col(f"o.{m}"), F.lit(0.0))) < 1e-9)
    return tidy(table.select("eval_rows", same.alias("metrics_equal"), (F.col("roc_auc") > 0.5).alias("better_than_chance")))


@query("J22_raw_files_to_metrics")
def raw_to_metrics(spark, sf):
    """Ingest, clean, assemble, build features, model: one application."""
    root = work_folder(spark)
    raw_users(spark, sf).write.json(f"{root}/raw/users")
    raw_business(spark, sf).write.json(f"{root}/raw/business")
    clean_raw_reviews(spark, sf).write.json(f"{root}/raw/reviews")
    settings = sweep.RunSettings(models=regression.ModelSettings(("baseline_mean", "linear_log", "hurdle")))
    done = end_to_end.run(spark, f"{root}/raw", f"{root}/work", settings=settings)
    return tidy(done["metrics"])


def _log_row(model: str) -> str:
    """Log-scale metrics of a column of ``preds`` in SQL."""
    return f"""SELECT '{model}' AS model, {r6(f'avg(abs(ln(1 + y_true) - ln(1 + {model})))')} AS mae_log1p,
  {r6(f'sqrt(avg(power(ln(1 + y_true) - ln(1 + {model}), 2)))')} AS rmse_log1p, {r6("CASE WHEN stddev_pop(rp) > 0 THEN corr(rt, rp) END")} AS spearman,
  CAST(NULL AS DOUBLE) AS roc_auc, CAST(NULL AS DOUBLE) AS pr_auc FROM (SELECT *,
    rank() OVER (ORDER BY y_true) + (count(*) OVER (PARTITION BY y_true) - 1) / 2.0 AS rt,
    rank() OVER (ORDER BY {model}) + (count(*) OVER (PARTITION BY {model}) - 1) / 2.0 AS rp FROM preds)"""


@query("J22_raw_to_metrics_of_mean_and_line", sql(
    " UNION ALL ".join(_log_row(m) for m in ("baseline_mean", "linear_log")),
    "labelled AS (SELECT *, CAST(useful > 0 AS INT) AS y FROM review WHERE business_id IS NOT NULL AND length(coalesce(text, 'no text was given')) >= 10)",
    SPLIT_CTES[1],
    """preds AS (SELECT CAST(useful AS DOUBLE) AS y_true, m AS baseline_mean, greatest(exp(a + b * cool) - 1, 0) AS linear_log
FROM held CROSS JOIN (SELECT avg(useful) AS m, regr_slope(ln(1 + useful), cool) AS b, regr_intercept(ln(1 + useful), cool) AS a FROM train))"""))
def raw_to_compared_metrics(spark, sf):
    """From raw files to the metrics of the two models that SQL can fit."""
    root = work_folder(spark)
    raw_users(spark, sf).write.json(f"{root}/raw/users")
    raw_business(spark, sf).write.json(f"{root}/raw/business")
    clean_raw_reviews(spark, sf).write.json(f"{root}/raw/reviews")
    models = regression.ModelSettings(("baseline_mean", "linear_log"), small_features=("cool",))
    done = end_to_end.run(spark, f"{root}/raw", f"{root}/work", settings=sweep.RunSettings(models=models))
    return tidy(done["metrics"])


@query("J22_clean_to_split", sql(f"SELECT {big('count(*)')} AS rows, {big('count(city)')} AS with_city, {big('sum(useful)')} AS useful FROM review WHERE business_id IS NOT NULL AND length(coalesce(text, 'no text was given')) >= 10"))
def clean_to_split(spark, sf):
    """The stages before modelling, features and models skipped."""
    root = work_folder(spark)
    raw_users(spark, sf).write.json(f"{root}/raw/users")
    raw_business(spark, sf).write.json(f"{root}/raw/business")
    clean_raw_reviews(spark, sf).write.json(f"{root}/raw/reviews")
    done = end_to_end.run(spark, f"{root}/raw", f"{root}/work", build_features=False, model=False)
    train, held = done["datasets"]
    both = reshape.union_by_name(train, held)
    return tidy(both.agg(F.count("*").alias("rows"), F.count("city").alias("with_city"), F.sum("useful").alias("useful")))
