"""Queries of models, metrics and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kudoscope.catalog.base import documents, reviews, sql, table
from kudoscope.catalog.features import SPLIT_CTES, clean_tables, learned_lexicon, master_split
from kudoscope.catalog.registry import big, query, r6, tidy
from kudoscope.models import regression, text_models, weights
from kudoscope.operators import metrics, sentiment, tfidf
from kudoscope.plans import exploration, feature_matrix, sweep, training
from kudoscope.session import keep

# Predictions derived from the review model: many ties, no trained model needed.
PREDS_SQL = """preds AS (SELECT review_id, CAST(useful AS DOUBLE) AS y_true, CAST(funny AS DOUBLE) AS pred_a, 1.0 AS pred_b,
  (funny + 1.0) / (useful + funny + cool + 2) AS prob, CAST(useful > 0 AS INT) AS label,
  CAST((funny + 1.0) / (useful + funny + cool + 2) >= 0.5 AS INT) AS y_pred FROM review)"""


def predictions(spark, sf):
    total = F.col("useful") + F.col("funny") + F.col("cool")
    df = reviews(spark, sf).select(
        "review_id",
        F.col("useful").cast("double").alias("y_true"),
        F.col("funny").cast("double").alias("pred_a"),
        F.lit(1.0).alias("pred_b"),
        ((F.col("funny") + 1.0) / (total + 2)).alias("prob"),
        (F.col("useful") > 0).cast("int").alias("label"),
    )
    return df.withColumn("y_pred", (F.col("prob") >= 0.5).cast("int"))


@query("J1_mean_baseline", sql(f"SELECT {big('review_id')} AS review_id, {r6('(SELECT avg(useful) FROM review)')} AS pred_baseline_mean FROM review"))
def mean_baseline(spark, sf):
    df = reviews(spark, sf)
    return tidy(df.select("review_id", df.agg(F.avg("useful")).scalar().alias("pred_baseline_mean")))


@query("J2_linear_on_log", sql("""SELECT CAST(review_id AS BIGINT) AS review_id, (round(CAST(greatest(exp(a + b * cool) - 1, 0) AS DOUBLE), 4) + 0.0) AS pred_linear_log
FROM review CROSS JOIN (SELECT regr_slope(ln(1 + useful), cool) AS b, regr_intercept(ln(1 + useful), cool) AS a FROM review)"""))
def linear_log(spark, sf):
    df = reviews(spark, sf).withColumn("cool", F.col("cool").cast("double"))
    rows = feature_matrix.assemble(df, ["cool"])
    fitted = regression.fit(rows, "useful", ["cool"], regression.ModelSettings(("linear_log",), ("cool",)))
    return tidy(fitted.predict(rows, "useful", "review_id").select("review_id", "pred_linear_log"), 4)


@query("J6_balanced_weights", sql(f"SELECT {big('label')} AS label, {big('n')} AS n, {r6('total / (2.0 * n)')} AS weight FROM (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM preds GROUP BY label)", PREDS_SQL))
def balanced(spark, sf):
    return tidy(weights.class_weights(predictions(spark, sf), "label"))


def _log_metrics_sql(name: str, c: str) -> str:
    return f"""SELECT '{name}' AS model, {r6(f'avg(abs(ln(1 + y_true) - ln(1 + greatest({c}, 0))))')} AS mae_log1p,
  {r6(f'sqrt(avg(power(ln(1 + y_true) - ln(1 + greatest({c}, 0)), 2)))')} AS rmse_log1p,
  {r6("CASE WHEN stddev_pop(rp) > 0 THEN corr(rt, rp) END")} AS spearman FROM (SELECT *,
    rank() OVER (ORDER BY y_true) + (count(*) OVER (PARTITION BY y_true) - 1) / 2.0 AS rt,
    rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS rp FROM preds)"""


MODELS = {"a": "pred_a", "b": "pred_b", "p": "prob"}
LOG_METRICS_SQL = " UNION ALL ".join(_log_metrics_sql(m, c) for m, c in MODELS.items())


@query("J10_log_metrics", sql(LOG_METRICS_SQL, PREDS_SQL))
def log_metrics(spark, sf):
    return tidy(metrics.log_regression_metrics(predictions(spark, sf), "y_true", MODELS))


@query("J11_raw_metrics", sql(" UNION ALL ".join(
    f"""SELECT '{m}' AS model, {r6(f'avg(abs(y_true - {c}))')} AS mae, {r6(f'sqrt(avg(power(y_true - {c}, 2)))')} AS rmse,
  {r6(f'1 - avg(power(y_true - {c}, 2)) / var_pop(y_true)')} AS r2, {r6(f'median(abs(y_true - {c}))')} AS medae,
  {r6(f'1 - var_pop(y_true - {c}) / var_pop(y_true)')} AS explained_variance, {big('count(*)')} AS eval_rows FROM preds""" for m, c in MODELS.items()), PREDS_SQL))
def raw_metrics(spark, sf):
    return tidy(metrics.regression_metrics(predictions(spark, sf), "y_true", MODELS))


SCORES_SQL = """scores AS (SELECT prob, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM preds GROUP BY prob),
points AS (SELECT prob, pos, neg, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(neg) OVER u - neg AS below,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM scores
  WINDOW d AS (ORDER BY prob DESC ROWS UNBOUNDED PRECEDING), u AS (ORDER BY prob ROWS UNBOUNDED PRECEDING))"""


@query("J12_auc_and_average_precision", sql(f"SELECT {r6('sum(pos * (below + neg / 2.0)) / (max(p) * max(n))')} AS roc_auc, {r6('sum(pos * tp / (tp + fp)) / max(p)')} AS pr_auc FROM points", PREDS_SQL, SCORES_SQL))
def auc(spark, sf):
    return tidy(metrics.ranking_metrics(predictions(spark, sf), "label", "prob"))


@query("J13_label_metrics", sql(f"""SELECT {r6('(tp + tn) / n')} AS accuracy, {r6('2 * tp / (2 * tp + fp + fn)')} AS f1, {r6('tp / (tp + fp)')} AS precision,
  {r6('tp / (tp + fn)')} AS recall, {r6('(tp / (tp + fn) + tn / (tn + fp)) / 2')} AS balanced_accuracy, {big('n')} AS eval_rows
FROM (SELECT CAST(count(*) FILTER (label = 1 AND y_pred = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (label = 0 AND y_pred = 1) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (label = 1 AND y_pred = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (label = 0 AND y_pred = 0) AS DOUBLE) AS tn, count(*) AS n FROM preds)""", PREDS_SQL))
def label_metrics(spark, sf):
    return tidy(metrics.label_metrics(predictions(spark, sf), "label", "y_pred"))


@query("J14_confusion_matrix", sql(f"SELECT {big('label')} AS label, {big('y_pred')} AS y_pred, {big('count(*)')} AS n FROM preds GROUP BY label, y_pred", PREDS_SQL))
def confusion(spark, sf):
    return tidy(metrics.confusion(predictions(spark, sf), "label", "y_pred"))


@query("J15_curve_points", sql(f"""SELECT {r6('prob')} AS threshold, {big('tp')} AS tp, {big('fp')} AS fp, {r6('fp / n')} AS fpr, {r6('tp / p')} AS tpr,
  {r6('tp / (tp + fp)')} AS precision, {r6('tp / p')} AS recall FROM points""", PREDS_SQL, SCORES_SQL))
def curve_points(spark, sf):
    return tidy(metrics.curve_points(predictions(spark, sf), "label", "prob"))


# Continuous scores: every order has one of its own.
DENSE_SQL = """dense AS (SELECT o_totalprice AS s, CAST(o_orderstatus = 'F' AS INT) AS y FROM orders),
cells AS (SELECT s, sum(y) AS pos, count(*) - sum(y) AS neg FROM dense GROUP BY s),
curve AS (SELECT s, pos, neg, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, lead(pos) OVER (ORDER BY s DESC) AS pos2, lead(neg) OVER (ORDER BY s DESC) AS neg2,
  lag(pos) OVER (ORDER BY s DESC) AS pos0, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM cells WINDOW d AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"""


def dense_scores(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))


@query("J15_roc_curve_thinned", f"""WITH {DENSE_SQL} SELECT {r6('s')} AS threshold, {r6('fp / n')} AS fpr, {r6('tp / p')} AS tpr FROM curve WHERE pos0 IS NULL OR pos2 IS NULL OR pos <> pos2 OR neg <> neg2
UNION ALL SELECT CAST('Infinity' AS DOUBLE), 0.0, 0.0""")
def roc_curve(spark, sf):
    return tidy(metrics.roc_points(dense_scores(spark, sf), "label", "score"))


@query("J15_precision_recall_thinned", f"""WITH {DENSE_SQL} SELECT {r6('s')} AS threshold, {r6('tp / (tp + fp)')} AS precision, {r6('tp / p')} AS recall FROM curve
WHERE pos0 IS NULL OR pos2 IS NULL OR pos > 0 OR pos2 > 0""")
def precision_recall_curve(spark, sf):
    return tidy(metrics.precision_recall_points(dense_scores(spark, sf), "label", "score"))


def _calibration_sql(truth: str, score: str) -> str:
    cuts = ", ".join(f"{i / 10}" for i in range(11))
    return f"""SELECT {big('bin')} AS bin, {r6('avg(s)')} AS mean_pred, {r6('avg(t)')} AS mean_true, {big('count(*)')} AS n FROM (
  SELECT s, t, len(list_filter(list_slice(edges, 2, len(edges) - 1), lambda v: v < s)) AS bin
  FROM (SELECT CAST({score} AS DOUBLE) AS s, {truth} AS t FROM preds)
  CROSS JOIN (SELECT list_sort(list_distinct(quantile_cont(CAST({score} AS DOUBLE), [{cuts}]))) AS edges FROM preds)) GROUP BY bin"""


@query("J16_calibration_class", sql(_calibration_sql("label", "prob"), PREDS_SQL))
def calibration_class(spark, sf):
    return tidy(metrics.calibration(predictions(spark, sf), "label", "prob"))


@query("J16_calibration_regression", sql(_calibration_sql("y_true", "pred_a"), PREDS_SQL))
def calibration_regression(spark, sf):
    return tidy(metrics.calibration(predictions(spark, sf), "y_true", "pred_a"))


@query("J17_residuals", sql(f"SELECT {big('review_id')} AS review_id, {r6('y_true - pred_a')} AS residual, {r6('ln(1 + y_true) - ln(1 + pred_a)')} AS residual_log1p FROM preds", PREDS_SQL))
def residuals(spark, sf):
    return tidy(metrics.residuals(predictions(spark, sf), "y_true", "pred_a").select("review_id", "residual", "residual_log1p"))


@query("J18_best_model", sql(f"SELECT * FROM ({LOG_METRICS_SQL}) ORDER BY rmse_log1p, model LIMIT 1", PREDS_SQL))
def best_model(spark, sf):
    return tidy(metrics.best_model(metrics.log_regression_metrics(predictions(spark, sf), "y_true", MODELS)))


# ---- trained models (no SQL equivalent) ---------------------------------------------------


def _numeric_tables(spark, sf):
    train, held = master_split(spark, sf)
    drop = ("user_id", "business_id")
    return feature_matrix.feature_tables(train.drop(*drop), held.drop(*drop), feature_matrix.FeatureSettings())


@query("J3_J4_J5_J19_model_comparison")
def model_comparison(spark, sf):
    """Metrics of all five models on the evaluation side of the split."""
    run = training.compare_models(_numeric_tables(spark, sf), regression.ModelSettings())
    return tidy(run.metrics)


@query("J19_predictions_table")
def predictions_table(spark, sf):
    run = training.compare_models(
        _numeric_tables(spark, sf), regression.ModelSettings(("baseline_mean", "linear_log", "hurdle"))
    )
    return tidy(run.predictions)


@query("J3_poisson_group_means", sql("SELECT (round(m, 4) + 0.0) AS pred_poisson, CAST(sum(n) AS BIGINT) AS n FROM (SELECT avg(useful) AS m, count(*) AS n FROM review GROUP BY stars <= 2) GROUP BY 1"))
def poisson_means(spark, sf):
    """On one 0/1 feature the Poisson fit predicts the mean of each group."""
    df = reviews(spark, sf).withColumn("few_stars", (F.col("stars") <= 2).cast("double"))
    rows = feature_matrix.assemble(df, ["few_stars"])
    fitted = regression.fit(rows, "useful", ["few_stars"], regression.ModelSettings(("poisson",), ("few_stars",)))
    preds = tidy(fitted.predict(rows, "useful", "review_id").select("pred_poisson"), 4)
    return preds.groupBy("pred_poisson").agg(F.count("*").alias("n"))


@query("J3_wide_poisson_group_means", sql("SELECT (round(m, 4) + 0.0) AS pred_poisson, CAST(sum(n) AS BIGINT) AS n FROM (SELECT avg(useful) AS m, count(*) AS n FROM review GROUP BY stars) GROUP BY 1"))
def wide_poisson_means(spark, sf):
    """The sparse fit on vectors wider than the least-squares solver takes: one entry
    for each number of stars among 5,000."""
    from pyspark.ml.feature import OneHotEncoder

    df = reviews(spark, sf).withColumn("at", F.col("stars") * 900)
    encoder = OneHotEncoder(inputCol="at", outputCol="features", dropLast=False)
    # a last category far off sets the width
    fitted_on = df.select("at").union(spark.range(1).select(F.lit(4999).alias("at")))
    rows = encoder.fit(fitted_on).transform(df)
    fitted = regression.fit(rows, "useful", ["stars"], regression.ModelSettings(("poisson",), ("stars",)))
    preds = tidy(fitted.predict(rows, "useful", "review_id").select("pred_poisson"), 4)
    return preds.groupBy("pred_poisson").agg(F.count("*").alias("n"))


@query("J4_boosted_beats_the_mean", sql(f"SELECT {big('count(*)')} AS rows, {big('count(*)')} AS finite, {big('1')} AS beats_mean FROM held", *SPLIT_CTES))
def boosted(spark, sf):
    """Boosted trees at their defaults, on votes with a known signal (each cool vote counts
    twice more): every evaluation row has a finite score, and the error on the log scale
    is below that of the mean."""
    signal = F.col("useful") + 2 * F.col("cool")
    train, held = (
        feature_matrix.assemble(
            side.select("review_id", signal.alias("votes"), *[F.col(c).cast("double").alias(c) for c in ("cool", "stars")]), ["cool", "stars"])
        for side in master_split(spark, sf)
    )
    fitted = regression.fit(train, "votes", ["cool", "stars"], regression.ModelSettings(("baseline_mean", "boosted"), ("cool",)))
    preds = keep(fitted.predict(held, "votes", "review_id"))
    table = metrics.log_regression_metrics(preds, "y_true", fitted.model_columns())
    error = table.groupBy().pivot("model", ["boosted", "baseline_mean"]).agg(F.first("rmse_log1p"))
    beats = error.select(F.col("boosted") < F.col("baseline_mean")).scalar()
    return tidy(preds.agg(
        F.count("*").alias("rows"), F.count_if(metrics.finite(F.col("pred_boosted"))).alias("finite")
    ).withColumn("beats_mean", beats))


@query("J5_hurdle_size", sql("""SELECT CAST(review_id AS BIGINT) AS review_id, (round(CAST(greatest(exp(a + b * cool) - 1, 0) AS DOUBLE), 4) + 0.0) AS size
FROM review CROSS JOIN (SELECT regr_slope(ln(1 + useful), cool) AS b, regr_intercept(ln(1 + useful), cool) AS a FROM review WHERE useful > 0)"""))
def hurdle_size(spark, sf):
    """The size part of the hurdle is a line through the reviews with votes."""
    df = reviews(spark, sf).withColumn("cool", F.col("cool").cast("double"))
    rows = feature_matrix.assemble(df, ["cool"])
    fitted = regression.fit(rows, "useful", ["cool"], regression.ModelSettings(("hurdle",), ("cool",)))
    preds = fitted.predict(rows, "useful", "review_id")
    return tidy(preds.select("review_id", (F.col("pred_hurdle") / F.col("pred_hurdle_prob")).alias("size")), 4)


@query("J8_scores_of_margins", sql(f"""SELECT {big('review_id')} AS review_id, {r6('1 / (1 + exp(CAST(cool - funny AS DOUBLE)))')} AS y_proba, {big('funny >= cool')} AS y_pred FROM review"""))
def margin_scores(spark, sf):
    """Scores of a classifier that only gives margins: their sigmoid, cut at one half."""
    from pyspark.ml.functions import array_to_vector

    margin = (F.col("funny") - F.col("cool")).cast("double")
    df = reviews(spark, sf).select("review_id", array_to_vector(F.array(-margin, margin)).alias("rawPrediction"))
    return tidy(text_models.with_labels(df).select("review_id", "y_proba", "y_pred"))


@query("J8_scores_of_probabilities", sql(f"""SELECT {big('review_id')} AS review_id, {r6('(funny + 1.0) / (funny + cool + 2.0)')} AS y_proba, {big('funny >= cool')} AS y_pred FROM review"""))
def probability_scores(spark, sf):
    """Scores of a classifier with probabilities: that of the positive class."""
    from pyspark.ml.functions import array_to_vector

    p = (F.col("funny") + 1.0) / (F.col("funny") + F.col("cool") + 2.0)
    df = reviews(spark, sf).select("review_id", array_to_vector(F.array(1 - p, p)).alias("probability"))
    return tidy(text_models.with_labels(df).select("review_id", "y_proba", "y_pred"))


@query("J19_mean_and_linear_predictions", sql("""SELECT CAST(review_id AS BIGINT) AS review_id, (round(CAST(useful AS DOUBLE), 4) + 0.0) AS y_true, (round(m, 4) + 0.0) AS pred_baseline_mean,
  (round(CAST(greatest(exp(a + b * cool) - 1, 0) AS DOUBLE), 4) + 0.0) AS pred_linear_log
FROM held CROSS JOIN (SELECT avg(useful) AS m, regr_slope(ln(1 + useful), cool) AS b, regr_intercept(ln(1 + useful), cool) AS a FROM train)""", *SPLIT_CTES))
def mean_and_linear(spark, sf):
    """Predictions table of the evaluation side, fitted on the training side."""
    run = training.compare_models(
        _numeric_tables(spark, sf), regression.ModelSettings(("baseline_mean", "linear_log"), small_features=("cool",)))
    return tidy(run.predictions, 4)


def _text_rows(spark, sf):
    docs = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return docs.select("doc_id", "text", F.col("n_chars").alias("review_char_len"),
                       F.col("quality").alias("target_is_useful"), (F.length("text") / 100).cast("int").alias("target_useful_votes"))


CLASSIFIERS = ("logreg", "svc", "rf")


@query("J7_J8_J9_text_classifiers", " UNION ALL ".join(
    f"SELECT '{text_models.model_name(text_models.BINARY_TARGET, 'text_tfidf', k)}' AS model, {big('count(*)')} AS eval_rows, {big('1')} AS within_bounds, {big('1')} AS better_than_chance FROM labels JOIN documents USING (doc_id)"
    for k in CLASSIFIERS))
def text_classifiers(spark, sf):
    """Logistic regression, linear SVC and random forest at the library's settings:
    every row is scored, every measure lies in its bounds, and each model is better in
    sample than a constant answer."""
    rows = keep(_text_rows(spark, sf))
    fitted = tfidf.fit_tfidf(rows, "text", text_models.MODEL_TERMS)
    runs = training.train_models(rows, text_models.BINARY_TARGET, CLASSIFIERS, "text_tfidf", "doc_id", fitted=fitted)
    out = [run.metrics.withColumn("model", F.lit(run.name)) for run in runs]
    measures = ("accuracy", "f1", "precision", "recall", "balanced_accuracy", "roc_auc", "average_precision")
    inside = F.lit(True)
    for m in measures:
        inside = inside & F.col(m).between(0, 1)
    table = out[0].unionByName(out[1]).unionByName(out[2])
    return tidy(table.select(
        "model", "eval_rows", inside.alias("within_bounds"),
        ((F.col("balanced_accuracy") > 0.5) & (F.col("roc_auc") > 0.5)).alias("better_than_chance")))


@query("J9_J13_count_regressor", f"""SELECT {big('count(*) FILTER (length(text) >= 100)')} AS eval_rows, {big('1')} AS finite, {big('1')} AS beats_mean
FROM labels JOIN documents USING (doc_id)""")
def count_regressor(spark, sf):
    """Random forest on terms and numbers at the library's settings; rows without votes
    are left out.  In sample it explains more than the mean does."""
    run = training.train_model(
        keep(_text_rows(spark, sf)), text_models.COUNT_TARGET, "random_forest_regressor", "text_tfidf_plus_numeric", "doc_id")
    good = metrics.finite(F.col("mae")) & metrics.finite(F.col("rmse")) & metrics.finite(F.col("medae"))
    return tidy(run.metrics.select("eval_rows", good.alias("finite"), (F.col("r2") > 0).alias("beats_mean")))


@query("J20_scenario_sweep")
def scenario_sweep(spark, sf):
    """The four default scenarios, 3,000 terms among them."""
    train, held = master_split(spark, sf)
    drop = ("user_id", "business_id")
    base = sweep.RunSettings(models=regression.ModelSettings(("baseline_mean", "linear_log", "hurdle")))
    docs = documents(spark, sf).select(F.col("doc_id").alias("review_id"), "text")
    scores = sentiment.lexicon_scores(docs, "review_id", "text", learned_lexicon(spark, sf))
    table = sweep.sweep(train.drop(*drop), held.drop(*drop), base, sweep.DEFAULT_SCENARIOS, scores)
    return tidy(table.drop("finished_at", "overrides"))


@query("J20_sweep_of_means_and_lines", sql(
    " UNION ALL ".join(
        f"SELECT '{name}' AS scenario, 'linear_log' AS best_model, {r6(f'sqrt(avg(power(ln(1 + useful) - ln(1 + greatest(exp(a + b * cool) - 1, 0)), 2)))')} AS rmse_log1p "
        f"FROM held{k} CROSS JOIN (SELECT regr_slope(ln(1 + useful), cool) AS b, regr_intercept(ln(1 + useful), cool) AS a FROM train{k}) GROUP BY a, b"
        for name, k in (("all", 0), ("seen", 3), ("all_with_scores", 0))),
    *SPLIT_CTES,
    *[f"{side}{k} AS (SELECT * FROM {side} WHERE useful + funny + cool >= {k})" for side in ("train", "held") for k in (0, 3)]))
def sweep_of_lines(spark, sf):
    """Best model and error of scenarios that SQL can fit; those over the same rows share their stages."""
    train, held = master_split(spark, sf)
    drop = ("user_id", "business_id")
    base = sweep.RunSettings(models=regression.ModelSettings(("baseline_mean", "linear_log"), small_features=("cool",)))
    scenarios = {"all": {"min_total_votes": 0}, "seen": {"min_total_votes": 3}, "all_with_scores": {"features.include_sentiment": True}}
    scores = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("review_id")).agg(F.avg("quality").alias("sentiment_compound"))
    found = sweep.sweep(train.drop(*drop), held.drop(*drop), base, scenarios, scores)
    return tidy(found.select("scenario", "best_model", "rmse_log1p"))


# ---- exploratory report, by part ------------------------------------------------------------


def _report(spark, sf):
    r, b, u = clean_tables(spark, sf)
    return exploration.report_tables(exploration.report_base(r, b, u))


@query("J23_report_by_city", sql(f"""SELECT city, {r6('avg(useful)')} AS mean, {r6('median(useful)')} AS median, {big('count(*)')} AS n FROM c
WHERE city IN (SELECT city FROM c GROUP BY city ORDER BY count(*) DESC, city LIMIT 15) GROUP BY city""",
    "c AS (SELECT coalesce(city, 'Unknown') AS city, useful FROM review)"))
def report_city(spark, sf):
    return tidy(_report(spark, sf)["by_city"])


@query("J23_report_summary", sql(f"""SELECT 'helpful' AS "column", {big('count(*)')} AS count, {r6('avg(useful)')} AS mean, {r6('stddev_samp(useful)')} AS std, {r6('min(useful)')} AS min,
  {r6('quantile_cont(useful, 0.25)')} AS p25, {r6('quantile_cont(useful, 0.5)')} AS p50, {r6('quantile_cont(useful, 0.75)')} AS p75, {r6('max(useful)')} AS max FROM review"""))
def report_summary(spark, sf):
    return tidy(_report(spark, sf)["helpful_summary"])
