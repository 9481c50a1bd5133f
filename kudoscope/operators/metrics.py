"""Evaluation measures as aggregations over a predictions table.

Curves and ranks come from per-score counts (see ``ranks``): no sort of all
rows in one task, and tied scores are handled exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kudoscope.operators import ranks
from kudoscope.operators.correlation import grouped_spearman

INF = float("inf")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INF)


def by_model(preds: DataFrame, y: str, models: dict[str, str]) -> DataFrame:
    """Long predictions ``model``, ``y``, ``pred``, ``positive``; finite values only."""
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                F.col(y).cast("double").alias("y"),
                F.col(c).cast("double").alias("pred"),
            )
            for m, c in models.items()
        ]
    )
    long = preds.select(F.inline(rows))
    return long.where(finite(F.col("y")) & finite(F.col("pred")))


def _every_model(spark, models: Sequence[str]) -> DataFrame:
    names = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(m).alias("model")) for i, m in enumerate(models)])
    return spark.range(1).select(F.inline(names))


def log_regression_metrics(
    preds: DataFrame, y: str, models: dict[str, str], discrete: bool = False
) -> DataFrame:
    """MAE and RMSE on the log1p scale and Spearman, one row per model.

    Predictions below zero count as zero; a model without a finite pair, or
    with constant predictions (Spearman), gets nulls.
    """
    long = by_model(preds, y, models).withColumn("pred", F.greatest("pred", F.lit(0.0)))
    gap = F.log1p("y") - F.log1p("pred")
    errors = long.groupBy("model").agg(
        F.avg(F.abs(gap)).alias("mae_log1p"),
        F.sqrt(F.avg(gap * gap)).alias("rmse_log1p"),
    )
    rank = grouped_spearman(long, ["model"], "y", "pred", discrete).select(
        "model", F.col("correlation").alias("spearman")
    )
    return (
        _every_model(preds.sparkSession, list(models))
        .join(errors, "model", "left")
        .join(rank, "model", "left")
        .select("model", "mae_log1p", "rmse_log1p", "spearman")
    )


def regression_metrics(preds: DataFrame, y: str, models: dict[str, str]) -> DataFrame:
    """MAE, RMSE, R2, median absolute error and explained variance per model."""
    long = by_model(preds, y, models)
    err = F.col("y") - F.col("pred")
    sums = long.groupBy("model").agg(
        F.avg(F.abs(err)).alias("mae"),
        F.avg(err * err).alias("_mse"),
        F.var_pop("y").alias("_var_y"),
        F.var_pop(err).alias("_var_e"),
        F.count("*").alias("eval_rows"),
    )
    long = long.withColumn("_abs", F.abs(err))
    median = ranks.quantiles(long, "_abs", [0.5], ["medae"], ["model"])

    def explained(rest: str) -> Column:
        # a constant truth: perfect when nothing is left over, else 0
        return F.when(
            F.col("_var_y") > 0, 1 - F.col(rest) / F.nullif("_var_y", F.lit(0.0))
        ).otherwise(F.when(F.col(rest) == 0, F.lit(1.0)).otherwise(F.lit(0.0)))

    return sums.join(median, "model").select(
        "model",
        "mae",
        F.sqrt("_mse").alias("rmse"),
        explained("_mse").alias("r2"),
        "medae",
        explained("_var_e").alias("explained_variance"),
        "eval_rows",
    )


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score: ``pos``, ``neg`` and how many lie at or above it."""
    hit = F.col(label).cast("int")
    freq = (
        df.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(
            F.sum(F.when(hit == 1, 1).otherwise(0)).alias("pos"),
            F.sum(F.when(hit == 1, 0).otherwise(1)).alias("neg"),
        )
    )
    cum = ranks.running_total(freq, "score", ["pos", "neg"])
    return cum.withColumns(
        {
            "tp": F.col("pos_all") - F.col("pos_upto") + F.col("pos"),
            "fp": F.col("neg_all") - F.col("neg_upto") + F.col("neg"),
        }
    )


def ranking_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: ``roc_auc`` (ties count half) and ``pr_auc`` (step sum).

    Both are null when there is only one class.
    """
    c = score_counts(df, label, score)
    below = F.col("neg_upto") - F.col("neg") / F.lit(2.0)
    sums = c.agg(
        F.max("pos_all").alias("p"),
        F.max("neg_all").alias("n"),
        F.sum(F.col("pos") * below).alias("wins"),
        F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("steps"),
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return sums.select(
        F.when(both, F.col("wins") / F.when(both, F.col("p") * F.col("n"))).alias("roc_auc"),
        F.when(both, F.col("steps") / F.when(both, F.col("p"))).alias("pr_auc"),
    )


def curve_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC and precision-recall points, one per distinct score used as threshold."""
    c = score_counts(df, label, score)
    p = F.when(F.col("pos_all") > 0, F.col("pos_all"))
    n = F.when(F.col("neg_all") > 0, F.col("neg_all"))
    return c.select(
        F.col("score").alias("threshold"),
        F.col("tp").cast("bigint").alias("tp"),
        F.col("fp").cast("bigint").alias("fp"),
        (F.col("fp") / n).alias("fpr"),
        (F.col("tp") / p).alias("tpr"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / p).alias("recall"),
    )


def _thinned(c: DataFrame, drop: Column) -> DataFrame:
    """Points of a curve from its counts per score, without those that ``drop``
    names and that are no end; ``lower``/``higher`` are the counts beside them."""
    near = ranks.with_neighbours(c, "score", ["pos", "neg"])
    ends = F.col("lower").isNull() | F.col("higher").isNull()
    return near.where(ends | ~drop)


def roc_points(df: DataFrame, label: str, score: str, thin: bool = True) -> DataFrame:
    """``threshold``, ``fpr``, ``tpr`` of the ROC curve.

    ``thin`` leaves out points whose step equals the next one (the curve is
    straight there, its area unchanged): a few rows in place of one per score.
    The starting point (0, 0) is added with an infinite threshold; a rate without a
    denominator is null."""
    c = score_counts(df, label, score)
    points = _thinned(c, (F.col("pos") == F.col("lower.pos")) & (F.col("neg") == F.col("lower.neg"))) if thin else c
    p, n = F.nullif("pos_all", F.lit(0)), F.nullif("neg_all", F.lit(0))
    curve = points.select(F.col("score").alias("threshold"), (F.col("fp") / n).alias("fpr"), (F.col("tp") / p).alias("tpr"))
    sums = c.agg(F.max("pos_all").alias("p"), F.max("neg_all").alias("n"))
    start = sums.where("p is not null").select(
        F.lit(INF).alias("threshold"),
        F.when(F.col("n") > 0, 0.0).alias("fpr"),
        F.when(F.col("p") > 0, 0.0).alias("tpr"),
    )
    return curve.unionByName(start)


def precision_recall_points(df: DataFrame, label: str, score: str, thin: bool = True) -> DataFrame:
    """``threshold``, ``precision``, ``recall`` per score.

    ``thin`` leaves out the inner points of every stretch without a further hit:
    there recall stands still, so the step sum is unchanged."""
    c = score_counts(df, label, score)
    if thin:
        c = _thinned(c, (F.col("pos") == 0) & (F.col("lower.pos") == 0))
    p = F.nullif("pos_all", F.lit(0))
    return c.select(
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / p).alias("recall"),
    )


def label_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: accuracy, f1, precision, recall, balanced accuracy, rows.

    A ratio without a denominator is 0; balanced accuracy averages the classes
    that occur.
    """
    y, p = F.col(label).cast("int"), F.col(predicted).cast("int")
    cells = df.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    classes = F.when(tp + fn > 0, 1).otherwise(0) + F.when(tn + fp > 0, 1).otherwise(0)
    return cells.select(
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / F.nullif(classes, F.lit(0))).alias(
            "balanced_accuracy"
        ),
        (tp + tn + fp + fn).alias("eval_rows"),
    )


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count("*").alias("n")).orderBy(label, predicted)


def calibration(
    df: DataFrame, truth: str, score: str, bins: int = 10, discrete: bool = False
) -> DataFrame:
    """Mean prediction against mean truth per quantile bin of the prediction."""
    data = df.select(F.col(truth).alias("truth"), F.col(score).cast("double").alias("score"))
    placed = ranks.quantile_bin(data, "score", bins, "bin", discrete)
    return (
        placed.where("bin is not null")
        .groupBy("bin")
        .agg(
            F.avg("score").alias("mean_pred"),
            F.avg("truth").alias("mean_true"),
            F.count("*").alias("n"),
        )
        .orderBy("bin")
    )


def residuals(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Raw residual and log1p residual of predictions not below zero."""
    return df.withColumns(
        {
            "residual": F.col(y) - F.col(pred),
            "residual_log1p": F.log1p(F.col(y).cast("double"))
            - F.log1p(F.greatest(F.col(pred).cast("double"), F.lit(0.0))),
        }
    )


def best_model(metrics: DataFrame, measure: str = "rmse_log1p") -> DataFrame:
    """The row with the lowest measure; a missing or NaN measure is the worst."""
    m = F.col(measure)
    rank = F.when(m.isNull() | F.isnan(m), F.lit(INF)).otherwise(m)
    return metrics.orderBy(rank.asc(), F.asc("model")).limit(1)
