"""Configurable text and numeric models: recipes, estimators, scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    MaxAbsScaler,
    SQLTransformer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kudoscope.functions import text
from kudoscope.models import forest
from kudoscope.models.weights import class_weights
from kudoscope.operators import checks, ranks, sampling, tfidf
from kudoscope.session import keep, release

# Recipe names and the accepted spellings of the model types.
RECIPES = ("text_tfidf", "text_tfidf_dense", "text_tfidf_plus_numeric")
MODEL_TYPES = {
    "logistic_regression": "logistic_regression",
    "logreg": "logistic_regression",
    "lr": "logistic_regression",
    "random_forest_classifier": "random_forest_classifier",
    "rf": "random_forest_classifier",
    "random_forest": "random_forest_classifier",
    "linear_svc": "linear_svc",
    "linearsvc": "linear_svc",
    "svc": "linear_svc",
    "random_forest_regressor": "random_forest_regressor",
    "rf_regressor": "random_forest_regressor",
    "rf_reg": "random_forest_regressor",
}
BINARY_TARGET = "target_is_useful"
COUNT_TARGET = "target_useful_votes"
TREES = 300
MODEL_TERMS = tfidf.TermSettings(max_features=5000, min_df=1)


def model_type(name: str) -> str:
    try:
        return MODEL_TYPES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown model type {name!r}") from None


def model_name(target: str, recipe: str, kind: str) -> str:
    return f"{target}__{recipe}__{kind}".replace(" ", "_").lower()


def estimator(
    kind: str,
    rows: int,
    seed: int = 42,
    trees: int = TREES,
    depth: int = 10,
    weighted: bool = True,
):
    """Spark ML estimator; class weights are read from ``weight``.

    The linear classifiers carry an L2 penalty of strength one on the summed
    loss: one over ``rows`` on Spark's averaged loss.  Spark's forests grow
    level by level, so their depth is bounded.
    """
    name = model_type(kind)
    common = {"featuresCol": "features", "labelCol": "label"}
    if name == "random_forest_regressor":
        return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, **common)
    if weighted:
        common["weightCol"] = "weight"
    if name == "logistic_regression":
        return LogisticRegression(
            maxIter=1000, regParam=1.0 / max(rows, 1), standardization=False, **common
        )
    if name == "linear_svc":
        return LinearSVC(regParam=1.0 / max(rows, 1), standardization=False, **common)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **common)


def _quoted(value: str) -> str:
    """A text in SQL."""
    inner = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{inner}'"


def term_stages(settings: tfidf.TermSettings) -> list:
    """Transformers that add ``_terms`` to rows with a ``text``: the expressions of
    :func:`tfidf.add_terms` as SQL, so a saved model splits texts without row functions."""
    low, high = settings.ngram_range
    words = f"regexp_extract_all(lower(coalesce(text, '')), {_quoted(text.TOKEN_RUN)}, 0)"
    if stops := sorted(set(settings.stops())):
        words = f"filter({words}, w -> w NOT IN ({', '.join(map(_quoted, stops))}))"
    grams = []
    for n in range(low, high + 1):
        places = f"CASE WHEN size(_kept) >= {n} THEN sequence(0, size(_kept) - {n}) ELSE array() END"
        gram = ", ".join(f"get(_kept, i + {k})" for k in range(n))
        grams.append("_kept" if n == 1 else f"transform({places}, i -> concat_ws(' ', {gram}))")
    return [
        SQLTransformer(statement=f"SELECT *, {words} AS _kept FROM __THIS__"),
        SQLTransformer(statement=f"SELECT *, concat({', '.join(grams)}) AS _terms FROM __THIS__"),
    ]


def median_fill(train: DataFrame, columns: Sequence[str]) -> SQLTransformer:
    """Replace nulls of numeric columns by the exact training median."""
    long = ranks.long_form(train, columns).where("value is not null")
    table = ranks.quantiles(long, "value", [0.5], ["median"], ["column"])
    medians = {r["column"]: r["median"] for r in table.collect()}  # one row per column
    filled = ", ".join(
        f"coalesce(cast(`{c}` AS double), {medians.get(c, 0.0)!r}D) AS `_num_{c}`" for c in columns
    )
    return SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")


def feature_model(
    train: DataFrame,
    recipe: str,
    settings: tfidf.TermSettings | None = None,
    numeric: Sequence[str] = (),
    fitted: tfidf.TfidfModel | None = None,
) -> PipelineModel:
    """Fitted stages that turn ``text`` (and numeric columns) into ``features``.

    ``fitted`` is the vocabulary of the same rows and settings where the caller
    has it: recipes share it.

    Term vectors stay sparse in every recipe, ``text_tfidf_dense`` too: Spark's
    trees read sparse vectors.  Numeric columns are filled with their median
    and divided by their largest size.
    """
    if recipe not in RECIPES:
        raise ValueError(f"unknown feature recipe {recipe!r}")
    settings = settings or MODEL_TERMS
    fitted = fitted or tfidf.fit_tfidf(train, "text", settings)
    stages = [*term_stages(settings), fitted.stages("_text")] if fitted.terms else []
    parts = ["_text"] if fitted.terms else []
    if recipe == "text_tfidf_plus_numeric" and numeric:
        fill = median_fill(train, numeric)
        pack = VectorAssembler(inputCols=[f"_num_{c}" for c in numeric], outputCol="_numbers")
        ready = pack.transform(fill.transform(train.select(*numeric)))
        scale = MaxAbsScaler(inputCol="_numbers", outputCol="_scaled").fit(ready)
        stages += [fill, pack, scale]
        parts.append("_scaled")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return PipelineModel(stages=stages)


def text_and_target(df: DataFrame, target: str) -> DataFrame:
    """Rows with a filled ``text`` and a ``label``: the class, or the count as a number."""
    checks.has_columns(df, ["text", target], "model input")
    label = F.col(target).cast("double")
    if target != BINARY_TARGET:
        label = F.coalesce(F.col(target).try_cast("double"), F.lit(0.0))
    return df.withColumns({"text": text.filled(F.col("text")), "label": label})


def positive_score(df: DataFrame, name: str = "y_proba") -> DataFrame:
    """Score of the positive class: its probability, else the sigmoid of the
    margin, else the prediction."""
    if "probability" in df.columns:
        score = vector_to_array("probability")[1]
    elif "rawPrediction" in df.columns:
        score = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    else:
        score = F.col("prediction").cast("double")
    return df.withColumn(name, score)


def with_labels(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return positive_score(df).withColumn("y_pred", (F.col("y_proba") >= threshold).cast("int"))


def training_rows(
    df: DataFrame,
    target: str,
    key: str = "review_id",
    drop_zero_votes: bool = True,
    sample: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Rows to fit on; the count target leaves out rows without votes unless told
    otherwise, and ``sample`` takes a seeded sample."""
    if target == COUNT_TARGET and drop_zero_votes:
        df = df.where(F.col(target) != 0)
    return sampling.sample_rows(df, sample, key, seed) if sample else df


def train_text_model(
    df: DataFrame,
    target: str = COUNT_TARGET,
    kind: str = "random_forest_regressor",
    recipe: str = "text_tfidf_plus_numeric",
    settings: tfidf.TermSettings | None = None,
    numeric: Sequence[str] = (),
    seed: int = 42,
    trees: int = TREES,
    depth: int = 10,
    fitted: tfidf.TfidfModel | None = None,
) -> PipelineModel:
    """Fit features and estimator as one saved-and-loaded pipeline.

    Terms and scales are fitted on all rows given; the assembled rows are kept
    while the estimator iterates over them.
    """
    model, data = fit_on_kept_rows(df, target, kind, recipe, settings, numeric, seed, trees, depth, fitted)
    release(data)
    return model


def fit_on_kept_rows(
    df: DataFrame,
    target: str,
    kind: str,
    recipe: str,
    settings: tfidf.TermSettings | None = None,
    numeric: Sequence[str] = (),
    seed: int = 42,
    trees: int = TREES,
    depth: int = 10,
    fitted: tfidf.TfidfModel | None = None,
    key: Sequence[str] = (),
) -> tuple[PipelineModel, DataFrame]:
    """:func:`train_text_model`, and its kept rows ``features``, ``label`` and ``key``,
    which the caller releases: the last stage scores them without the texts."""
    features, data = kept_rows(df, target, [kind], recipe, settings, numeric, fitted, key)
    try:
        return fit_estimator(features, data, target, kind, seed, trees, depth), data
    except BaseException:
        release(data)
        raise


def _weighted(target: str, kind: str) -> bool:
    return target == BINARY_TARGET and model_type(kind) != "random_forest_regressor"


def kept_rows(
    df: DataFrame,
    target: str,
    kinds: Sequence[str],
    recipe: str,
    settings: tfidf.TermSettings | None = None,
    numeric: Sequence[str] = (),
    fitted: tfidf.TfidfModel | None = None,
    key: Sequence[str] = (),
) -> tuple[PipelineModel, DataFrame]:
    """Fitted feature stages, and the kept rows that models of all ``kinds`` read."""
    rows = text_and_target(df, target)
    features = feature_model(rows, recipe, settings, numeric, fitted)
    data = features.transform(rows).select("features", "label", *key)
    if any(_weighted(target, kind) for kind in kinds):
        sizes = class_weights(rows, "label").select("label", "weight")  # the texts are not asked for
        data = data.join(F.broadcast(sizes), "label")
    return features, keep(data)


def fit_estimator(
    features: PipelineModel, data: DataFrame, target: str, kind: str, seed: int = 42, trees: int = TREES, depth: int = 10
) -> PipelineModel:
    """One model on :func:`kept_rows`, behind their feature stages."""
    plan = estimator(kind, data.count(), seed, trees, depth, _weighted(target, kind))
    is_forest = model_type(kind).startswith("random_forest")
    model = PipelineModel(stages=[forest.fit(plan, data)]) if is_forest else Pipeline(stages=[plan]).fit(data)
    return PipelineModel(stages=[features, model])
