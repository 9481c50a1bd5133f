"""Hot keys, hashed term counts, digit-wise samples, sketches, curves, masks, sparse fits, shared stages."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from kudoscope.models import poisson, regression
from kudoscope.operators import correlation, joins, metrics, sampling, sentiment, sketches, tfidf
from kudoscope.plans import feature_matrix, master, sweep
from kudoscope.plans.stages import Stages


def test_hot_keys_and_salted_join(spark):
    rows = spark.range(30_000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, -7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 9000).alias("k")
    )
    hot = spark.range(1).select(joins.hot_keys(rows, "k").alias("hot")).first()["hot"]
    assert hot == [-7]
    side = rows.select("k").distinct().select("k", (F.col("k") * 2).alias("v"), F.lit("s").alias("id"))
    plain = joins.attach(rows, side, "k").orderBy("id").collect()
    salted = joins.attach(rows, side, "k", salt_by="id")
    assert salted.orderBy("id").select("k", "id", "v", "id_right").collect() == [r for r in plain]
    # the rows of the hot key are dealt to many partitions
    spread = rows.where("k = -7").withColumn("p", F.pmod(F.hash("k", F.pmod(F.xxhash64("id"), F.lit(joins.SALTS))), F.lit(200)))
    assert spread.select("p").distinct().count() > 40
    plan = salted._jdf.queryExecution().optimizedPlan().toString()
    assert "approx_top_k" in plan and "_salt" in plan
    text_keys = spark.createDataFrame([("a",)] * 50 + [("b",), (None,)], "k string").withColumn("id", F.monotonically_increasing_id())
    assert "a" in spark.range(1).select(joins.hot_keys(text_keys, "k").alias("h")).first()["h"]


def test_salting_is_on_in_the_master_table(spark):
    reviews = spark.createDataFrame([(i, 1 if i % 3 else i, i % 4, i % 2) for i in range(90)], "review_id long, business_id long, user_id long, useful int")
    business = spark.createDataFrame([(1, "c")], "business_id long, city string")
    users = spark.createDataFrame([(0, 5)], "user_id long, fans int")
    out = master.master_table(reviews, business, users)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("approx_top_k") >= 2
    assert out.count() == 90 and out.where("city = 'c'").count() == 60
    assert out.where("user_fans = 5").count() == 23


@pytest.mark.parametrize("cells", [64, 1 << 12, 1 << 22])
def test_hashed_precount_keeps_the_vocabulary(spark, monkeypatch, cells):
    monkeypatch.setattr(tfidf, "CELLS", cells)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    docs = [(" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(60)], k=rng.randrange(0, 40))),) for _ in range(120)] + [(None,), ("",)]
    df = spark.createDataFrame(docs, "text string")
    s = tfidf.TermSettings(50, 4, (1, 2), ())
    grams = [[*t.split(), *(" ".join(p) for p in zip(t.split(), t.split()[1:]))] for (t,) in docs if t]
    seen, total = {}, {}
    for g in grams:
        for t in g:
            total[t] = total.get(t, 0) + 1
        for t in set(g):
            seen[t] = seen.get(t, 0) + 1
    want = sorted(sorted((t for t in total if seen[t] >= 4), key=lambda t: (-total[t], t))[:50])
    model = tfidf.fit_tfidf(df, "text", s)
    assert model.terms == want
    assert model.idf == pytest.approx([math.log((1 + len(docs)) / (1 + seen[t])) + 1 for t in want])


@pytest.mark.parametrize("digits", [1, 4])
def test_samples_by_digits(spark, monkeypatch, digits):
    monkeypatch.setattr(sampling, "DIGITS", digits)
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    order = [r["k"] for r in df.orderBy(sampling.hash_order("k", 42)).collect()]
    for n in (1, 17, 2999, 3000, 5000):
        assert sorted(r["k"] for r in sampling.sample_rows(df, n, "k").collect()) == sorted(order[:n])
    train, held = sampling.split(df, 0.2, "k", "y")
    for y in (0, 1):
        own = [k for k in order if (k % 7 == 0) == bool(y)]
        picked = {r["k"] for r in held.where(F.col("y") == y).collect()}
        assert picked == set(own[: len(picked)])
    assert held.count() == 600 and train.count() == 2400
    # a key of a third of the rows is one row where places are looked at
    hot = df.withColumn("k", F.when(F.col("k") % 3 == 0, 5).otherwise(F.col("k")))
    assert sampling.sample_rows(hot, 1500, "k").count() >= 1500


def test_sketch_states_merge(spark):
    df = spark.range(20_000).select((F.col("id") % 40).alias("day"), F.sqrt("id").alias("v"), (F.col("id") % 3000).alias("u"), F.lit(None).cast("double").alias("none"))
    daily = sketches.states(df, ["v", "none"], ["u"], ["day"])
    once = sketches.merged(daily.withColumn("half", F.col("day") % 2), ["half"])
    twice = sketches.merged(once)
    out = {r["column"]: r for r in sketches.estimates(twice, (0.1, 0.5, 0.9)).collect()}
    assert out["v"]["count"] == 20_000 and out["v"]["min"] == 0 and out["v"]["max"] == pytest.approx(math.sqrt(19_999))
    for p in (10, 50, 90):
        assert abs(out["v"][f"p{p}"] ** 2 / 20_000 - p / 100) < 0.02
    assert abs(out["u"]["distinct"] - 3000) < 150 and out["none"]["count"] == 0 and out["none"]["p50"] is None
    assert sketches.estimates(sketches.states(df.limit(0), ["v"], ["u"])).where("column = 'v'").first()["p50"] is None


def test_thinned_curves_keep_their_area(spark):
    rng = np.random.default_rng(1)
    score = np.round(rng.random(3000), 3)
    label = (rng.random(3000) < score).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"s": score + np.arange(3000) * 1e-7, "y": label}))
    full = metrics.roc_points(df, "y", "s", thin=False).orderBy("fpr", "tpr").toPandas()
    thin = metrics.roc_points(df, "y", "s").orderBy("fpr", "tpr").toPandas()
    area = lambda c: float(np.trapezoid(c.tpr, c.fpr))
    assert area(thin) == pytest.approx(area(full), abs=1e-12)
    assert area(full) == pytest.approx(metrics.ranking_metrics(df, "y", "s").first()["roc_auc"])
    assert len(thin) < 0.6 * len(full) and len(full) == 3001
    steps = lambda c: float((np.diff(c.recall, prepend=0) * c.precision).sum())
    pr = [metrics.precision_recall_points(df, "y", "s", thin=t).orderBy(F.desc("threshold")).toPandas() for t in (True, False)]
    assert steps(pr[0]) == pytest.approx(steps(pr[1])) and len(pr[0]) < len(pr[1])
    one = metrics.roc_points(df.where("y = 1"), "y", "s").toPandas()
    assert one.fpr.isna().all() and one.tpr.max() == 1
    assert metrics.roc_points(df.limit(0), "y", "s").count() == 0


def test_spearman_matrix_with_nulls(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame(rng.integers(0, 30, (400, 5)).astype(float), columns=list("abcde"))
    pdf["b"] += pdf["a"]
    pdf.loc[rng.random(400) < 0.4, "b"] = np.nan
    pdf.loc[rng.random(400) < 0.2, "d"] = np.nan
    pdf["e"] = np.nan
    pdf["f"] = 1.0
    pdf.insert(0, "i", range(400))
    df = spark.createDataFrame(pdf)
    for nan in (True, False):
        rows = df if nan else df.replace(float("nan"), None)
        got = {(r["left"], r["right"]): r for r in correlation.spearman_matrix(rows, list("abcdef"), "i").collect()}
        assert not [k for k in got if "e" in k]
        for a, b in (("a", "b"), ("a", "c"), ("b", "d"), ("a", "d"), ("c", "d")):
            both = pdf[[a, b]].dropna()
            assert got[a, b]["rows"] == len(both)
            assert got[a, b]["correlation"] == pytest.approx(both.rank().corr().iloc[0, 1])
        assert got["a", "f"]["correlation"] is None and got["a", "f"]["rows"] == 400


def test_rules_work_nearest_first(spark):
    lexicon = spark.createDataFrame([("good", 1.9), ("bad", -2.5), ("truly", 0.5)], "token string, valence double")

    def compound(words, lexicon=lexicon, **options):
        docs = spark.createDataFrame([(1, words)], "k int, text string")
        return sentiment.lexicon_scores(docs, "k", "text", lexicon, **options).first()["sentiment_compound"]

    unit = lambda s: round(s / math.sqrt(s * s + 15), 4)
    assert compound("was not very good") == unit((1.9 + 0.293) * -0.74)
    # the nearer negation turns the farther booster round
    assert compound("was very not good") == unit(1.9 * -0.74 - 0.293 * 0.95)
    assert compound("was very not bad") == unit(-2.5 * -0.74 + 0.293 * 0.95)
    assert compound("very a b good") == unit(1.9 + 0.293 * 0.9)
    assert compound("very a b c good") == unit(1.9)
    assert compound("it is hardly GOOD") == unit((1.9 + 0.733 - 0.293) * -0.74)
    # a modifier that has a valence of its own changes nothing
    assert compound("truly good", intensifiers=("truly",)) == unit(1.9 + 0.5)
    assert compound("truly good", lexicon.where("token <> 'truly'"), intensifiers=("truly",)) == unit(1.9 + 0.293)


def test_sparse_poisson_equals_the_least_squares_fit(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 10)) * ([1, 10, 100, 1, 1, 1, 1, 1, 1, 1])
    x[rng.random(x.shape) < 0.4] = 0
    y = rng.poisson(np.exp(0.3 + x @ np.array([0.3, -0.02, 0.002, 0.1, 0, 0, 0.2, 0, 0, -0.1])))
    rows = [(i, float(v), r.tolist()) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "i long, y double, x array<double>").withColumn("features", array_to_vector("x"))
    small = regression.fit(df, "y", ["y"], regression.ModelSettings(("poisson",), ("y",)))
    weights, intercept = poisson.fit(df, "features", "y", 10, regression.POISSON_PENALTY)
    want = small.predict(df, "y", "i").orderBy("i").toPandas()["pred_poisson"].to_numpy()
    assert np.exp(x @ weights + intercept) == pytest.approx(want, rel=1e-3)


def test_sparse_poisson_beyond_the_solver(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, i % 3, Vectors.sparse(5000, sorted({i % 3: 1.0, 100 + rng.randrange(4800): 0.0}.items()))) for i in range(300)]
    df = spark.createDataFrame([(i, float(2 ** k), v) for i, k, v in rows], ["i", "y", "features"])
    fitted = regression.fit(df, "y", ["y"], regression.ModelSettings(("poisson",), ("y",)))
    preds = fitted.predict(df, "y", "i").toPandas()
    assert preds["pred_poisson"].to_numpy() == pytest.approx(preds["y_true"].to_numpy(), rel=1e-3)
    fitted.write(str(tmp_path / "m"))
    from pyspark.ml import PipelineModel

    again = PipelineModel.load(str(tmp_path / "m/poisson")).transform(df).select("_poisson").toPandas()["_poisson"]
    assert sorted(again) == pytest.approx(sorted(preds["pred_poisson"]))


def test_scenarios_share_their_stages(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(v), int(rng.integers(0, 3)), f"c{i % 3}", ["Thai"], f"good food {i % 5} here") for i, v in enumerate(rng.poisson(1, 300))]
    reviews = spark.createDataFrame(rows, "review_id long, useful int, cool int, city string, categories array<string>, text string")
    train, held = master.sides_of(master.split_master(reviews))
    models = regression.ModelSettings(("baseline_mean", "linear_log"), ("cool",))
    base = sweep.RunSettings(models=models)
    terms = tfidf.TermSettings(10, 2)
    scenarios = {
        "plain": {"min_total_votes": 0},
        "same": {"features.include_sentiment": False},
        "terms": {"features.include_tfidf": True, "features.terms": terms},
        "terms_again": {"features.include_tfidf": True, "features.terms": terms, "models.seed": 42},
        "seen": {"min_total_votes": 2},
    }
    stages = Stages()
    table = sweep.sweep(train, held, base, scenarios, stages=stages).toPandas().set_index("scenario")
    assert stages.made.count("sides") == 2 and stages.made.count("top_values") == 2
    assert stages.made.count("vocabulary") == 1 and stages.made.count("features") == 3 and stages.made.count("models") == 3
    assert table.loc["plain", "rmse_log1p"] == table.loc["same", "rmse_log1p"]
    assert table.loc["terms", "rmse_log1p"] == table.loc["terms_again", "rmse_log1p"]
    alone = sweep.run_scenario(train, held, sweep.with_overrides(base, scenarios["seen"]))[1].best().first()
    assert alone["rmse_log1p"] == pytest.approx(table.loc["seen", "rmse_log1p"])
    assert feature_matrix.FeatureSettings() == base.features
