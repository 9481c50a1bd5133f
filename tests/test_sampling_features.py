import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from kudoscope.operators import checks, encoders, reshape, sampling, sentiment, tfidf
from kudoscope.plans import feature_matrix, master


def labelled(spark, n=1000, share=0.3):
    return spark.range(n).select(
        F.col("id").alias("review_id"), (F.col("id") < int(n * share)).cast("int").alias("target_is_useful"))


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    plain = {r["k"] for r in sampling.sample_rows(df, 700, "k", 1).collect()}
    cut = {r["k"] for r in sampling.sample_rows(df.repartition(5), 700, "k", 1).collect()}
    assert plain == cut and len(cut) == 700
    assert sampling.sample_rows(df, 99999, "k").count() == 5000
    assert sampling.sample_rows(df, 0, "k").count() == 0
    assert plain != {r["k"] for r in sampling.sample_rows(df, 700, "k", 2).collect()}


@pytest.mark.parametrize("n, fraction", [(1000, 0.2), (997, 0.2), (10, 0.35), (2, 0.5)])
def test_split_sizes_and_shares(spark, n, fraction):
    df = labelled(spark, n)
    train, held = sampling.split(df, fraction)
    a, b = train.collect(), held.collect()
    assert len(b) == math.ceil(n * fraction) and len(a) + len(b) == n
    assert not {r["review_id"] for r in a} & {r["review_id"] for r in b}
    positives = sum(r["target_is_useful"] for r in b)
    assert abs(positives - fraction * int(n * 0.3)) <= 1


def test_split_of_tiny_tables(spark):
    for n in (0, 1):
        train, held = sampling.split(labelled(spark, n))
        assert (train.count(), held.count()) == (n, 0)
    one_class = labelled(spark, 50, 0.0)
    assert sampling.split(one_class)[1].count() == 10


def test_stratified_sample(spark):
    out = sampling.stratified_sample(labelled(spark), 101, "review_id", "target_is_useful").collect()
    assert len(out) == 101 and abs(sum(r["target_is_useful"] for r in out) - 30) <= 1
    assert sampling.stratified_sample(labelled(spark), 5000, "review_id", None).count() == 1000


def test_union_and_melt(spark):
    a = spark.createDataFrame([(1, 2)], "k int, n_x int")
    b = spark.createDataFrame([(3,)], "k int")
    assert [tuple(r) for r in reshape.union_by_name(a, b).orderBy("k").collect()] == [(1, 2), (3, None)]
    assert [tuple(r) for r in reshape.melt(a, ["k"], ["n_x"], prefix="n_").collect()] == [(1, "x", 2)]


def test_top_values_fit_on_train_only(spark):
    train = spark.createDataFrame([("A b", ["Food", "Thai"]), ("A b", ["Thai", "thai"]), ("A.b", ["Deli"])], "city string, categories array<string>")
    top = encoders.fit_top_values(train, {"city": 2, "categories": 2}, ["categories"], {"categories": "cat"})
    assert top.tokens == {"city": ["A b", "A.b"], "categories": ["Thai", "Deli"]}
    assert top.columns == ["city_a_b", "city_a_b_2", "cat_thai", "cat_deli"]
    other = spark.createDataFrame([(" A b", ["Deli", "New"]), (None, None)], "city string, categories array<string>")
    rows = [tuple(r) for r in top.transform(other).select(*top.columns).collect()]
    assert rows == [(1, 0, 0, 1), (0, 0, 0, 0)]


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([(1, "Red red fish"), (2, "red dog"), (3, None)], "k int, text string")
    s = tfidf.TermSettings(100, 1, (1, 2), ("dog",))
    idf = {t: math.log((1 + 3) / (1 + d)) + 1 for t, d in {"red": 2, "fish": 1, "red red": 1, "red fish": 1}.items()}
    raw = {"red": 2 * idf["red"], "fish": idf["fish"], "red red": idf["red red"], "red fish": idf["red fish"]}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    long = {(r["k"], r["term"]): r["weight"] for r in tfidf.tfidf_long(docs, "k", "text", s).collect()}
    assert long == pytest.approx({(1, t): v / norm for t, v in raw.items()} | {(2, "red"): 1.0})
    model = tfidf.fit_tfidf(docs, "text", s)
    rows = model.transform(docs).select("k", vector_to_array("tfidf").alias("v")).collect()
    for r in rows:
        got = {(r["k"], t): w for t, w in zip(model.terms, r["v"]) if w}
        assert got == pytest.approx({k: w for k, w in long.items() if k[0] == r["k"]})


def test_min_df_and_vocabulary_ties(spark):
    docs = spark.createDataFrame([(1, "bb aa cc"), (2, "aa bb")], "k int, text string")
    assert tfidf.fit_tfidf(docs, "text", tfidf.TermSettings(1, 1, (1, 1), ())).terms == ["aa"]
    assert tfidf.fit_tfidf(docs, "text", tfidf.TermSettings(9, 2, (1, 1), ())).terms == ["aa", "bb"]


LEXICON = [("good", 1.9), ("bad", -2.5)]


def scores(spark, texts):
    lex = spark.createDataFrame(LEXICON, "token string, valence double")
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return [r.asDict() for r in sentiment.lexicon_scores(docs, "k", "text", lex).orderBy("k").collect()]


def test_lexicon_rules(spark):
    plain, very, caps, denied, bang, but, empty, none = scores(
        spark, ["it is good", "it is very good", "it is GOOD", "it is not good", "it is good!!", "good but bad", "", None])
    unit = lambda s: round(s / math.sqrt(s * s + 15), 4)
    assert plain["sentiment_compound"] == unit(1.9)
    assert very["sentiment_compound"] == unit(1.9 + 0.293)
    assert caps["sentiment_compound"] == unit(1.9 + 0.733)
    assert denied["sentiment_compound"] == unit(1.9 * -0.74)
    assert bang["sentiment_compound"] == unit(1.9 + 2 * 0.292)
    assert but["sentiment_compound"] == unit(0.5 * 1.9 - 1.5 * 2.5)
    for blank in (empty, none):
        assert all(blank[c] == 0.0 for c in sentiment.SCORES)
    assert plain["sentiment_neu"] == round(2 / 4.9, 3)


def test_lexicon_beyond_the_broadcast_limit(spark, monkeypatch):
    from kudoscope.operators import joins

    texts = ["good good bad", "nothing here", "not good"]
    small = scores(spark, texts)
    monkeypatch.setattr(joins, "is_small", lambda *a: False)
    assert scores(spark, texts) == small


def test_model_scores(spark):
    def load():
        return lambda texts: [{"Yes!": float(len(t)), "NO": 1.0} if t else {} for t in texts]

    docs = spark.createDataFrame([(1, "abc"), (2, None)], "k int, text string")
    rows = sentiment.score_sentiment(docs, "k", "text", "transformer", load=load, labels=["Yes!", "NO"]).orderBy("k").collect()
    assert tuple(rows[0]) == (1, "Yes!", 3.0, 3.0, 1.0)
    assert tuple(rows[1])[:2] == (2, None)


def test_checks(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    checks.no_duplicate_columns(df)
    with pytest.raises(ValueError):
        checks.no_duplicate_columns(df.select("a", F.col("b").alias("a")))
    with pytest.raises(ValueError):
        checks.no_leakage(["useful_sent"], ["useful"])
    checks.no_leakage(["useful_user"], ["useful"])
    with pytest.raises(KeyError):
        checks.has_columns(df, ["c"])
    with pytest.raises(ValueError):
        checks.same_columns(df, df.select("b", "a"))


def test_feature_tables_hold_no_target(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(v), int(rng.integers(0, 3)), f"c{i % 3}", "s", ["Thai", f"k{i % 4}"], "good food here") for i, v in enumerate(rng.poisson(1, 200))]
    reviews = spark.createDataFrame(rows, "review_id long, useful int, cool int, city string, state string, categories array<string>, text string")
    marked = master.split_master(reviews)
    train, held = master.sides_of(marked)
    scored = reviews.select("review_id", "useful", "cool", F.lit(0.5).alias("sentiment_compound"), F.lit(1).alias("target_helpful_votes"))
    s = feature_matrix.FeatureSettings(include_sentiment=True, include_tfidf=True, terms=tfidf.TermSettings(10, 1))
    tables = feature_matrix.feature_tables(train, held, s, scored)
    assert not set(tables.features) & set(feature_matrix.LEAKAGE)
    assert "sentiment_compound" in tables.features and "cool" in tables.features
    assert tables.train.columns == tables.evaluation.columns
    cities = [c for c in tables.features if c.startswith("city_")]
    assert tables.train.select(sum(F.col(c) for c in cities).alias("n")).where("n > 1").count() == 0
    record = tables.record().first()
    assert record["target"] == "target_useful_votes" and record["one_hot_maps"]["city"]
    packed = feature_matrix.assemble(tables.train, tables.features, "tfidf").first()["features"]
    assert packed.size == tables.vector_width
