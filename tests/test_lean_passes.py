"""Steps that once did more work than their result needs."""

import pytest
from pyspark.sql import functions as F

from kudoscope.functions import text
from kudoscope.models import text_models
from kudoscope.operators import correlation, joins, sentiment, tfidf


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_without_a_split(spark):
    df = spark.createDataFrame([(" a\x1cb　c d é. ",), ("",), (" ",), (None,)], "t string")
    out = df.select(text.word_count(F.col("t")).alias("n"))
    assert [r["n"] for r in out.collect()] == [5, 0, 0, None]
    assert "split(" not in plan(out)


def test_only_terms_of_heavy_cells_are_counted(spark, monkeypatch):
    """Rare terms are never spelled out, however many reach ``min_df``."""
    rows = [("top top top " + " ".join(f"rare{i}x{j}" for j in range(40)),) for i in range(30)]
    df = spark.createDataFrame(rows * 2, "text string")
    seen = []
    plain = tfidf.term_counts
    monkeypatch.setattr(tfidf, "term_counts", lambda *a: seen.append(plain(*a)) or seen[-1])
    model = tfidf.fit_tfidf(df, "text", tfidf.TermSettings(2, 2, (1, 2), ()))
    assert model.terms == ["top", "top top"]
    assert len(seen) == 1


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_cells_left_out_are_asked_for_again(spark, monkeypatch, limit):
    """Too few heavy cells at first: their terms miss ``min_df``, others have it."""
    monkeypatch.setattr(tfidf, "HEAVY", 1)
    docs = [("loud " * 50,), ("aa bb cc",), ("aa bb",), ("aa cc",)]
    df = spark.createDataFrame(docs, "text string")
    want = [t for t, _ in sorted({"aa": 3, "bb": 2, "cc": 2, "aa bb": 2}.items(), key=lambda e: (-e[1], e[0]))][:limit]
    assert tfidf.fit_tfidf(df, "text", tfidf.TermSettings(limit, 2, (1, 2), ())).terms == sorted(want)


def test_repeated_keys_are_one_document_of_the_long_form(spark):
    """``twice`` is in two rows of one key, so in one document only."""
    docs = spark.createDataFrame([(1, "twice twice"), (1, "twice twice"), (2, "both"), (3, "both"), (None, "both")], "k int, text string")
    out = tfidf.tfidf_long(docs, "k", "text", tfidf.TermSettings(1, 2, (1, 1), ())).collect()
    assert sorted((str(r["k"]), r["term"], r["tf"]) for r in out) == [("2", "both", 1), ("3", "both", 1), ("None", "both", 1)]


def test_long_form_shuffles_listed_terms_only(spark):
    docs = spark.createDataFrame([(1, "aa bb cc"), (2, "aa dd")], "k int, text string")
    terms = spark.createDataFrame([("aa",)], "term string")
    out = tfidf._listed_frequencies(docs, "k", "text", tfidf.TermSettings(5, 1, (1, 1), ()), terms)
    assert plan(out).index("Exchange hashpartitioning(k") < plan(out).index("BroadcastHashJoin")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "aa", 1), (2, "aa", 1)]


def test_recipes_share_a_vocabulary(spark, monkeypatch):
    docs = spark.createDataFrame([("aa bb",), ("aa",)], "text string")
    settings = tfidf.TermSettings(5, 1, (1, 1), ())
    fitted = tfidf.fit_tfidf(docs, "text", settings)
    monkeypatch.setattr(tfidf, "fit_tfidf", None)
    rows = text_models.feature_model(docs, "text_tfidf", settings, (), fitted).transform(docs)
    assert [r["features"].size for r in rows.collect()] == [2, 2]


def test_spearman_rows_stay_in_place(spark, monkeypatch):
    """Few values: no row is shuffled; many values and nulls give the same figures."""
    df = spark.range(400).select(
        "id", (F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 11).alias("b"),
        F.lit(1).alias("c"), F.when(F.col("id") % 2 > 0, float("nan")).otherwise(F.col("id") * F.col("id") % 13).alias("d"),
        F.lit(None).cast("double").alias("e"))
    few = correlation.spearman_matrix(df, list("abcde"), "id")
    assert "SortMergeJoin" not in plan(few) and "_row" not in plan(few).split("Exchange")[0]
    monkeypatch.setattr(correlation, "FEW_VALUES", 0)
    many = {(r["left"], r["right"]): r for r in correlation.spearman_matrix(df, list("abcde"), "id").collect()}
    got = {(r["left"], r["right"]): r for r in few.collect()}
    pandas = df.toPandas().astype(float)
    assert set(got) == set(many) == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")}
    for (x, y), r in got.items():
        both = pandas[[x, y]].dropna()
        want = both[x].rank().corr(both[y].rank())
        assert r["rows"] == many[x, y]["rows"] == len(both)
        if "c" in (x, y):
            assert r["correlation"] is None and many[x, y]["correlation"] is None
        else:
            assert r["correlation"] == pytest.approx(want) and many[x, y]["correlation"] == pytest.approx(want)


def test_null_keys_of_a_salted_lookup_are_spread(spark):
    left = spark.range(2000).select("id", F.lit(None).cast("int").alias("k"))
    table = spark.createDataFrame([(1, 5, 3)], "k int, v int, n long")
    spread = joins.salted_lookup(left, table, ["k"], "n", F.col("id"))
    assert spread.where("v is null").count() == 2000
    assert "isnull" in spread._jdf.queryExecution().analyzed().toString().lower().replace(" ", "")


def test_words_of_the_sentiment_rules(spark):
    """One pass over the text finds the words that splitting and trimming gives."""
    docs = spark.createDataFrame([(1, "it's -very- GOOD!!, 'x.y' ... --- été’s (a) _b_ 'tis")], "k int, text string")
    words = sentiment._words_with_context(docs, "k", "text", F.array().cast("array<string>"), (), ("very",), ())
    assert [r["token"] for r in words.orderBy("place").collect()] == [
        "its", "very", "good", "x.y", "étés", "a", "_b_", "tis"]
    assert "split(" not in plan(words)


def test_rows_are_counted_for_the_highest_totals_only(spark, monkeypatch):
    """``loud`` has the highest total in one row alone; the next ones take its place."""
    docs = [("loud " * 50 + "aa bb",), ("aa bb cc",), ("aa cc aa",), ("",), (None,)]
    df = spark.createDataFrame(docs, "text string")
    monkeypatch.setattr(tfidf, "row_counts", None)
    model = tfidf.fit_tfidf(df, "text", tfidf.TermSettings(2, 2, (1, 1), ()))
    assert model.terms == ["aa", "bb"]


@pytest.mark.parametrize("low, high", [(1, 1), (1, 3), (2, 2)])
def test_zipped_words_give_the_terms_of_the_rows(spark, low, high):
    words = spark.createDataFrame([(["aa", "bb", "aa", "bb"],), (["aa"],), ([],), (["bb", "aa"],)], "words array<string>")
    s = tfidf.TermSettings(9, 1, (low, high), ())
    cells = tfidf.cell_totals(words, s)
    want = {r["term"]: r["total"] for r in tfidf.row_counts(words, s, cells).collect()}
    assert {r["term"]: r["total"] for r in tfidf.term_counts(words, s, cells).collect()} == want
    assert tfidf.document_counts(words, s, sorted(want)) == {r["term"]: r["df"] for r in tfidf.row_counts(words, s, cells).collect()}
    assert "lambda" not in plan(cells)


def test_phrases_are_fitted_on_kept_vectors(spark, monkeypatch):
    """The solver's input holds no text."""
    df = spark.createDataFrame([("good word", 1), ("bad word", 0), (None, 0)] * 4, "text string, y int")
    seen = []
    of_words = tfidf.TfidfModel.of_words
    monkeypatch.setattr(tfidf.TfidfModel, "of_words", lambda *a: seen.append(of_words(*a)) or seen[-1])
    out = tfidf.rank_phrases(df, "y", settings=tfidf.TermSettings(9, 1, (1, 1), ()), k=1).collect()
    assert {r["side"]: r["term"] for r in out} == {"high": "good", "low": "bad"}
    assert [c for c in seen[0].columns] == ["label", "tfidf"]


def test_saved_stages_split_texts_as_the_vocabulary_does(spark):
    df = spark.createDataFrame([("It's A café, Über_1 x don't",), ("",), (None,), ("stop\\ the aa bb the cc",)], "text string")
    for grams in ((1, 1), (1, 3), (2, 2)):
        s = tfidf.TermSettings(9, 1, grams, ("the", "don't", "a\\b"))
        want = tfidf.add_terms(df, "text", s, "_terms").select("_terms").collect()
        out = df
        for stage in text_models.term_stages(s):
            out = stage.transform(out)
        assert [r[0] for r in out.select("_terms").collect()] == [r[0] for r in want]
        assert "UDF" not in plan(out)


def test_training_metrics_read_kept_vectors(spark, monkeypatch):
    """The texts are turned into vectors once for the fit and the metrics."""
    from kudoscope.plans import training

    df = spark.createDataFrame([(i, "good word" if i % 2 else "bad word", i % 2) for i in range(12)], "k int, text string, target_is_useful int")
    monkeypatch.setattr(training, "score", None)
    run = training.train_model(df, text_models.BINARY_TARGET, "logreg", "text_tfidf", "k")
    row = run.metrics.collect()[0]
    assert (row["eval_rows"], row["accuracy"]) == (12, 1.0)
