import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kudoscope.functions import dates, text


def stats(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    out = df.select("i", *[e.alias(c) for c, e in text.text_stats(F.col("t")).items()])
    return [r.asDict() for r in out.orderBy("i").collect()]


def expected(s):
    s = s or ""
    words = s.split()
    return {
        "text_len_chars": len(s),
        "text_len_words": len(words),
        "avg_word_length": sum(map(len, words)) / len(words) if words else 0.0,
        "caps_ratio": sum(c.isupper() for c in s) / len(s) if s else 0.0,
        "exclaim_count": s.count("!"),
        "question_count": s.count("?"),
    }


SAMPLES = [None, "", " ", "GOOD! Really?!", "a b", "ÉÑ é", "  lead and trail \n", "x\x1cy", "😀 ok", "　wide　"]


def test_text_stats_literals(spark):
    for got, s in zip(stats(spark, SAMPLES), SAMPLES):
        want = expected(s)
        got.pop("i")
        assert got == pytest.approx(want), s


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB! ?\t É.é1\n"), max_size=30), min_size=1, max_size=40))
def test_text_stats_property(spark, values):
    for got, s in zip(stats(spark, values), values):
        got.pop("i")
        assert got == pytest.approx(expected(s)), repr(s)


def test_no_python_in_text_stats(spark):
    df = spark.createDataFrame([("a",)], "t string").select(*text.text_stats(F.col("t")).values())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


@pytest.mark.parametrize("name", ["Coffee & Tea (New)", "***", "Naïve Café", "a_b_"])
def test_slug_column_equals_name(spark, name):
    got = spark.createDataFrame([(name,)], "n string").select(text.slug(F.col("n"))).first()[0]
    assert got == text.slug_name(name)


def test_unique_names():
    assert text.unique_names(["a", "a", "b", "a", "a_2"]) == ["a", "a_2", "b", "a_3", "a_2_2"]


def test_tokens_and_ngrams(spark):
    df = spark.createDataFrame([("The quick, QUICK fox a b",)], "t string")
    words = text.without(text.tokens(F.col("t")), ["the"])
    row = df.select(words.alias("w"), text.ngrams(words).alias("g"), text.lexical_richness(words).alias("r")).first()
    assert row["w"] == ["quick", "quick", "fox"]
    assert row["g"] == ["quick", "quick", "fox", "quick quick", "quick fox"]
    assert row["r"] == pytest.approx(2 / 3)
    assert df.select(text.ngrams(text.tokens(F.lit("one")))).first()[0] == ["one"]


def test_calendar(spark):
    row = spark.createDataFrame([(dt.datetime(2021, 1, 3),)], "d timestamp").select(
        dates.iso_week(F.col("d")).alias("w"), dates.is_weekend(F.col("d")).alias("e"),
        dates.weekday_name(F.weekday("d")).alias("n"), dates.weekday_name(F.lit(7)).alias("bad")).first()
    assert (row["w"], row["e"], row["n"], row["bad"]) == (53, True, "Sunday", None)


def test_age_counts_whole_days(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 1, 2, 1), dt.datetime(2021, 1, 1, 23)), (dt.datetime(2021, 1, 3, 1), dt.datetime(2021, 1, 1, 23)),
                                (dt.datetime(2021, 1, 3, 0), dt.datetime(2021, 1, 1, 0))], "a timestamp, b timestamp")
    assert [r[0] for r in df.select(dates.age_days(F.col("a"), F.col("b"))).collect()] == [0, 1, 2]


def test_text_column():
    assert text.text_column(["id", "Comment_body"]) == "Comment_body"
    with pytest.raises(ValueError):
        text.text_column(["id"])
