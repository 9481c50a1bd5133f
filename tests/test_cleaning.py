import datetime as dt

import pytest
from pyspark.sql import functions as F

from kudoscope.functions import categories, coerce, votes
from kudoscope.operators import clean


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "raw, count, zero",
    [("x", None, 0), (None, None, 0), ("3.7", 3, 3), ("-1", -1, -1), ("9007199254740993",) + (9007199254740993,) * 2,
     ("inf", None, 0), ("nan", None, 0), (" 12 ", 12, 12), ("1e3", 1000, 1000)],
)
def test_counts(spark, raw, count, zero):
    assert one(spark, raw, coerce.to_count) == count
    assert one(spark, raw, coerce.to_count_or_zero) == zero


def test_clean_reviews_drops_and_coerces(spark):
    rows = [
        ("r1", "u", "b", "5", "2021-01-03 10:00:00", "long enough", "x", None, "3.7"),
        (None, "u", "b", "5", "2021-01-03", "long enough", "1", "1", "1"),
        ("r3", "u", "b", "5", "2021-01-03", "123456789", "1", "1", "1"),
        ("r4", "u", "b", "5", "notadate", "long enough", "1", "1", "1"),
        ("r5", "u", "b", "5", "2021-01-03", None, "1", "1", "1"),
        ("r6", "u", "b", "bad", "2020-02-29", "1234567890", "-1", "2", "3"),
    ]
    names = "review_id user_id business_id stars date text useful funny cool".split()
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).withColumn("extra", F.lit(1))
    out = {r["review_id"]: r for r in clean.clean_reviews(df).collect()}
    assert set(out) == {"r1", "r6"}
    r = out["r1"]
    assert (r["useful"], r["funny"], r["cool"], r["stars"]) == (0, 0, 3, 5.0)
    assert (r["review_year"], r["review_month"], r["review_day_of_week"]) == (2021, 1, 6)
    assert out["r6"]["stars"] is None and out["r6"]["useful"] == -1
    assert "extra" not in clean.clean_reviews(df).columns
    assert "funny" not in clean.clean_reviews(df.drop("funny")).columns


def test_elite(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "None"), ("d", "2019,2020")], "user_id string, elite string")
    out = {r["user_id"]: (r["elite_raw"], r["is_elite_ever"]) for r in clean.clean_users(df).collect()}
    assert out == {"a": ("None", False), "b": ("", True), "c": ("None", False), "d": ("2019,2020", True)}
    row = clean.clean_users(df.drop("elite")).first()
    assert row["elite_raw"] is None and row["is_elite_ever"] is False


def test_categories(spark):
    raw = "Food, Mexican,,mexican , Bars"
    assert one(spark, raw, categories.split_list) == ["Food", "Mexican", "", "mexican", "Bars"]
    assert one(spark, None, categories.split_list) == []
    assert one(spark, "", categories.split_list) == []
    assert one(spark, [raw, "Hotels"], categories.normalize, "array<string>") == ["Mexican"]
    assert one(spark, None, categories.normalize, "array<string>") == []
    assert one(spark, [" a ", "", None], categories.non_empty, "array<string>") == ["a"]
    assert one(spark, " Thai , x", categories.primary) == "Thai"


def test_meta_flags_keep_parents(spark):
    df = spark.createDataFrame([(["Food", "Bars"],), (["Thai"],), (None,)], "c array<string>")
    flags = categories.meta_flags(F.col("c"))
    rows = df.select(*[e.alias(n) for n, e in flags.items()]).collect()
    assert [r["meta_food_coffee"] for r in rows] == [1, 0, 0]
    assert [r["meta_bars_nightlife"] for r in rows] == [1, 0, 0]


@pytest.mark.parametrize("policy, expected", [("clip", [0, None, 3]), ("null", [None, None, 3]), ("keep", [-1, None, 3]), ("zero", [0, 0, 3])])
def test_vote_policies(spark, policy, expected):
    df = spark.createDataFrame([(0, -1), (1, None), (2, 3)], "i int, v int").orderBy("i")
    assert [r[0] for r in df.select(votes.clean_votes(F.col("v"), policy)).collect()] == expected


def test_valid_and_popular(spark):
    df = spark.createDataFrame([(1.0, 1.0), (-1.0, 5.0), (None, 9.0), (float("nan"), 1.0), (float("inf"), 1.0)], "y double, total_votes double")
    assert [r["y"] for r in clean.valid_target(df, "y").collect()] == [1.0]
    with pytest.raises(ValueError):
        clean.valid_target(df.where("y < 0"), "y", check=True)
    assert clean.popular(df, 5).count() == 2
    assert clean.popular(df, 100).count() == 5
    assert clean.popular(df.drop("total_votes"), 5).count() == 5


def test_date_parts_filled(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 1, 2), None), (dt.datetime(2021, 1, 2), 1999)], "date timestamp, review_year int")
    rows = clean.fill_date_parts(df).orderBy("review_year").collect()
    assert [r["review_year"] for r in rows] == [1999, 2021]
    assert rows[0]["review_day_of_week"] == 5


def test_both_sides_are_filtered_or_none(spark):
    high = spark.createDataFrame([(1, 5), (2, 0)], "id int, total_votes int")
    low = spark.createDataFrame([(3, 1)], "id int, total_votes int")
    with pytest.warns(UserWarning):
        train, held = clean.popular_sides(high, low, at_least=3)
    assert (train.count(), held.count()) == (2, 1)
    train, held = clean.popular_sides(high, high, at_least=3)
    assert (train.count(), held.count()) == (1, 1)
