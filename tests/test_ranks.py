import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kudoscope.operators import aggregates, correlation, joins, metrics, ranks

numbers = st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6, allow_nan=False, width=32), st.none())


def frame(spark, values, name="v"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} double")


@settings(max_examples=10, deadline=None)
@given(st.lists(numbers, min_size=1, max_size=60))
def test_average_rank_and_quantiles(spark, values):
    df = frame(spark, values)
    want = pd.Series(values, dtype=float)
    got = ranks.average_rank(df, "v", "i").orderBy("i").toPandas()["rank_avg"]
    assert got.fillna(-1).tolist() == want.rank().fillna(-1).tolist()
    if want.notna().any():
        q = ranks.quantiles(df, "v", [0.0, 0.1, 0.5, 0.99, 1.0], list("abcde")).first()
        assert list(q) == pytest.approx(want.quantile([0.0, 0.1, 0.5, 0.99, 1.0]).tolist(), rel=1e-9, abs=1e-9)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 6).map(float), st.none()), min_size=2, max_size=50))
def test_quantile_bins_equal_qcut(spark, values):
    s = pd.Series(values, dtype=float)
    got = ranks.quantile_bin(frame(spark, values), "v", 10).orderBy("i").toPandas()["bin"]
    if s.nunique() < 2:
        assert got.isna().all()
        return
    want = pd.Series(pd.qcut(s, 10, labels=False, duplicates="drop"))
    assert got.fillna(-1).astype(int).tolist() == want.fillna(-1).astype(int).tolist()


def test_ranges_never_decrease_and_spread_dense_values(spark):
    values = sorted({float(np.nextafter(2.0**k, d)) for k in range(-20, 40) for d in (-np.inf, np.inf)} | {2.0**k for k in range(-20, 40)} | {0.0, -1.0, -2.5, -2.0, 1e-300, 5e-324, 1e300})
    df = ranks.ranged(frame(spark, values), "v").orderBy("i")
    buckets = [r["_bucket"] for r in df.collect()]
    assert buckets == sorted(buckets) and len(set(buckets)) > 100
    # 200,000 values within a few millionths of each other
    dense = spark.range(200_000).select(F.col("id").alias("i"), (F.lit(0.9999) + F.col("id") * 1e-10).alias("v"))
    sizes = [r["count"] for r in ranks.ranged(dense, "v").groupBy("_bucket").count().collect()]
    assert len(sizes) > 900 and max(sizes) < 1000
    row = ranks.rank_table(dense, "v").agg(F.max("rank_max"), F.sum("rank_avg"), F.count("*")).first()
    assert tuple(row) == (200_000, 200_000 * 200_001 / 2, 200_000)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.floats(allow_nan=False, width=32)), min_size=1, max_size=60))
def test_running_totals_and_neighbours_equal_brute_force(spark, rows):
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    pdf["v"] += 0.0  # no negative zero
    pdf = pdf.drop_duplicates().sort_values(["g", "v"]).reset_index(drop=True)
    pdf["n"] = pdf.index % 5
    got = ranks.running_total(spark.createDataFrame(pdf), "v", ["n"], ["g"]).orderBy("g", "v").toPandas()
    assert got["n_upto"].tolist() == pdf.groupby("g")["n"].cumsum().tolist()
    assert got["n_all"].tolist() == pdf.groupby("g")["n"].transform("sum").tolist()
    one = pdf.drop_duplicates("v").sort_values("v").reset_index(drop=True)
    near = ranks.with_neighbours(spark.createDataFrame(one), "v", ["n"]).orderBy("v").collect()
    want = [None, *one["n"].tolist(), None]
    assert [r["lower"] and r["lower"]["n"] for r in near] == want[:-2]
    assert [r["higher"] and r["higher"]["n"] for r in near] == want[2:]


def test_rank_in_group_with_a_hot_group(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"i": range(4000), "g": np.where(rng.random(4000) < 0.5, 0, rng.integers(1, 50, 4000)), "v": rng.integers(0, 5, 4000).astype(float)})
    pdf.loc[::17, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = ranks.rank_in_group(df, "v", "g", "i", "r", "p").orderBy("i").toPandas()
    group = pdf.groupby("g")["v"]
    assert len(got) == 4000
    pd.testing.assert_series_equal(got["r"].astype(float), group.rank(method="max"), check_names=False)
    pd.testing.assert_series_equal(got["p"], group.rank(pct=True), check_names=False)


def test_salted_join_equals_plain_join(spark):
    left = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("k"))
    left = left.withColumn("k", F.when(F.col("id") % 11 != 0, F.col("k")))
    right = spark.range(90).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    a = joins.attach(left, right, "k").select("id", "k", "x")
    b = joins.attach(left, right, "k", salt_by="id").select("id", "k", "x")
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    c = joins.look_up(left, right, "k", F.col("id"), rows=10).select("id", "k", "x")
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, c.collect()), key=str)


def test_join_names_and_one_to_one(spark):
    left = spark.createDataFrame([(1, 5), (2, 6)], "k int, useful int")
    right = spark.createDataFrame([(1, 7)], "k int, useful int")
    out = joins.attach(left, right, "k", "_user")
    assert out.columns == ["k", "useful", "useful_user"]
    assert joins.attach_one_to_one(left, right, "k").count() == 2
    with pytest.raises(ValueError):
        joins.attach_one_to_one(left, right.union(right), "k")
    with pytest.raises(ValueError):
        joins.attach_one_to_one(left.union(left), right, "k")


def test_correlations_with_nulls_and_constants(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.integers(0, 4, 300).astype(float), "b": rng.normal(size=300), "c": 1.0})
    pdf.loc[::7, "a"] = np.nan
    pdf.loc[::5, "b"] = np.nan
    df = spark.createDataFrame(pdf)
    df = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in df.columns])
    pairs = [("a", "b"), ("a", "c")]
    for f, method in ((correlation.pearson, "pearson"), (correlation.spearman, "spearman")):
        got = {(r["left"], r["right"]): r["correlation"] for r in f(df, pairs).collect()}
        assert got[("a", "b")] == pytest.approx(pdf[["a", "b"]].corr(method=method).iloc[0, 1])
        assert got[("a", "c")] is None


def test_spearman_matrix(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"i": range(400), "a": rng.integers(0, 3, 400).astype(float), "b": rng.normal(size=400), "c": rng.normal(size=400), "k": 2.0})
    pdf.loc[::6, "c"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("c", F.when(~F.isnan("c"), F.col("c")))
    rows = correlation.spearman_matrix(df, ["a", "b", "c", "k"], "i").collect()
    want = pdf[["a", "b", "c"]].corr(method="spearman")
    assert len(rows) == 6
    for r in rows:
        if "k" in (r["left"], r["right"]):
            assert r["correlation"] is None
        else:
            assert r["correlation"] == pytest.approx(want.loc[r["left"], r["right"]])


def test_group_summary_with_nulls(spark):
    rows = [("x", 1.0), ("x", None), ("x", 4.0), ("y", None), ("z", 2.0), (None, 9.0)]
    out = aggregates.group_summary(spark.createDataFrame(rows, "k string, v double"), "k", "v", discrete=False)
    got = {r["k"]: (r["mean"], r["median"], r["n"]) for r in out.collect()}
    assert got == {"x": (2.5, 2.5, 3), "y": (None, None, 1), "z": (2.0, 2.0, 1)}


@pytest.mark.parametrize("values", [[1.0], [0.0, 0.1, 0.2, 0.3, 1.0], list(np.random.default_rng(3).normal(size=500))])
def test_histogram_equals_numpy(spark, values):
    out = aggregates.histogram(frame(spark, [float(v) for v in values]), "v", 10, density=True).toPandas()
    counts, edges = np.histogram(values, 10)
    assert out["n"].tolist() == counts.tolist()
    assert out["low"].tolist() == pytest.approx(edges[:-1].tolist())
    assert out["density"].tolist() == pytest.approx(np.histogram(values, 10, density=True)[0].tolist())


def test_fans_bins(spark):
    values = [None, 0.0, 1.0, 5.0, 6.0, 20.0, 21.0, 100.0, 101.0]
    got = [r[0] for r in frame(spark, values).orderBy("i").select(aggregates.fans_bin(F.col("v"))).collect()]
    assert got == ["0", "0", "1-5", "1-5", "6-20", "6-20", "21-100", "21-100", "100+"]


def test_auc_and_average_precision(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, s double")
    row = metrics.ranking_metrics(df, "y", "s").first()
    assert row["roc_auc"] == pytest.approx(0.75)
    assert row["pr_auc"] == pytest.approx(0.8333333)
    one_class = metrics.ranking_metrics(df.where("y = 1"), "y", "s").first()
    assert one_class["roc_auc"] is None and one_class["pr_auc"] is None


def test_metrics_edges(spark):
    df = spark.createDataFrame([(1.0, -2.0, 1), (float("nan"), 1.0, 1), (3.0, 2.0, 1)], "y double, p double, c int")
    row = metrics.log_regression_metrics(df, "y", {"m": "p", "none": "y"}).where("model = 'm'").first()
    want = np.abs(np.log1p([1, 3]) - np.log1p([0, 2]))
    assert row["mae_log1p"] == pytest.approx(want.mean())
    labels = metrics.label_metrics(df.withColumn("z", F.lit(0)), "c", "z").first()
    assert (labels["precision"], labels["recall"], labels["f1"], labels["balanced_accuracy"]) == (0.0, 0.0, 0.0, 0.0)
    table = spark.createDataFrame([("a", float("nan")), ("b", 0.5), ("c", None)], "model string, rmse_log1p double")
    assert metrics.best_model(table).first()["model"] == "b"


def test_infinite_values_rank_at_the_ends(spark):
    from kudoscope.operators import ranks

    rows = spark.createDataFrame([(float("inf"),), (1.0,), (-5e300,), (float("-inf"),)], "v double")
    got = [r[0] for r in ranks.ranged(rows, "v").orderBy("_bucket").collect()]
    assert got == [float("-inf"), -5e300, 1.0, float("inf")]
