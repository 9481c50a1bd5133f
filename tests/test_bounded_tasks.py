"""Work that must not end up in few tasks, or be done more often than its rows need."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from kudoscope.catalog.base import spread
from kudoscope.models import regression
from kudoscope.session import configure


def test_one_row_group_in_many_splits_is_spread(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).alias("text")).coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() >= 8
        assert df.select(F.spark_partition_id()).distinct().count() == 1
        wide = spread(df)
        assert wide.select(F.spark_partition_id()).distinct().count() >= 8
        assert wide.exceptAll(df).isEmpty() and df.exceptAll(wide).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _rows(spark, distinct, n):
    at = F.col("id") % distinct
    return spark.range(n).select(
        array_to_vector(F.array((at % 7).cast("double"), (at % 5).cast("double"))).alias("features"),
        F.log1p((at % 7 + 2 * (at % 5)).cast("double")).alias("_log_y"),
    )


def test_boosting_reads_equal_rows_once(spark):
    data = _rows(spark, 35, 700)
    folded = regression._fold(data, ["features", "_log_y"])
    assert folded.count() == 35 and folded.agg(F.sum("_rows")).first()[0] == 700
    s = regression.ModelSettings(boosted_rounds=5)
    got = regression._boosted(data, "features", s).transform(data).agg(F.avg("_boosted"), F.max("_boosted")).first()
    plain = regression.GBTRegressor(
        featuresCol="features", labelCol="_log_y", predictionCol="_boosted", maxIter=5,
        stepSize=s.boosted_step, maxDepth=s.boosted_depth, maxBins=255, seed=s.seed)
    want = plain.fit(data).transform(data).agg(F.avg("_boosted"), F.max("_boosted")).first()
    assert list(got) == pytest.approx(list(want), abs=1e-9)


def test_rows_that_differ_are_not_folded(spark):
    data = spark.range(500).select(
        array_to_vector(F.array(F.col("id").cast("double"))).alias("features"), F.lit(1.0).alias("_log_y"))
    assert regression._fold(data, ["features", "_log_y"]) is None


def test_vector_is_kept_only_for_models_that_read_it(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(regression, "keep", lambda df: seen.append(df.columns) or df)
    rows = spark.range(50).select(
        (F.col("id") % 5).cast("double").alias("cool"), F.col("id").alias("votes"),
        array_to_vector(F.array(F.col("id").cast("double"))).alias("features"))
    for models, kept in ((("baseline_mean", "linear_log"), False), (("baseline_mean", "hurdle"), True)):
        regression.fit(rows, "votes", ["cool"], regression.ModelSettings(models, ("cool",)))
        assert ("features" in seen.pop()) is kept


def test_shuffles_start_in_many_parts(spark):
    configure(spark)
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) > 200
