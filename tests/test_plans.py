"""Shape of the physical plans."""

import pytest
from pyspark.sql import functions as F

from kudoscope.operators import ranks, sampling, tfidf
from kudoscope.plans import master, review_features


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def tables(spark):
    r = spark.range(100).select(
        F.col("id").alias("review_id"), (F.col("id") % 5).alias("business_id"), (F.col("id") % 7).alias("user_id"),
        F.lit("text").alias("text"), F.current_timestamp().alias("date"), F.lit(1).alias("useful"))
    b = spark.range(5).select(F.col("id").alias("business_id"), F.lit("c").alias("city"), F.lit("n").alias("name"), F.lit("s").alias("state"),
                              F.lit(1).alias("stars"), F.lit(1).alias("review_count"), F.array(F.lit("x")).alias("categories"), F.lit(1).alias("is_open"))
    u = spark.range(7).select(F.col("id").alias("user_id"), F.lit(1).alias("fans"))
    return r, b, u


def test_side_tables_are_not_broadcast_by_hint(spark, no_broadcast):
    text = plan(master.master_table(*tables(spark)))
    assert text.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in text


def test_no_python_in_feature_rows(spark):
    r, b, u = tables(spark)
    assert "Python" not in plan(review_features.review_features(r, b, u, backend=None))


def test_ranks_window_over_buckets_only(spark):
    """The only window without a partition key runs over bucket totals."""
    df = spark.range(1000).select(F.col("id"), F.rand(1).alias("v"))
    table = ranks.rank_table(df, "v")
    lines = plan(table).splitlines()
    windows = [line for line in lines if "Window [" in line]
    assert len([w for w in windows if "_bucket" not in w and "_before" not in w and "n_all" not in w]) == 0
    assert any("hashpartitioning(_bucket" in line for line in lines)


def test_split_sorts_one_prefix_only(spark):
    df = spark.range(1000).select(F.col("id").alias("review_id"), (F.col("id") % 2).alias("target_is_useful"))
    text = plan(sampling.mark_evaluation(df))
    assert "rangepartitioning" not in text  # no sort of all rows


def test_terms_are_built_once(spark):
    """No filter above the scan repeats the term list."""
    df = spark.createDataFrame([(1, "some text")], "k int, text string")
    text = plan(tfidf.term_frequencies(df, "k", "text", tfidf.TermSettings(10, 1, (1, 2), ())))
    assert text.count("regexp_extract_all") == 1


def test_pruned_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select("id", F.lit("x").alias("wide"), F.lit(1).alias("useful")).write.parquet(path)
    text = plan(ranks.quantiles(spark.read.parquet(path), "useful", [0.5], ["m"]))
    assert "wide" not in text


def test_released_tables_leave_no_files(spark, tmp_path, monkeypatch):
    from kudoscope import session

    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    source = spark.range(10)
    kept = session.keep(source)
    assert kept.count() == 10 and list(tmp_path.rglob("*.parquet"))
    session.release(kept)
    assert not list(tmp_path.rglob("*.parquet"))
    session.release(source)
