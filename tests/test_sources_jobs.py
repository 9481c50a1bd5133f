import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kudoscope.functions import text
from kudoscope.models import regression, weights
from kudoscope.operators import clean, tfidf
from kudoscope.plans import end_to_end, sweep, training
from kudoscope.session import SETTINGS
from kudoscope.sources import files, ingest, readers, sinks
from kudoscope.streaming import incremental


def write_raw(root, n=60):
    rng = np.random.default_rng(5)
    (root / "reviews").mkdir(parents=True)
    lines = [json.dumps({"review_id": f"r{i}", "user_id": f"u{i % 7}", "business_id": f"b{i % 5}", "stars": 4.0,
                         "date": f"2021-01-{1 + i % 28:02d} 10:00:00", "text": "words " * (2 + i % 9),
                         "useful": int(rng.poisson(i % 9 / 3)), "funny": 0, "cool": i % 2}) for i in range(n)]
    (root / "reviews" / "a.json").write_text("\n".join(lines[: n // 2]) + "\n{bad\n")
    with gzip.open(root / "reviews" / "b.json.gz", "wt") as f:
        f.write("\n".join(lines[n // 2:]))
    (root / "reviews" / "notes.txt").write_text("no")
    (root / "yelp_academic_dataset_business.json").write_text("\n".join(
        json.dumps({"business_id": f"b{i}", "name": "n", "city": f"c{i % 2}", "state": "S", "stars": 3.5, "review_count": i,
                    "categories": "Food, Thai", "is_open": 1, "attributes": {"WiFi": "no"}, "hours": None}) for i in range(5)))
    (root / "yelp_academic_dataset_user.json").write_text("\n".join(
        json.dumps({"user_id": f"u{i}", "review_count": i, "fans": i, "average_stars": 3.0, "elite": "", "yelping_since": "2010-01-01", "useful": 1, "funny": 1, "cool": 1}) for i in range(7)))


def test_find_and_ingest(spark, tmp_path):
    write_raw(tmp_path / "raw")
    raw = str(tmp_path / "raw")
    found = files.find_raw_files(spark, raw, ["review", "user", "businesses", "tip"])
    assert [files.stem(p) for p in found["reviews"]] == ["a", "b"]
    assert len(found["users"]) == 1 and len(found["business"]) == 1 and found["tips"] == []
    out = str(tmp_path / "parquet")
    assert len(ingest.convert(spark, "reviews", found["reviews"], out, limit=1)) == 1
    assert readers.read_shards(spark, "reviews", out).count() == 31
    done = ingest.convert(spark, "reviews", found["reviews"], out, rows_per_file=10)
    assert [files.stem(p) for p in done] == ["b"]
    assert ingest.convert(spark, "reviews", found["reviews"], out) == []
    assert len(ingest.convert(spark, "reviews", found["reviews"], out, force=True)) == 2
    df = readers.read_shards(spark, "reviews", out)
    assert df.count() == 61 and df.where("review_id is null").count() == 1
    assert clean.clean_reviews(df).count() == 60


def test_bad_lines_are_kept_on_request(spark, tmp_path):
    write_raw(tmp_path)
    df = readers.read_raw(spark, "review", str(tmp_path / "reviews" / "a.json"), keep_bad=True).cache()
    assert [r[0] for r in df.where("_corrupt_record is not null").select("_corrupt_record").collect()] == ["{bad"]


def test_readers(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    path = sinks.write_parquet(df, str(tmp_path / "t.parquet"), max_rows=3)
    assert [r["id"] for r in readers.read_table(spark, path, ["id"], 3, "id").collect()] == [0, 1, 2]
    assert readers.resolve_dataset(spark, str(tmp_path), "none.parquet").endswith("t.parquet")
    with pytest.raises(FileNotFoundError):
        readers.resolve_dataset(spark, str(tmp_path / "empty"), "none.parquet")
    with pytest.raises(FileNotFoundError):
        readers.read_shards(spark, "reviews", str(tmp_path / "empty"))
    assert readers.read_clean(spark, "users", str(tmp_path)) is None


def test_incremental_ingest_reads_each_file_once(spark, tmp_path):
    write_raw(tmp_path / "raw")
    args = dict(folder=str(tmp_path / "raw" / "reviews" / "*.json"), target=str(tmp_path / "out"), checkpoint=str(tmp_path / "state"))

    def rows():
        incremental.convert_new_files(
            spark, "reviews", transform=lambda df: clean.clean_reviews(df).withColumns(text.text_stats(F.col("text"))), **args
        ).awaitTermination()
        return spark.read.parquet(args["target"]).count()

    assert rows() == 30
    assert rows() == 30
    (tmp_path / "raw" / "reviews" / "c.json").write_text(json.dumps(
        {"review_id": "x", "user_id": "u", "business_id": "b", "date": "2021-01-01", "text": "ten letters"}))
    assert rows() == 31


def test_raw_files_to_metrics(spark, tmp_path):
    write_raw(tmp_path / "raw", 120)
    settings = sweep.RunSettings(models=regression.ModelSettings(("baseline_mean", "linear_log", "hurdle"), logistic_iterations=20))
    done = end_to_end.run(spark, str(tmp_path / "raw"), str(tmp_path / "work"), settings=settings)
    rows = {r["model"]: r for r in done["metrics"].collect()}
    assert set(rows) == {"baseline_mean", "linear_log", "hurdle"}
    assert 0 <= rows["hurdle"]["roc_auc"] <= 1
    assert (tmp_path / "work" / "features" / "X_train.parquet").exists()
    train, held = done["datasets"]
    assert (train.count(), held.count()) == (96, 24)


def planted(spark, n=3000):
    rng = np.random.default_rng(6)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = np.where(x2 > 0, np.floor(np.exp(1 + 0.6 * x1)), 0)
    rows = [(i, float(a), float(b), int(v)) for i, (a, b, v) in enumerate(zip(x1, x2, y))]
    return spark.createDataFrame(rows, "review_id long, x1 double, x2 double, useful int")


def test_models_beat_the_mean(spark):
    from kudoscope.plans import feature_matrix, master

    df = planted(spark)
    train, held = master.sides_of(master.split_master(df).cache())
    tables = feature_matrix.feature_tables(
        train.select("review_id", "x1", "x2", "target_useful_votes"), held.select("review_id", "x1", "x2", "target_useful_votes"))
    run = training.compare_models(tables, regression.ModelSettings(boosted_rounds=8, boosted_depth=3, poisson_iterations=25))
    rows = {r["model"]: r for r in run.metrics.collect()}
    base = rows["baseline_mean"]["rmse_log1p"]
    assert rows["baseline_mean"]["spearman"] is None
    for name in ("linear_log", "poisson", "boosted", "hurdle"):
        assert rows[name]["rmse_log1p"] < base, name
    assert rows["hurdle"]["roc_auc"] > 0.9
    assert run.best().first()["model"] == "boosted"


def test_hurdle_without_positives(spark):
    df = spark.range(20).select(F.col("id").alias("review_id"), F.rand(1).alias("x"), F.lit(0).alias("y"))
    from kudoscope.plans import feature_matrix

    rows = feature_matrix.assemble(df, ["x"])
    fitted = regression.fit(rows, "y", ["x"], regression.ModelSettings(("hurdle",)))
    assert fitted.predict(rows, "y", "review_id").where("pred_hurdle <> 0").count() == 0


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    assert {r["y"]: r["weight"] for r in weights.class_weights(df, "y").collect()} == pytest.approx({0: 8 / 12, 1: 2.0})


def test_text_model_saved_and_loaded(spark, tmp_path):
    rows = spark.range(80).select(
        F.col("id").alias("review_id"), (F.col("id") % 2).cast("int").alias("target_is_useful"),
        F.when(F.col("id") % 2 == 1, "great tasty food").otherwise("dull slow place").alias("text"),
        F.when(F.col("id") > 5, F.col("id")).alias("review_char_len"))
    s = tfidf.TermSettings(50, 1, (1, 2), ())
    run = training.train_model(rows, "target_is_useful", "LR", "text_tfidf_plus_numeric", settings=s, folder=str(tmp_path))
    assert run.metrics.first()["accuracy"] == 1.0
    preds, table = training.evaluate_saved(spark, f"{tmp_path}/{run.name}", rows, "target_is_useful", sample=40)
    assert preds.count() == 40 and table.first()["roc_auc"] == 1.0
    with pytest.raises(ValueError):
        training.train_model(rows, "target_is_useful", "unknown", settings=s)


def test_overrides():
    base = sweep.RunSettings()
    out = sweep.with_overrides(base, {"features.terms.min_df": 2, "min_total_votes": 3})
    assert out.features.terms.min_df == 2 and out.min_total_votes == 3 and base.min_total_votes == 0
    with pytest.raises(KeyError):
        sweep.with_overrides(base, {"features.absent": 1})


def test_overwrite_replaces_all_partitions(spark, tmp_path):
    from kudoscope.sources import sinks

    path = str(tmp_path / "sides")
    rows = spark.createDataFrame([(1, "train"), (2, "eval")], "v int, side string")
    sinks.write_parquet(rows, path, partition_by=["side"])
    sinks.write_parquet(rows.where("side = 'train'"), path, partition_by=["side"])
    assert [r.v for r in spark.read.parquet(path).collect()] == [1]


def test_files_that_differ_by_their_ending_are_two_shards(spark, tmp_path):
    import gzip

    raw, out = tmp_path / "reviews", str(tmp_path / "parquet")
    raw.mkdir()
    (raw / "a.json").write_text('{"review_id": "r1"}\n')
    assert len(ingest.convert(spark, "reviews", [str(raw / "a.json")], out)) == 1
    (raw / "a.json.gz").write_bytes(gzip.compress(b'{"review_id": "r2"}\n{"review_id": "r3"}\n'))
    paths = [str(raw / "a.json"), str(raw / "a.json.gz")]
    assert ingest.convert(spark, "reviews", paths, out) == paths[1:]
    assert ingest.convert(spark, "reviews", paths, out) == []
    assert sorted(r["review_id"] for r in readers.read_shards(spark, "reviews", out).collect()) == ["r1", "r2", "r3"]


def test_shard_names_need_no_split(spark):
    df = spark.createDataFrame([("file:/a%20b/c%20d.json.gz",), ("plain.json",)], "p string")
    out = df.select(ingest.shard_of(F.col("p")).alias("s"))
    assert [r["s"] for r in out.collect()] == ["c d.json.gz", "plain.json"]
    assert "split(" not in out._jdf.queryExecution().executedPlan().toString()
    assert "spark.sql.maxConcurrentOutputFileWriters" in SETTINGS


def test_tables_by_side_are_written_side_by_side(spark, tmp_path):
    from kudoscope.session import configure

    configure(spark)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "4"
    path = str(tmp_path / "t")
    # more sides than open files: the rest is sorted as before
    spark.range(40).selectExpr("id", "id % 9 AS side").write.partitionBy("side").parquet(path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(40))
