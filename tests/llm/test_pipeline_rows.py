"""Which rows the pipeline's near-duplicate stage keeps, and the files it gives back."""

import corpus_pipeline
from kudoscope.llm import near_duplicates
from kudoscope.llm.common import written


def test_map_columns_and_repeated_rows(spark):
    text = "the quick brown fox jumps over the lazy dog while seven wizards watch from the old stone tower"
    rows = [(1, text, {"a": 1, "b": 2}, [{"x": "y"}]), (1, text, {"b": 2, "a": 1}, [{"x": "y"}]), (2, text, None, None), (3, "something else entirely", {}, [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>, more array<map<string,string>>")
    got = near_duplicates.deduplicated(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"], r["tags"]) for r in got.collect()) == [(1, {"a": 1, "b": 2}), (3, {})]


def test_stages_give_their_input_back(spark, monkeypatch, tmp_path):
    made, gone = [], []
    monkeypatch.setattr(corpus_pipeline, "written", lambda df: made.append(written(df)) or made[-1])
    monkeypatch.setattr(corpus_pipeline, "forget", lambda df: gone.append(df))
    same = lambda spark, docs, sf_dir: docs
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(k), same) for k in range(5)])
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 1 and len(made) == 4 and gone == made[:3]
