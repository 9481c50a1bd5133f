"""Forests whose work follows the entries of the vectors, not their width."""

import tempfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import functions as F

from kudoscope.models import forest, text_models
from kudoscope.plans import training


def _rows(shape, dense, y):
    """The entries of a table of bins (0 is the bin of zero) as a task holds them."""
    entries = [[f * shape.bins + b for f, b in enumerate(r) if b] for r in dense]
    packed = pa.array([np.array(e, "<i4").tobytes() for e in entries], pa.binary())
    table = forest.Rows(shape, tempfile.TemporaryFile(), tempfile.TemporaryFile())
    batch = pa.RecordBatch.from_arrays([packed, pa.array(y), pa.array(np.ones(len(y)))], names=["codes", "y", "w"])
    for k in range(0, len(y), 70):
        table.add(batch.slice(k, 70))
    table.close()
    return table


def _sparse(n, width, bins, share, seed=3):
    rng = np.random.default_rng(seed)
    dense = rng.integers(1, bins, (n, width)) * (rng.random((n, width)) < share)
    return dense, dense[:, 0] * 2.0 + (dense[:, 1] > 2) * 5 + rng.random(n)


def test_bins_are_the_cuts_below():
    cuts = np.array([[-1.0, 0.0, 2.0], [0.0, np.inf, np.inf]])
    i, x = np.array([0, 0, 0, 0, 0, 1, 1]), np.array([-2.0, -1.0, 0.5, 2.0, 9.0, -3.0, 4.0])
    assert forest.bins_of(cuts, i, x).tolist() == [0, 0, 2, 2, 3, 0, 1]


@pytest.mark.parametrize("parts", [1, 5])
def test_cuts_are_quantiles_and_zero(spark, parts):
    """Of feature 0 half the rows are zero, 1 is never zero, 2 has two values, 3 none."""
    rows = [([0, 1, 2] if k % 2 else [1, 2], [float(k), k - 500.0 - (k <= 500), 7.0 + k % 3 // 2][k % 2 == 0:]) for k in range(1000)]
    df = spark.createDataFrame(rows, "i array<int>, x array<double>").repartition(parts)
    cuts = forest.thresholds(df, 4, 8, 8)
    assert cuts[0, 0] == 0 and cuts[0, 1:] == pytest.approx([250, 375, 500, 625, 750, 875], abs=40)
    assert cuts[1] == pytest.approx([-375, -250, -125, 0, 125, 250, 375], abs=40)
    assert cuts[2, 0] == 7 and np.isinf(cuts[2, 1:]).all() and np.isinf(cuts[3]).all()
    assert (forest.thresholds(df, 4, 8, 8) == cuts).all()


@pytest.mark.parametrize("classes", [False, True])
def test_best_split_is_that_of_all_splits(classes):
    shape = forest.Shape(12, 8, 3, 12, 1, 5, classes, 0.0)
    dense, y = _sparse(200, 12, 8, 0.3)
    if classes:
        y = (y > np.median(y)).astype(float)
    cuts = np.tile(np.arange(7) + 0.5, (12, 1))
    tree = forest.Tree(_rows(shape, dense, y), cuts, shape, 0)
    root = tree.grow()[0]
    w = tree.times
    impurity = (lambda v, u: np.average((v - np.average(v, weights=u)) ** 2, weights=u)) if not classes else (
        lambda v, u: 2 * np.average(v, weights=u) * (1 - np.average(v, weights=u)))
    best = (0, -1, -1)
    for f in range(12):
        for b in range(7):
            left = dense[:, f] <= b
            if w[left].sum() and w[~left].sum():
                rest = sum(impurity(y[s], w[s]) * w[s].sum() for s in (left, ~left)) / w.sum()
                best = max(best, (impurity(y, w) - rest, f, b))
    assert root[6] == pytest.approx(best[0])
    assert (root[9], root[10]) == (best[1], best[2] + 0.5)


def test_nodes_hold_the_rows_of_their_paths(monkeypatch):
    """Every way to read a node (its entries, its parent less its sibling, columns) agrees."""
    shape = forest.Shape(40, 8, 6, 14, 1, 9, False, 0.0)
    dense, y = _sparse(400, 40, 8, 0.2)
    table, cuts = _rows(shape, dense, y), np.tile(np.arange(7) + 0.5, (40, 1))
    nodes = forest.Tree(table, cuts, shape, 4).grow()
    monkeypatch.setattr(forest.Tree, "reads", lambda self, rows: 0)  # no sums handed down
    assert [n[7:11] for n in forest.Tree(table, cuts, shape, 4).grow()] == [n[7:11] for n in nodes]
    times, weight = forest.Tree(table, cuts, shape, 4).times, {0: np.ones(400, bool)}
    for n in nodes:
        rows = weight[n[0]]
        assert n[1] == pytest.approx(times[rows].sum()) and n[2] == pytest.approx((times * y)[rows].sum())
        if n[9] >= 0:
            left = dense[:, n[9]] <= n[10]
            weight[n[7]], weight[n[8]] = rows & left, rows & ~left


def test_entries_read_do_not_grow_with_the_width(monkeypatch):
    """The same entries in vectors a hundred times as wide: no more of them are read a level."""
    read = []
    plain = forest.Rows.entries
    monkeypatch.setattr(forest.Rows, "entries", lambda self, rows: (read.append(len(c)) or (o, n, c) for o, n, c in plain(self, rows)))
    dense, y = _sparse(300, 50, 8, 0.1)
    wide = np.zeros((300, 5000), int)
    wide[:, ::100] = dense
    shape = forest.Shape(5000, 8, 6, 1667, 1, 5, False, 0.0)
    forest.Tree(_rows(shape, wide, y), np.tile(np.arange(7) + 0.5, (5000, 1)), shape, 0).grow()
    assert 0 < sum(read) <= 3 * 6 * (dense > 0).sum()


def _data(spark, n=600):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(n):
        at = sorted(rng.choice(50, 5, replace=False).tolist())
        v = Vectors.sparse(50, at, rng.random(5).tolist())
        v = Vectors.dense(v.toArray()) if k % 7 == 0 else v
        rows.append((v, float(v[3] > 0) * 9 + float(v[8] > 0) * 4, 1.0 + k % 2))
    return spark.createDataFrame(rows, ["features", "label", "weight"])


def test_model_is_whole_and_can_be_saved(spark, tmp_path):
    data = _data(spark)
    plan = text_models.estimator("random_forest_regressor", 600, trees=30, depth=4)
    model = forest.fit(plan, data)
    assert (model.getNumTrees, model.numFeatures) == (30, 50)
    assert max(t.depth for t in model.trees) == 4 and len({t.toDebugString for t in model.trees}) > 20
    again = forest.fit(plan, data)
    assert [t.numNodes for t in again.trees] == [t.numNodes for t in model.trees]
    error = F.avg((F.col("label") - F.col("prediction")) ** 2) / F.var_pop("label")
    assert model.transform(data).agg(error).first()[0] < 0.5
    model.save(str(tmp_path / "m"))
    same = RandomForestRegressionModel.load(str(tmp_path / "m")).transform(data).agg(F.sum("prediction")).first()[0]
    assert same == pytest.approx(model.transform(data).agg(F.sum("prediction")).first()[0])


def test_classes_have_probabilities(spark):
    data = _data(spark).withColumn("label", (F.col("label") > 0).cast("double"))
    model = forest.fit(text_models.estimator("rf", 600, trees=30, depth=6), data)
    out = model.transform(data).select("label", "prediction", F.unwrap_udt("probability")["values"].alias("p"))
    assert out.where("abs(p[0] + p[1] - 1) > 1e-9").isEmpty()
    assert out.where("label = prediction").count() > 500


def test_other_settings_are_left_to_spark(spark):
    data = _data(spark, 60)
    plan = text_models.estimator("random_forest_regressor", 60, trees=3, depth=2).setMinInstancesPerNode(20)
    assert all(t.numNodes <= 5 for t in forest.fit(plan, data).trees)


def test_bad_numbers_are_refused(spark):
    data = spark.createDataFrame([(Vectors.dense(1.0, float("nan")), 1.0), (Vectors.dense(1.0, 2.0), 0.0)], ["features", "label"])
    with pytest.raises(Exception, match="NaN"):
        forest.fit(text_models.estimator("random_forest_regressor", 2, trees=3), data)


def test_kinds_share_their_vectors(spark, monkeypatch):
    """Three models of one set of rows: the texts become vectors once."""
    rows = [(k, ("good day " if k % 2 else "bad night ") + f"word{k % 5}", k % 2) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, target_is_useful int")
    made = []
    plain = text_models.feature_model
    monkeypatch.setattr(text_models, "feature_model", lambda *a, **k: made.append(1) or plain(*a, **k))
    runs = training.train_models(df, text_models.BINARY_TARGET, ("logreg", "svc", "rf"), "text_tfidf", "doc_id", trees=5)
    assert len(made) == 1
    assert [r.name.rsplit("__", 1)[1] for r in runs] == ["logreg", "svc", "rf"]
    for run in runs:
        got = run.metrics.first()
        assert got["eval_rows"] == 60 and got["roc_auc"] == 1.0
    alone = training.train_model(df, text_models.BINARY_TARGET, "logreg", "text_tfidf", "doc_id")
    assert alone.metrics.first() == runs[0].metrics.first()
