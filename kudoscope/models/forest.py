"""Random forests on sparse vectors, for counts and 0/1 labels.

Spark's forest reads a bin of every feature for each row, tree and level, and its
histograms are as wide as the vectors.  Here a row costs its entries that are not zero:
what a feature's zero holds is the node's total less the other bins, and of two children
only the smaller one is read, as the other is their parent less it.

Trees are dealt to tasks.  A task reads the binned rows once, a batch at a time, into an
unnamed file of its own and grows its trees one after the other from there, so its
memory does not hold the rows.  The result is Spark's own model of the estimator given:
its trees, depth, bins, feature shares, bootstrap and impurity.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kudoscope.session import delete, keep, release, work_folder

POINTS = 4  # values of a feature that a batch sends, for every bin
CHUNK = 1 << 19  # entries added up at a time
TASKS = 4  # tasks a core
PART = 1 << 15  # rows sorted by feature together
CELL = np.dtype([("row", "<u2"), ("bin", "u1")])
NOTHING = 1e-10  # share of a node's weight that is an error of rounding


@dataclass(frozen=True)
class Shape:
    """What a forest is made of, without Spark objects."""

    width: int
    bins: int  # a power of two
    depth: int
    subset: int
    trees: int
    seed: int
    classes: bool
    gain: float


def fit(estimator, data: DataFrame):
    """The model that ``estimator`` describes, fitted on ``data``; what is not covered here
    (more than two classes, settings of nodes, no folder for the model) is left to Spark."""
    spark = data.sparkSession
    is_class = isinstance(estimator, RandomForestClassifier)
    get = lambda p: estimator.getOrDefault(p)
    weight = get("weightCol") if estimator.isSet("weightCol") else None
    label = F.col(get("labelCol")).cast("double").alias("y")
    own = data.select(
        F.unwrap_udt(F.col(get("featuresCol"))).alias("v"),
        label,
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
    )
    labels = sorted(r[0] for r in own.select("y").distinct().limit(3).collect() if r[0] is not None) if is_class else [0.0]
    first = data.select(get("featuresCol")).first()
    plain = (
        get("minInstancesPerNode") == 1 and get("minWeightFractionPerNode") == 0.0 and get("subsamplingRate") == 1.0
        and get("bootstrap") and get("numTrees") > 1 and get("featureSubsetStrategy") == "auto"
        and get("impurity") in ("gini", "variance") and 2 < get("maxBins") <= 256
    )
    if first is None or first[0] is None or not plain or (is_class and labels != [0.0, 1.0]):
        return estimator.fit(data)
    try:
        folder = work_folder(spark)
    except ValueError:
        return estimator.fit(data)
    width = len(first[0])
    shape = Shape(
        width, 1 << math.ceil(math.log2(get("maxBins"))), get("maxDepth"),
        math.ceil(math.sqrt(width)) if is_class else math.ceil(width / 3),
        get("numTrees"), get("seed") & 0xFFFFFFFF, is_class, get("minInfoGain"),
    )
    entries = own.select(
        "y", "w", F.coalesce(F.col("v.indices"), F.sequence(F.lit(0), F.size("v.values") - 1)).alias("i"), F.col("v.values").alias("x")
    )
    cuts = thresholds(entries, width, get("maxBins"), shape.bins)
    binned = keep(entries.mapInArrow(_binned(spark.sparkContext.broadcast(cuts), shape.bins), "codes binary, y double, w double"))
    try:
        return _grown(estimator, binned, cuts, shape, labels, weight, folder)
    finally:
        release(binned)
        delete(spark, folder)


def thresholds(entries: DataFrame, width: int, most: int, bins: int) -> np.ndarray:
    """At most ``most`` - 1 cuts of each feature, rows padded with infinity: quantiles of
    the values that are not zero, and zero itself where it parts some rows.

    A batch sends ``POINTS`` * ``most`` of a feature's sorted values at most, each with the
    number of values it stands for.  Whatever order they come in, the cuts are the same."""
    rows = entries.count()
    found = entries.select("i", "x").mapInArrow(_points(POINTS * most), "i int, x double, n bigint, low double").groupBy("i").agg(
        F.percentile("x", [k / most for k in range(1, most)], F.col("n")).alias("q"),
        F.min("low").alias("low"), F.max("x").alias("top"), F.sum("n").alias("n"),
    ).toArrow()  # one row a feature
    cuts = np.full((width, bins - 1), np.inf)
    for i, q, low, top, n in zip(*(found[c].to_pylist() for c in ("i", "q", "low", "top", "n"))):
        if n < rows:
            low, top = min(low, 0.0), max(top, 0.0)
        own = np.unique(np.append(q, 0.0))
        own = own[(own >= low) & (own < top)]
        if len(own) >= most:  # zero and all quantiles: that next to zero goes
            own = np.delete(own, np.abs(np.where(own == 0, np.inf, own)).argmin())
        cuts[i, : len(own)] = own
    return cuts


def _points(most: int):
    """Of each feature in a batch: the last value of every run of equally many, how many
    those are, and the feature's lowest value."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, x = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("i", "x"))
            if np.isnan(x).any():
                raise ValueError("a feature is NaN")
            i, x = i[x != 0], x[x != 0]
            order = np.lexsort((x, i))
            i, x = i[order], x[order]
            first = np.flatnonzero(np.diff(i, prepend=-1))
            count = np.diff(first, append=len(i))
            rank = np.arange(len(i)) - np.repeat(first, count)
            run = np.repeat(-(-count // most), count)
            last = (rank % run == run - 1) | (rank == np.repeat(count, count) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i[last], pa.int32()), pa.array(x[last]), pa.array((rank % run + 1)[last], pa.int64()), pa.array(x[np.repeat(first, count)[last]])],
                names=["i", "x", "n", "low"],
            )

    return of


def bins_of(cuts: np.ndarray, i: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Number of cuts of feature ``i`` below ``x``, by halving."""
    width = cuts.shape[1] + 1
    flat, start = cuts.ravel(), i.astype(np.int64) * (width - 1)
    at = np.zeros(len(i), np.int64)
    step = width // 2
    while step:
        at += step * (flat[start + at + step - 1] < x)
        step //= 2
    return at


def _binned(shared, bins: int):
    """Per row: the numbers feature * bins + bin of its entries."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        for b in batches:
            y, w, places = b.column("y"), b.column("w"), b.column("i")
            for name, c in (("label", y), ("weight", w)):
                if c.null_count or not np.isfinite(c.to_numpy(zero_copy_only=False)).all():
                    raise ValueError(f"a {name} is null or not finite")
            i, x = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("i", "x"))
            if np.isnan(x).any():
                raise ValueError("a feature is NaN")
            some = x != 0
            ends = np.concatenate([[0], np.cumsum(some)])[np.concatenate([[0], np.cumsum(np.diff(places.offsets.to_numpy()))])]
            i, x = i[some], x[some]
            codes = (i.astype(np.int64) * bins + bins_of(cuts, i, x)).astype("<i4")
            packed = pa.Array.from_buffers(
                pa.binary(), len(y), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(codes)]
            )
            yield pa.RecordBatch.from_arrays([packed, y, w], names=["codes", "y", "w"])

    return of


def _grown(estimator, binned: DataFrame, cuts: np.ndarray, shape: Shape, labels, weight: str | None, folder: str):
    """Trees grown in tasks, written in the form in which Spark saves a model, and loaded."""
    spark = binned.sparkSession
    kind = RandomForestClassificationModel if shape.classes else RandomForestRegressionModel
    schema = T.StructType([
        T.StructField(estimator.getFeaturesCol(), VectorUDT()), T.StructField(estimator.getLabelCol(), T.DoubleType()),
        *([T.StructField(weight, T.DoubleType())] if weight else []),
    ])
    rows = [(SparseVector(shape.width, {}), y, *([1.0] if weight else [])) for y in labels]
    # names, settings and the form of the files come from Spark's own model of no splits
    estimator.fit(spark.createDataFrame(rows, schema)).save(f"{folder}/forest")
    form = spark.read.parquet(f"{folder}/forest/data").schema
    tasks = min(shape.trees, TASKS * spark.sparkContext.defaultParallelism)
    shared = spark.sparkContext.broadcast(cuts)
    grow = _grow(shared, shape, tasks)
    parts = [binned.coalesce(1).withColumn("task", F.lit(t)).mapInArrow(grow, form) for t in range(tasks)]
    was = spark.conf.get(UNION, None)
    spark.conf.set(UNION, "false")  # else tables of one partition each may become one task
    try:
        reduce(DataFrame.union, parts).write.mode("overwrite").parquet(f"{folder}/forest/data")
    finally:
        spark.conf.unset(UNION) if was is None else spark.conf.set(UNION, was)
    return kind.load(f"{folder}/forest")


UNION = "spark.sql.unionOutputPartitioning"


def _grow(shared, shape: Shape, tasks: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryFile() as by_row, tempfile.TemporaryFile() as by_column:
            table, task = Rows(shape, by_row, by_column), None
            for b in batches:
                for part in (b.slice(k, PART) for k in range(0, b.num_rows, PART)):
                    table.add(part)
                    task = part.column("task")[0].as_py()
            if task is None:
                return
            table.close()
            for tree in range(task, shape.trees, tasks):
                yield _saved(tree, Tree(table, shared.value, shape, tree).grow(), shape)

    return of


class Rows:
    """Entries in files, by row and (of up to ``PART`` rows each) by feature; labels, weights
    and where a row or feature starts in memory."""

    def __init__(self, shape: Shape, by_row, by_column) -> None:
        self.shape, self.files = shape, (by_row, by_column)
        self.shift = shape.bins.bit_length() - 1
        self.sizes, self.ys, self.ws = [], [], []
        self.columns: list[np.ndarray] = []  # per part: where a feature's entries end

    def add(self, b: pa.RecordBatch) -> None:
        packed = b.column("codes")
        ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
        data = packed.buffers()[2]
        codes = np.frombuffer(data, "<i4", (ends[-1] - ends[0]) // 4, ends[0]) if data and ends[-1] > ends[0] else np.empty(0, "<i4")
        size = np.diff(ends) // 4
        self.files[0].write(codes)
        feature = codes >> self.shift
        order = np.argsort(feature.astype(np.uint16) if self.shape.width <= 1 << 16 else feature, kind="stable")
        cells = np.empty(len(codes), CELL)
        cells["row"] = np.repeat(np.arange(len(size)), size)[order]
        cells["bin"] = (codes & (self.shape.bins - 1))[order]
        self.files[1].write(cells)
        self.columns.append(np.cumsum(np.bincount(feature, minlength=self.shape.width)).astype(np.int32))
        self.sizes.append(size)
        self.ys.append(np.array(b.column("y")))  # copies: the batch is not held
        self.ws.append(np.array(b.column("w")))

    def close(self) -> None:
        for f in self.files:
            f.flush()
        size = np.concatenate(self.sizes)
        self.first = np.concatenate([[0], np.cumsum([len(n) for n in self.sizes])])  # row of each part
        self.start = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        self.y, self.w = np.concatenate(self.ys), np.concatenate(self.ws)
        some = self.start[-1] > 0
        self.codes = np.memmap(self.files[0], "<i4", "r").view(np.ndarray) if some else np.empty(0, "<i4")
        self.cells = np.memmap(self.files[1], CELL, "r").view(np.ndarray) if some else np.empty(0, CELL)

    def entries(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A bounded number of entries at a time: their rows, how many each has, and codes."""
        size = self.start[rows + 1] - self.start[rows]
        ends = np.cumsum(size)
        at = 0
        while at < len(rows):
            before = ends[at - 1] if at else 0
            to = max(int(np.searchsorted(ends, before + CHUNK, "right")), at + 1)
            own, n = rows[at:to], size[at:to]
            first = np.repeat(self.start[own] - (ends[at:to] - n - before), n)
            first += np.arange(len(first))
            yield own, n, self.codes[first]
            at = to

    def column(self, feature: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and bins of a feature's entries, part by part."""
        for part, ends in enumerate(self.columns):
            low, top = int(ends[feature - 1]) if feature else 0, int(ends[feature])
            if top > low:
                at = self.start[self.first[part]]
                own = self.cells[at + low : at + top]
                yield self.first[part] + own["row"].astype(np.int64), own["bin"]


class Tree:
    """One tree on a bootstrap sample: nodes in the order of a walk, left before right."""

    def __init__(self, rows: Rows, cuts: np.ndarray, shape: Shape, number: int) -> None:
        self.rows, self.cuts, self.shape = rows, cuts, shape
        self.random = np.random.default_rng([shape.seed, number])
        self.zero = (cuts < 0).sum(axis=1)  # bin of zero
        self.times = self.random.poisson(1.0, len(rows.y)).astype(np.int32)
        self.w = self.times * rows.w
        self.wy = self.w * rows.y
        self.side = np.empty(len(rows.y), bool)  # of each row at the split in hand
        self.cells = shape.width * shape.bins
        self.nodes: list[tuple] = []

    def grow(self) -> list[tuple]:
        todo = [(np.flatnonzero(self.times), 0, None, -1, None)]
        while todo:
            rows, depth, sums, parent, side = todo.pop()
            at = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][side] = at
            w, y = self.w[rows], self.rows.y[rows]
            total, mean = w.sum(), 0.0
            if total > 0:
                mean = float(w @ y / total)
            spread = float(w @ (y - mean) ** 2)
            node = [at, total, float(self.wy[rows].sum()), float(w @ (y * y)), int(self.times[rows].sum()), spread, -1.0, -1, -1, -1, 0.0]
            self.nodes.append(node)
            if depth >= self.shape.depth or len(rows) < 2 or spread <= NOTHING * total * max(1.0, mean * mean):
                continue
            found, sums = self.best(rows, total, mean, sums)
            if found is None:
                continue
            gain, feature, bin_ = found
            gain /= total
            if self.shape.classes:
                gain *= 2  # Gini's impurity of 0/1 labels is twice their variance
            if gain <= 0 or gain < self.shape.gain:
                continue
            left = self.goes_left(rows, feature, bin_)
            halves = rows[left], rows[~left]
            if not (len(halves[0]) and len(halves[1])):
                continue
            node[6], node[9], node[10] = gain, feature, float(self.cuts[feature, bin_])
            own = [None, None]
            few = int(len(halves[0]) > len(halves[1]))
            if depth + 1 < self.shape.depth and sums is not None and self.reads(halves[1 - few]) > self.cells / 4:
                less = self.sums(halves[few])
                own[1 - few] = [a - b for a, b in zip(sums, less)]
                if self.reads(halves[few]) > self.cells / 4:
                    own[few] = less
            todo.append((halves[1], depth + 1, own[1], at, 8))
            todo.append((halves[0], depth + 1, own[0], at, 7))
        return self.nodes

    def reads(self, rows: np.ndarray) -> int:
        return int((self.rows.start[rows + 1] - self.rows.start[rows]).sum())

    def sums(self, rows: np.ndarray) -> list[np.ndarray]:
        """Weight and weighted label of every cell (feature, bin), zeros left out."""
        out = [np.zeros(self.cells), np.zeros(self.cells)]
        for own, n, codes in self.rows.entries(rows):
            for s, v in zip(out, (self.w, self.wy)):
                s += np.bincount(codes, np.repeat(v[own], n), self.cells)
        return out

    def best(self, rows: np.ndarray, total: float, mean: float, sums) -> tuple[tuple | None, list | None]:
        """Gain (of the summed squares), feature and bin of the best split among the
        node's share of the features, and the sums of all cells where they were made."""
        features = self.random.choice(self.shape.width, self.shape.subset, replace=False, shuffle=False)
        bins = self.shape.bins
        if sums is None and self.reads(rows) > self.cells / 4:
            sums = self.sums(rows)
        if sums is not None:
            w, s = (a.reshape(-1, bins)[features] for a in sums)
        else:
            place = np.full(self.shape.width, -1)
            place[features] = np.arange(len(features))
            small = len(features) * bins
            w, s = np.zeros(small), np.zeros(small)
            for own, n, codes in self.rows.entries(rows):
                at = place[codes >> self.rows.shift]
                some = np.flatnonzero(at >= 0)
                cell = at[some] * bins + (codes[some] & (bins - 1))
                row = np.repeat(own, n)[some]
                w += np.bincount(cell, self.w[row], small)
                s += np.bincount(cell, self.wy[row], small)
            w, s = w.reshape(-1, bins), s.reshape(-1, bins)
        seen = w.sum(axis=1)
        some = np.flatnonzero(seen > NOTHING * total)  # all rows are in one bin of the others
        if not len(some):
            return None, sums
        features, w, s, seen = features[some], w[some], s[some], seen[some]
        # labels less the mean of the node: a gain is then a sum of squares
        s -= mean * w
        each, zero = np.arange(len(features)), self.zero[features]
        w[each, zero] += total - seen
        s[each, zero] -= s.sum(axis=1)
        w, s = w.cumsum(axis=1)[:, :-1], s.cumsum(axis=1)[:, :-1]
        both = w * (total - w)
        both[both <= NOTHING * total * total] = np.inf  # a side without rows
        np.multiply(s, s, out=s)
        gain = np.divide(s, both, out=s)
        gain *= total
        top = int(gain.argmax())
        feature, bin_ = divmod(top, bins - 1)
        if gain[feature, bin_] <= 0:
            return None, sums
        return (float(gain[feature, bin_]), int(features[feature]), bin_), sums

    def goes_left(self, rows: np.ndarray, feature: int, bin_: int) -> np.ndarray:
        few = self.zero[feature] <= bin_
        if self.reads(rows) < len(self.times) // 8:
            left, done = np.full(len(rows), few), 0
            for own, n, codes in self.rows.entries(rows):
                hit = np.flatnonzero(codes >> self.rows.shift == feature)
                at = np.searchsorted(np.cumsum(n), hit, "right")
                left[done + at] = (codes[hit] & (self.shape.bins - 1)) <= bin_
                done += len(own)
            return left
        self.side.fill(few)
        for own, bins in self.rows.column(feature):
            self.side[own] = bins <= bin_
        return self.side[rows]


def _saved(tree: int, nodes: list[tuple], shape: Shape) -> pa.RecordBatch:
    """The nodes of a tree as Spark saves them."""
    at, w, wy, wyy, times, spread, gain, left, right, feature, cut = (np.array(c) for c in zip(*nodes))
    inner = feature >= 0
    if shape.classes:
        stats = np.stack([w - wy, wy], axis=1)
        guess, impurity = (wy > w - wy).astype(float), 2 * spread / w
    else:
        stats, guess, impurity = np.stack([w, wy, wyy], axis=1), wy / w, spread / w
    n = len(at)
    lists = lambda ends, v: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.float64()))
    split = pa.StructArray.from_arrays(
        [
            pa.array(feature, pa.int32()),
            lists(np.concatenate([[0], np.cumsum(inner)]), cut[inner]),
            pa.array(np.full(n, -1), pa.int32()),
        ],
        names=["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
    )
    columns = {
        "id": pa.array(at, pa.int32()), "prediction": pa.array(guess), "impurity": pa.array(impurity),
        "impurityStats": lists(np.arange(n + 1) * stats.shape[1], stats.ravel()),
        "rawCount": pa.array(times, pa.int64()), "gain": pa.array(gain),
        "leftChild": pa.array(left, pa.int32()), "rightChild": pa.array(right, pa.int32()), "split": split,
    }
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, tree), pa.int32()), pa.StructArray.from_arrays(list(columns.values()), names=list(columns))],
        names=["treeID", "nodeData"],
    )
