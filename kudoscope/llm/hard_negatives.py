"""Hard negatives by exact inner products of anchors and all rows.

Vectors become integers (``floor(scale * x)``).  Anchors and candidates are
dealt to tiles of bounded size by a hash of the whole row, and a cell is one
anchor tile against one candidate tile: the stated anchors against all rows, in
blocks.  In a cell the scores are one matrix product, made by Strassen's
recursion on zero-padded int64 blocks.  Every cell keeps a heap of its best rows
for every anchor; heaps of cells merge by a ranked window with a limit, which
Spark applies before its shuffle too.

Two passes: the positives (cells inside a label, so only rows that can be
positives are multiplied), then the negatives in the score windows that the
positives open (all rows).

Rows without a label, without a vector, or with a null or non-finite component
take no part.  Rows that are equal in id, label and vector count once; other
rows with an id of their own or the same id are rows of their own.  A null id is
never an anchor's unless the condition says so, and comes last among ties.  A
shorter vector is one that ends in zeros.  Components outside the range of a
long are cut to it, and scores are exact wherever they fit a long (arithmetic is
modulo 2^64).  An empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kudoscope.llm.common import written

ANCHOR_TILE, ROW_TILE = 512, 4096  # rows of a tile, about
LEAF = 32  # a dimension that is multiplied without a further split
SALTS = 64


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of int64 matrices by Strassen's recursion."""
    (m, k), n = a.shape, b.shape[0]
    if min(m, k, n) <= LEAF:
        return np.einsum("ik,jk->ij", a, b)
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, n % 2), (0, k % 2)))
    i, h, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[0] // 2
    a11, a12, a21, a22 = a[:i, :h], a[:i, h:], a[i:, :h], a[i:, h:]
    b11, b12, b21, b22 = b[:j, :h], b[j:, :h], b[:j, h:], b[j:, h:]  # of the transposed matrix
    p1 = product(a11 + a22, b11 + b22)
    p2 = product(a21 + a22, b11)
    p3 = product(a11, b12 - b22)
    p4 = product(a22, b21 - b11)
    p5 = product(a11 + a12, b22)
    p6 = product(a21 - a11, b11 + b12)
    p7 = product(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * j), dtype=np.int64)
    out[:i, :j] = p1 + p4 - p5 + p7
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def integer_rows(df: DataFrame, row_id: str, vector: str, label: Column, scale: int) -> DataFrame:
    """``id``, ``label``, ``v`` (integers) and ``key`` (hash) of all usable rows."""
    bad = F.exists("x", lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
    rows = (
        df.select(F.col(row_id).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector).alias("x"))
        .where(F.col("label").isNotNull() & ~bad)
        .select("id", "label", F.transform("x", lambda y: F.floor(y.cast("double") * scale).cast("bigint")).alias("v"))
        .distinct()
    )
    return rows.withColumn("key", F.xxhash64("id", "label", "v"))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _scores(anchors: pd.DataFrame, rows: pd.DataFrame) -> np.ndarray:
    width = max(1, max(map(len, anchors.v)), max(map(len, rows.v)))
    return product(_matrix(anchors.v, width), _matrix(rows.v, width))


def _best(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the highest scores, earlier places first among equals."""
    if len(scores) > most:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.argsort(-scores[at], kind="stable")][:most]


POSITIVES = "anchor_id bigint, anchor_key bigint, positive_id bigint, positive_score bigint"


def _positives(anchors: pd.DataFrame, rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """A cell's best rows for each of its anchors."""
    parts = []
    if len(anchors) and len(rows):
        rows = rows.sort_values("id", kind="stable", na_position="last")
        scores, keys, ids = _scores(anchors, rows), rows.key.to_numpy(), rows.id.to_numpy()
        for k, (anchor, own) in enumerate(zip(anchors.id, anchors.key)):
            others = np.flatnonzero(keys != own)
            at = others[_best(scores[k, others], most)]
            parts.append(pd.DataFrame({"anchor_id": anchor, "anchor_key": own, "positive_id": ids[at], "positive_score": scores[k, at]}))
    return pd.concat(parts) if parts else pd.DataFrame(columns=["anchor_id", "anchor_key", "positive_id", "positive_score"])


NEGATIVES = POSITIVES + ", place int, negative_id bigint, negative_score bigint"


def _negatives(anchors: pd.DataFrame, rows: pd.DataFrame, most: int, low: tuple[int, int], high: tuple[int, int]) -> pd.DataFrame:
    """A cell's best rows of other labels in the window of each positive."""
    out = []
    if len(anchors) and len(rows):
        rows = rows.sort_values("id", kind="stable", na_position="last")
        scores, labels, ids = _scores(anchors, rows), rows.label.to_numpy(), rows.id.to_numpy()
        for k, (anchor, own, label, found) in enumerate(zip(anchors.id, anchors.key, anchors.label, anchors.positives)):
            windows = [(p, *_window(int(p["positive_score"]), low, high)) for p in found]
            least = min(w[1] for w in windows)
            at = np.flatnonzero((scores[k] >= least) & (labels != label))
            at = at[np.argsort(-scores[k, at], kind="stable")]
            falling = -scores[k, at]
            for p, lo, hi in windows:
                first = np.searchsorted(falling, -hi, "left")
                for i in at[first : first + most]:
                    if scores[k, i] >= lo:
                        out.append((anchor, own, p["positive_id"], p["positive_score"], p["place"], ids[i], scores[k, i]))
    return pd.DataFrame(out, columns=["anchor_id", "anchor_key", "positive_id", "positive_score", "place", "negative_id", "negative_score"])


def _window(score: int, low: tuple[int, int], high: tuple[int, int]) -> tuple[int, int]:
    """Least and greatest whole score between the two shares of ``score``."""
    return -(-score * low[0] // low[1]), score * high[0] // high[1]


def _heap(df: DataFrame, by: list[str], score: str, row_id: str, most: int, rank: str) -> DataFrame:
    """The ``most`` best rows of every group: cells' heaps merged to one."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_last(row_id))
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= most)


def _cells(anchors: DataFrame, rows: DataFrame, by: list[str], work, schema: str) -> DataFrame:
    """Anchors copied to every row tile of theirs, rows to every anchor tile."""
    tile = lambda n: F.pmod("key", n).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    left = anchors.withColumn("a", tile("anchor_tiles")).withColumn("c", copies("row_tiles"))
    right = rows.where("anchor_tiles > 0").withColumn("c", tile("row_tiles")).withColumn("a", copies("anchor_tiles"))
    keys = [*by, "a", "c"]
    # both sides come from one table: new names keep their columns apart
    left, right = (x.drop("anchor_tiles", "row_tiles") for x in (left, right))
    left, right = (x.toDF(*x.columns) for x in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(work, schema)


def _tiles(count: Column, size: int) -> Column:
    return F.ceil(count / size)


def mine(
    df: DataFrame,
    is_anchor: Column,
    row_id: str = "vec_id",
    vector: str = "embedding",
    label: Column | None = None,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low: tuple[int, int] = (1, 2),
    high: tuple[int, int] = (19, 20),
    anchor_tile: int = ANCHOR_TILE,
    row_tile: int = ROW_TILE,
) -> DataFrame:
    """For every anchor and each of its first ``positives`` rows of the same
    label, the first ``negatives`` rows of other labels that score between the
    shares ``low`` and ``high`` of the positive's score.

    ``is_anchor`` is a condition on the column ``id``."""
    rows = written(integer_rows(df, row_id, vector, F.col("label") if label is None else label, scale))
    rows = rows.withColumn("anchor", F.coalesce(is_anchor, F.lit(False)))
    salt = F.pmod("key", F.lit(SALTS)).cast("bigint")
    sizes = (
        rows.groupBy("label")
        .agg(
            _tiles(F.count_if("anchor"), anchor_tile).alias("anchor_tiles"),
            _tiles(F.count("*"), row_tile).alias("row_tiles"),
        )
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    )
    sized = rows.withColumn("salt", salt).join(sizes, ["label", "salt"]).drop("salt")
    found = _cells(
        sized.where("anchor").drop("anchor"), sized.drop("anchor"), ["label"], partial(_positives, most=positives), POSITIVES
    )
    best = _heap(found, ["anchor_id", "anchor_key"], "positive_score", "positive_id", positives, "place")
    opened = best.groupBy(F.col("anchor_id").alias("id"), F.col("anchor_key").alias("key")).agg(
        F.collect_list(F.struct("place", "positive_id", "positive_score")).alias("positives")  # a heap, of bounded size
    )
    n = rows.agg(_tiles(F.count_if("anchor"), anchor_tile).alias("a"), _tiles(F.count("*"), row_tile).alias("r")).first()
    tiles = {"anchor_tiles": F.lit(max(1, n["a"])), "row_tiles": F.lit(max(1, n["r"]))}
    anchors = rows.where("anchor").drop("anchor").join(opened, ["id", "key"])
    chosen = _cells(
        anchors.withColumns(tiles),
        rows.drop("anchor").withColumns(tiles),
        [],
        partial(_negatives, most=negatives, low=low, high=high),
        NEGATIVES,
    )
    return _heap(chosen, ["anchor_id", "anchor_key", "place"], "negative_score", "negative_id", negatives, "rank").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
