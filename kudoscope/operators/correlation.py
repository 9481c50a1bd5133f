"""Pearson and Spearman correlation, null pairs dropped pair by pair."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kudoscope.operators.joins import salted_lookup
from kudoscope.operators.ranks import running_total
from kudoscope.session import keep

Pair = tuple[str, str]
FEW_VALUES = 20_000  # the ranks of a column with so many values are broadcast


def all_pairs(columns: Sequence[str]) -> list[Pair]:
    return list(combinations(columns, 2))


def pearson_value(x: Column, y: Column) -> Column:
    """Aggregate: correlation of a pair, null when either side is constant."""
    x1, y1 = F.when(y.isNotNull(), x.cast("double")), F.when(x.isNotNull(), y.cast("double"))
    spread = F.stddev_pop(x1) * F.stddev_pop(y1)
    return F.covar_pop(x1, y1) / F.when(spread > 0, spread)


def pearson(df: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    """One row per pair (``left``, ``right``, ``correlation``); one scan."""
    wide = df.agg(
        *[pearson_value(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("left"),
                F.lit(b).alias("right"),
                F.col(f"c{i}").alias("correlation"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(F.inline(rows))


def grouped_spearman(
    df: DataFrame, by: Sequence[str], x: str, y: str, discrete: bool = False
) -> DataFrame:
    """Spearman correlation per group: ``by``, ``rows``, ``correlation``.

    Works on the counts of distinct ``(x, y)`` pairs, so repeated values are
    folded before anything is ranked or joined.
    """
    by = list(by)
    joint = df.dropna(subset=[x, y]).groupBy(*by, x, y).agg(F.count("*").alias("n"))
    ranked = joint
    for side in (x, y):
        margin = joint.groupBy(*by, side).agg(F.sum("n").alias("n"))
        cum = running_total(margin, side, ["n"], by, discrete)
        centred = F.col("n_upto") - (F.col("n") - 1) / F.lit(2.0) - (F.col("n_all") + 1) / F.lit(2.0)
        # the joined rows are distinct pairs; AQE splits a value with very many partners
        ranked = ranked.join(cum.select(*by, side, centred.alias(f"_r_{side}")), [*by, side])
    n, rx, ry = F.col("n"), F.col(f"_r_{x}"), F.col(f"_r_{y}")
    sums = ranked.groupBy(*by).agg(
        F.sum("n").cast("bigint").alias("rows"),
        F.sum(n * rx * ry).alias("_xy"),
        F.sum(n * rx * rx).alias("_xx"),
        F.sum(n * ry * ry).alias("_yy"),
    )
    spread = F.sqrt(F.col("_xx")) * F.sqrt(F.col("_yy"))
    return sums.select(
        *by, "rows", (F.col("_xy") / F.when(spread > 0, spread)).alias("correlation")
    )


def spearman(df: DataFrame, pairs: Sequence[Pair], discrete: bool = False) -> DataFrame:
    """One row per pair (``left``, ``right``, ``rows``, ``correlation``)."""
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("left"),
                F.lit(b).alias("right"),
                F.col(a).cast("double").alias("x"),
                F.col(b).cast("double").alias("y"),
            )
            for a, b in pairs
        ]
    )
    return grouped_spearman(df.select(F.inline(rows)), ["left", "right"], "x", "y", discrete)


def spearman_matrix(df: DataFrame, columns: Sequence[str], row_key: str) -> DataFrame:
    """All pairs of many columns: ``left``, ``right``, ``rows``, ``correlation``.

    Every pair counts the rows where both are filled, so a value has a rank of its
    own for each partner column.  Rows are folded to ``(column, value, mask of the
    filled columns)``; from the masks come, for every value of a column, the rows
    in which each partner is filled; one running total per column then gives all
    its ranks at once, and these tables give the spread of the ranks.  Only the products
    need the rows: a row meets the ranks of a column with few values (counted) in the
    task that holds it, and is dealt out once for each column with many, by value,
    hot ones spread by ``row_key``.
    """
    columns = list(columns)
    size = len(columns)
    filled = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns]
    mask = sum((F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(filled)), F.lit(0)).cast("bigint")
    values = [f"_v{i}" for i in range(size)]
    wide = keep(df.select(
        F.col(row_key).alias("_row"), mask.alias("_mask"),
        *[F.when(f, F.col(c).cast("double")).alias(v) for f, c, v in zip(filled, columns, values)],
    ))
    cells = F.array(*[F.struct(F.lit(i).alias("column"), F.col(v).alias("value")) for i, v in enumerate(values)])
    long = wide.select("_mask", F.inline(cells)).where("value is not null")
    folded = long.groupBy("column", "value", "_mask").agg(F.count("*").alias("n"))
    partners = [f"_p{i}" for i in range(size)]
    beside = keep(folded.groupBy("column", "value").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.when(F.col("_mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)).alias(p) for i, p in enumerate(partners)],
    ))
    cum = running_total(beside, "value", partners, ["column"])
    # ranks less their mean
    centred = [F.col(f"{p}_upto") - (F.col(p) - 1) / F.lit(2.0) - (F.col(f"{p}_all") + 1) / F.lit(2.0) for p in partners]
    ranked = keep(cum.select("column", "value", "n", *partners, F.array(*centred).alias("_ranks")))
    spread = {r["column"]: r for r in ranked.groupBy("column").agg(  # one row per column
        F.count("*").alias("values"),
        F.array(*[F.sum(p) for p in partners]).alias("rows"),
        F.array(*[F.sum(F.col(p) * F.col("_ranks")[j] * F.col("_ranks")[j]) for j, p in enumerate(partners)]).alias("squares"),
    ).collect()}
    for i in sorted(spread, key=lambda i: -spread[i]["values"]):
        table = ranked.where(F.col("column") == i).select(F.col("value").alias(values[i]), "n", F.col("_ranks").alias(f"_r{i}"))
        if spread[i]["values"] <= FEW_VALUES:
            wide = wide.join(F.broadcast(table.drop("n")), values[i], "left")
        else:
            wide = salted_lookup(wide, table, [values[i]], "n", F.col("_row"))
    pairs = [(i, j) for i, j in combinations(range(size), 2) if i in spread and spread[i]["rows"][j] > 0]
    if not pairs:
        return df.sparkSession.createDataFrame([], "left string, right string, rows bigint, correlation double")
    sums = wide.agg(*[F.sum(F.col(f"_r{i}")[j] * F.col(f"_r{j}")[i]).alias(f"c{i}_{j}") for i, j in pairs])

    def correlated(i: int, j: int) -> Column:
        size_of = math.sqrt(spread[i]["squares"][j]) * math.sqrt(spread[j]["squares"][i])
        return F.col(f"c{i}_{j}") / F.lit(size_of) if size_of > 0 else F.lit(None).cast("double")

    listed = F.array(*[
        F.struct(F.lit(columns[i]).alias("left"), F.lit(columns[j]).alias("right"),
                 F.lit(spread[i]["rows"][j]).cast("bigint").alias("rows"), correlated(i, j).alias("correlation"))
        for i, j in pairs
    ])
    return sums.select(F.inline(listed))
