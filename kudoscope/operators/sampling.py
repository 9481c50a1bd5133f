"""Exact, repeatable samples and splits ordered by a seeded md5 of the row key.

The order depends on the key alone, so a lost task gives the same rows again.
A sample of n rows never sorts the table: the n-th row is found digit by digit.
The 65,536 prefixes of four hexadecimal digits are counted, which gives the prefix
that holds the n-th row; inside it the next four digits are counted; only the
rows that share all eight digits (one in four thousand million) are looked at one
by one, folded by their hash, so repeated keys are one row there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_order(key: str, seed: int) -> Column:
    """Sort key of the seeded order: md5 of ``seed:key``, then the key."""
    text = F.col(key).cast("string")
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), text)), F.lit(":"), text)


DIGITS = 4  # hexadecimal digits counted at a time


def _digits(order: Column, level: int) -> Column:
    return F.conv(F.substring(order, 1 + DIGITS * level, DIGITS), 16, 10).cast("int")


def _edge(cells: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """Of every stratum the cell that holds the wanted row, and its place in it.

    ``cells`` has a row for each cell: its rows ``_n`` and the wanted ``_place``."""
    upto = W.partitionBy(*keys).orderBy(cell).rowsBetween(W.unboundedPreceding, 0)
    counted = cells.withColumn("_upto", F.sum("_n").over(upto))
    return counted.where("_upto >= _place and _upto - _n < _place").select(
        *keys, cell, (F.col("_place") - F.col("_upto") + F.col("_n")).alias("_place")
    )


def prefix_counts(df: DataFrame, key: str, seed: int, stratum: str) -> DataFrame:
    """Rows ``_n`` of every stratum and first prefix of the seeded order."""
    return df.groupBy(stratum, _digits(hash_order(key, seed), 0).alias("_first")).agg(F.count("*").alias("_n"))


def last_in_sample(
    df: DataFrame, key: str, seed: int, wanted: DataFrame, stratum: str, counts: DataFrame | None = None
) -> DataFrame:
    """Per stratum the hash of the last row to take (``last_order``).

    ``wanted`` has ``stratum`` and ``take_rows``; strata are few (classes), so
    every table of edges has a few rows.  ``counts`` are the prefix counts where
    the caller has them."""
    if counts is None:
        counts = prefix_counts(df, key, seed, stratum)
    places = wanted.select(stratum, F.col("take_rows").alias("_place"))
    first = _edge(counts.join(F.broadcast(places), stratum), [stratum], "_first")
    keyed = df.select(F.col(stratum), hash_order(key, seed).alias("_order"))
    keyed = keyed.withColumns({"_first": _digits(F.col("_order"), 0), "_second": _digits(F.col("_order"), 1)})
    under = keyed.join(F.broadcast(first), [stratum, "_first"])
    cells = under.groupBy(stratum, "_first", "_second").agg(F.count("*").alias("_n"), F.max("_place").alias("_place"))
    second = _edge(cells, [stratum, "_first"], "_second")
    last = (
        keyed.join(F.broadcast(second), [stratum, "_first", "_second"])
        .groupBy(stratum, "_order")
        .agg(F.count("*").alias("_n"), F.max("_place").alias("_place"))
    )
    return _edge(last, [stratum], "_order").select(stratum, F.col("_order").alias("last_order"))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement."""
    if n <= 0:
        return df.limit(0)
    one = df.withColumn("_all", F.lit(1))
    wanted = df.sparkSession.range(1).select(
        F.lit(1).alias("_all"), F.lit(n).cast("bigint").alias("take_rows")
    )
    last = last_in_sample(one, key, seed, wanted, "_all")
    # no row: the table has fewer than n rows and all are taken
    limit = last.agg(F.max("last_order")).scalar()
    return df.where(F.coalesce(hash_order(key, seed) <= limit, F.lit(True)))


def strata_quota(sizes: DataFrame, fraction: float) -> DataFrame:
    """Rows to put aside per ``_stratum`` of ``_n`` rows for an evaluation share of
    ``fraction``.

    ceil(rows * fraction) rows in all.  The training side is shared out by
    largest remainder, the rest of each stratum goes to the evaluation side;
    a table with one class is not stratified and a single row is never split.
    """
    whole = W.partitionBy()  # one row per class
    total = F.sum("_n").over(whole)
    aside = F.ceil(total * F.lit(fraction))
    sized = sizes.withColumns({"_total": total, "_train": total - aside})
    share = F.col("_train") * F.col("_n") / F.col("_total")
    sized = sized.withColumns(
        {"_base": F.floor(share).cast("bigint"), "_rest": F.round(share - F.floor(share), 9)}
    )
    order = W.orderBy(F.desc("_rest"), F.asc("_stratum"))
    extra = F.row_number().over(order) <= F.col("_train") - F.sum("_base").over(whole)
    train = F.col("_base") + extra.cast("bigint")
    return sized.select(
        "_stratum",
        F.when(F.col("_total") < 2, 0).otherwise(F.col("_n") - train).cast("bigint").alias("take_rows"),
    )


def mark_evaluation(
    df: DataFrame,
    fraction: float = 0.2,
    key: str = "review_id",
    stratum: str | None = "target_is_useful",
    seed: int = 42,
    name: str = "is_eval",
) -> DataFrame:
    """Add a flag for the evaluation rows of an exact stratified split."""
    if stratum is not None and stratum not in df.columns:
        stratum = None
    marked = df.withColumn("_stratum", F.col(stratum) if stratum else F.lit(0))
    counts = prefix_counts(marked, key, seed, "_stratum")
    wanted = strata_quota(counts.groupBy("_stratum").agg(F.sum("_n").alias("_n")), fraction)
    last = last_in_sample(marked, key, seed, wanted.where("take_rows > 0"), "_stratum", counts)
    return (
        marked.join(F.broadcast(last), "_stratum", "left")
        .withColumn(
            name, F.coalesce(hash_order(key, seed) <= F.col("last_order"), F.lit(False))
        )
        .drop("_stratum", "last_order")
    )


def split(
    df: DataFrame,
    fraction: float = 0.2,
    key: str = "review_id",
    stratum: str | None = "target_is_useful",
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(train, eval) parts of :func:`mark_evaluation`."""
    marked = mark_evaluation(df, fraction, key, stratum, seed)
    return marked.where("not is_eval").drop("is_eval"), marked.where("is_eval").drop("is_eval")


def approximate_split(
    df: DataFrame, fraction: float = 0.2, key: str = "review_id", seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Map-only split by hash threshold: the share is met on average."""
    cells = 1 << 20
    cell = F.conv(F.substring(hash_order(key, seed), 1, 5), 16, 10).cast("int")
    is_eval = cell < int(fraction * cells)
    return df.where(~is_eval), df.where(is_eval)


def stratified_sample(
    df: DataFrame, n: int, key: str, stratum: str | None, seed: int = 42
) -> DataFrame:
    """Exactly ``n`` rows with the class shares of the table (largest remainder)."""
    base = df.withColumn("_stratum", F.col(stratum) if stratum else F.lit(0))
    counts = prefix_counts(base, key, seed, "_stratum")
    sizes = counts.groupBy("_stratum").agg(F.sum("_n").alias("_n"))
    whole = W.partitionBy()  # one row per class
    share = F.lit(n) * F.col("_n") / F.sum("_n").over(whole)
    sized = sizes.withColumns(
        {"_base": F.floor(share).cast("bigint"), "_rest": F.round(share - F.floor(share), 9),
         "_total": F.sum("_n").over(whole)}
    )
    order = W.orderBy(F.desc("_rest"), F.asc("_stratum"))
    extra = F.row_number().over(order) <= F.lit(n) - F.sum("_base").over(whole)
    wanted = sized.select(
        "_stratum",
        F.least(
            F.col("_n"),
            F.when(F.col("_total") <= n, F.col("_n")).otherwise(
                F.col("_base") + extra.cast("bigint")
            ),
        ).alias("take_rows"),
    )
    last = last_in_sample(base, key, seed, wanted.where("take_rows > 0"), "_stratum", counts)
    return (
        base.join(F.broadcast(last), "_stratum")
        .where(hash_order(key, seed) <= F.col("last_order"))
        .drop("_stratum", "last_order")
    )


def members_of_random_group(
    df: DataFrame, group: str, value: str, key: str, seed: int = 42
) -> DataFrame:
    """Rows of one seeded-random group with their rank by ``value``, in rank order."""
    from kudoscope.operators.ranks import rank_in_group

    known = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    chosen = known.agg(F.min_by(group, hash_order(group, seed))).scalar()
    rows = df.where(F.col(group) == chosen)
    rank = f"{value}_rank_in_{group.removesuffix('_id')}"
    ranked = rank_in_group(rows, value, group, key, rank, f"{value}_percentile")
    return ranked.select(key, value, rank).orderBy(rank, key)
