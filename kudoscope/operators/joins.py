"""Joins.  No side is broadcast by hint unless its row count is bounded by
construction (a top-k list, a list of keys with a large share); all other
joins are left to Spark's measured sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kudoscope.session import keep

HOT_SHARE = 1 / 512  # a key is hot above this share; so at most 512 keys are
SALTS = 64  # a hot key is spread over this many tasks
MOST_HOT, TRACKED = 1024, 16384  # keys named, and keys counted, by a summary


def rename_clashes(
    left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str
) -> DataFrame:
    """Give the right side's columns a suffix where the left has the same name."""
    taken = set(left.columns) - set(keys)
    return right.withColumnsRenamed({c: c + suffix for c in right.columns if c in taken})


def hot_keys(df: DataFrame, key: str) -> Column:
    """Keys that may hold more than ``HOT_SHARE`` of the rows, as one array.

    They come from a frequent-items summary that every task keeps during the
    scan (a fixed number of keys, merged like any partial aggregate): no count per
    key is shuffled.  Counts are estimates, so half the share is asked for; at
    most ``MOST_HOT`` keys are named."""
    top = df.agg(
        F.call_function("approx_top_k", F.col(key), F.lit(MOST_HOT), F.lit(TRACKED)).alias("_top"),
        F.count(key).alias("_rows"),
    )
    hot = F.filter("_top", lambda e: e["item"].isNotNull() & (e["count"] * (2 / HOT_SHARE) > F.col("_rows")))
    return top.select(F.transform(hot, lambda e: e["item"])).scalar()


def salted_join(left: DataFrame, right: DataFrame, key: str, salt_by: Column, hot: Column) -> DataFrame:
    """Left join on one key, the ``hot`` keys spread over ``SALTS`` tasks."""
    is_hot = F.coalesce(F.array_contains(hot, F.col(key)), F.lit(False))
    salt = F.when(is_hot, F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = left.withColumn("_salt", salt)
    return spread.join(right.withColumn("_salt", F.explode(copies)), [key, "_salt"], "left").drop("_salt")


def attach(
    left: DataFrame,
    right: DataFrame,
    key: str,
    suffix: str = "_right",
    salt_by: str | None = None,
    hot_from: DataFrame | None = None,
) -> DataFrame:
    """Left equi-join of a side table; clashing right names get ``suffix``.

    With ``salt_by`` (the left row key) the hot values of ``key`` are spread over
    several tasks; otherwise AQE splits them.  ``hot_from`` is a table with the
    same keys that is cheaper to read than ``left``.
    """
    right = rename_clashes(left, right, [key], suffix)
    if salt_by is None:
        return left.join(right, key, "left")
    hot = hot_keys(left if hot_from is None else hot_from, key)
    return salted_join(left, right, key, F.col(salt_by), hot)


def salted_lookup(
    left: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    rows: str,
    salt_by: Column,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Left join on ``table`` with the hot keys spread over ``SALTS`` tasks.

    ``rows`` is the column of ``table`` holding the number of left rows per
    key; it is dropped.  Only keys above ``HOT_SHARE`` of all rows are salted,
    so the list of hot keys is bounded and the table copies few rows.  Rows with a
    null key match nothing and are spread too.
    """
    sizes = table if sizes is None else sizes
    limit = sizes.agg(F.sum(rows) * F.lit(HOT_SHARE)).scalar()
    hot = sizes.where(F.col(rows) > limit).select(*keys, F.lit(SALTS).alias("_salts"))
    empty = F.lit(False)
    for k in keys:
        empty = empty | F.col(k).isNull()
    spread = left.join(F.broadcast(hot), list(keys), "left").withColumn(
        "_salt",
        F.when(
            F.col("_salts").isNotNull() | empty, F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int")
        ).otherwise(0),
    )
    copies = F.when(
        F.col(rows) > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))
    ).otherwise(F.array(F.lit(0)))
    copied = table.withColumn("_salt", F.explode(copies)).drop(rows)
    return spread.join(copied, [*keys, "_salt"], "left").drop("_salt", "_salts")


SMALL_TABLE_ROWS = 500_000  # a caller's lookup table up to here is broadcast


def is_small(df: DataFrame, rows: int = SMALL_TABLE_ROWS) -> bool:
    """Counted, but never beyond the limit."""
    return df.limit(rows + 1).count() <= rows


def look_up(
    left: DataFrame, table: DataFrame, key: str, salt_by: Column, rows: int = SMALL_TABLE_ROWS
) -> DataFrame:
    """Left join of a caller's lookup table with unique keys.

    A table of checked size is broadcast, so the left rows stay in place.  A
    larger one is joined by shuffle with the hot keys of the left side salted.
    The table is kept, as it is counted first.
    """
    table = keep(table)
    if is_small(table, rows):
        return left.join(F.broadcast(table), key, "left")
    return salted_join(left, table, key, salt_by, hot_keys(left, key))


def repeated_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once on either side (one shuffle for both)."""
    sides = left.select(F.col(key).alias("key"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    other = right.select(F.col(key).alias("key"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    counts = sides.unionByName(other).groupBy("key").agg(
        F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows")
    )
    return counts.where("left_rows > 1 or right_rows > 1")


def attach_one_to_one(
    left: DataFrame, right: DataFrame, key: str, suffix: str = "_sent"
) -> DataFrame:
    """Left join that refuses repeated keys on either side."""
    bad = repeated_keys(left, right, key).take(1)
    if bad:
        raise ValueError(f"join is not one to one: {key}={bad[0]['key']!r} is repeated")
    return attach(left, right, key, suffix)


def keep_matching(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``ids``."""
    return df.join(ids.select(key), key, "left_semi")


def keep_top(df: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """Rows of the top-k members; ``top`` has at most k rows by construction."""
    return df.join(F.broadcast(top.select(key)), key, "left_semi")


def add_columns(df: DataFrame, *groups: dict[str, Column]) -> DataFrame:
    """Side-by-side columns of one row, added in one projection."""
    merged: dict[str, Column] = {}
    for group in groups:
        merged.update(group)
    return df.withColumns(merged)
