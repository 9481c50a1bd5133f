"""Numeric, one-hot and multi-hot features learned on the training rows."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from kudoscope.functions import categories, text

# How many values of each column become indicators.
TOP_CITIES, TOP_STATES, TOP_CATEGORIES = 50, 20, 30


@dataclass
class TopValues:
    """Most frequent values of some columns and their indicator names."""

    tokens: dict[str, list[str]]
    lists: frozenset[str]
    prefixes: dict[str, str]
    names: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.names:
            return
        flat = [
            f"{self.prefixes[c]}_{text.slug_name(t)}" for c, ts in self.tokens.items() for t in ts
        ]
        unique = iter(text.unique_names(flat))
        self.names = {c: [next(unique) for _ in ts] for c, ts in self.tokens.items()}

    @property
    def columns(self) -> list[str]:
        return [n for names in self.names.values() for n in names]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add the indicators; list columns are normalised once per row."""
        held = {f"_{c}": categories.normalize(F.col(c)) for c in self.lists if c in self.tokens}
        work = df.withColumns(held) if held else df
        out: dict[str, Column] = {}
        for column, tokens in self.tokens.items():
            for token, name in zip(tokens, self.names[column]):
                hit = (
                    F.array_contains(F.col(f"_{column}"), token)
                    if column in self.lists
                    else text.strip(F.col(column).cast("string")) == token
                )
                out[name] = F.coalesce(hit, F.lit(False)).cast("tinyint")
        return (work.withColumns(out) if out else work).drop(*held)


def _named(column: str):
    """Array function that puts the column name beside each value."""
    return lambda v: F.struct(F.lit(column).alias("column"), v.alias("token"))


def top_tokens(df: DataFrame, sizes: dict[str, int], lists: Iterable[str] = ()) -> DataFrame:
    """Most frequent values of several columns in one scan:
    ``column``, ``token``, ``n``, ``place``."""
    lists = set(lists)
    parts = []
    for column in sizes:
        values = (
            categories.normalize(F.col(column))
            if column in lists
            else F.array(text.strip(F.col(column).cast("string")))
        )
        parts.append(F.transform(values, _named(column)))
    counts = (
        df.select(F.inline(F.concat(*parts)))
        .where("token is not null and token <> ''")
        .groupBy("column", "token")
        .agg(F.count("*").alias("n"))
    )
    order = W.partitionBy("column").orderBy(F.desc("n"), F.asc("token"))
    most = F.lit(None).cast("int")
    for column, k in sizes.items():
        most = F.when(F.col("column") == column, F.lit(k)).otherwise(most)
    top = max(sizes.values(), default=0)
    # the constant bound lets Spark cut each task's groups before the shuffle
    return (
        counts.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= top)
        .where(F.col("place") <= most)
    )


def fit_top_values(
    train: DataFrame,
    sizes: dict[str, int],
    lists: Iterable[str] = (),
    prefixes: dict[str, str] | None = None,
) -> TopValues:
    """Learn the indicators on ``train``; at most ``sum(sizes)`` rows reach the driver."""
    sizes = {c: k for c, k in sizes.items() if k > 0 and c in train.columns}
    lists = frozenset(c for c in lists if c in sizes)
    found: dict[str, list[str]] = {c: [] for c in sizes}
    if sizes:
        for row in top_tokens(train, sizes, lists).orderBy("column", "place").collect():
            found[row["column"]].append(row["token"])
    prefixes = {c: (prefixes or {}).get(c, c) for c in sizes}
    return TopValues(found, lists, prefixes)


def numeric_columns(df: DataFrame, drop: Iterable[str]) -> list[str]:
    """Numeric and boolean columns that are not in the drop list."""
    drop = set(drop)
    return [
        f.name
        for f in df.schema.fields
        if f.name not in drop and isinstance(f.dataType, (NumericType, BooleanType))
    ]


def numeric_features(df: DataFrame, columns: Iterable[str]) -> dict[str, Column]:
    """Float columns, booleans as 0/1, nulls (and NaN) as 0."""
    types = dict(df.dtypes)
    out = {}
    for c in columns:
        value = F.col(c).cast("int") if types[c] == "boolean" else F.col(c)
        value = value.cast("float")
        out[c] = F.when(value.isNull() | F.isnan(value), F.lit(0.0).cast("float")).otherwise(value)
    return out


def numeric_group(
    df: DataFrame, review_length: bool = True, user_stats: bool = True, business_stats: bool = True
) -> list[str]:
    """Numeric columns chosen by group flags, those that exist."""
    # fixed values: the columns of each group
    groups = (
        (review_length, ("review_char_len", "review_word_len")),
        (
            user_stats,
            ("user_review_count", "user_average_stars", "user_fans", "useful_user", "funny_user", "cool_user"),
        ),
        (business_stats, ("business_stars", "business_review_count", "is_open")),
    )
    return [c for wanted, names in groups if wanted for c in names if c in df.columns]
