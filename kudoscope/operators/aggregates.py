"""Grouped reports.  All group-bys are partial before their shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kudoscope.functions import categories, text
from kudoscope.operators import ranks, sketches

DESCRIBE_QUANTILES = (0.25, 0.5, 0.75)  # fixed values


def mean_by_domain(
    df: DataFrame, key: str, value: str, domain: Sequence[object], name: str = "mean"
) -> DataFrame:
    """Mean per member of a fixed domain; a member without rows gets null."""
    means = df.groupBy(key).agg(F.avg(value).alias(name))
    members = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(d).alias(key)) for i, d in enumerate(domain)])
    frame = df.sparkSession.range(1).select(F.inline(members))
    return frame.join(F.broadcast(means.where(F.col(key).isin(list(domain)))), key, "left").orderBy(
        "position"
    )


def value_counts(df: DataFrame, column: str, count: str = "n") -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(count))


def top_values(df: DataFrame, column: str, k: int, count: str = "n", blank: bool = False) -> DataFrame:
    """The k most frequent values, ties by value; blanks and nulls dropped."""
    if not blank:
        df = df.withColumn(column, text.strip(F.col(column).cast("string"))).where(
            F.col(column) != ""
        )
    return value_counts(df, column, count).orderBy(F.desc(count), F.asc(column)).limit(k)


def top_list_values(df: DataFrame, column: str, k: int, count: str = "n") -> DataFrame:
    """The k most frequent entries of a list column."""
    entries = df.select(F.explode(column).alias("token"))
    return top_values(entries, "token", k, count)


def group_summary(
    df: DataFrame,
    key: str,
    value: str,
    top: int | None = None,
    discrete: bool = False,
) -> DataFrame:
    """Mean, median and size per group, by descending mean.

    ``top`` keeps the groups with most rows.  The table is read once: size,
    mean and the exact median all come from the ``(group, value)`` counts.
    Both uses of the counts are kept free of filters (null values weigh
    nothing in the median instead), so Spark shuffles them once and reuses it.
    """
    x = F.col(value)
    freq = (
        df.where(F.col(key).isNotNull())
        .groupBy(key, value)
        .agg(F.count("*").alias("n"))
        .withColumn("_known", F.when(x.isNotNull(), F.col("n")).otherwise(0))
    )
    sizes = freq.groupBy(key).agg(
        F.sum("n").cast("bigint").alias("n"),
        (F.sum(x * F.col("_known")) / F.nullif(F.sum("_known"), F.lit(0))).alias("mean"),
    )
    if top is not None:
        sizes = sizes.orderBy(F.desc("n"), F.asc(key)).limit(top)
        freq = freq.join(F.broadcast(sizes.select(key)), key)
    medians = ranks.quantiles_of(freq, value, [0.5], ["median"], [key], discrete, count="_known")
    return (
        sizes.join(medians, key, "left")
        .select(key, "mean", "median", "n")
        .orderBy(F.desc("mean"), F.asc(key))
    )


def explode_list(df: DataFrame, column: str, name: str, keep_empty: bool = False) -> DataFrame:
    """One row per list entry; ``keep_empty`` keeps rows with an empty list."""
    step = F.explode_outer if keep_empty else F.explode
    return df.withColumn(name, step(column))


def list_summary(df: DataFrame, column: str, value: str, top: int, discrete: bool = False) -> DataFrame:
    """:func:`group_summary` over list entries.

    Only the list and the value are carried through the explode.
    """
    entries = df.select(F.explode(categories.non_empty(F.col(column))).alias("category"), value)
    return group_summary(entries, "category", value, top, discrete)


def describe(
    df: DataFrame,
    columns: Sequence[str],
    percentiles: Sequence[float] = DESCRIBE_QUANTILES,
    discrete: bool = False,
    approx: bool = False,
) -> DataFrame:
    """count, mean, std, min, exact percentiles and max; one row per column.

    ``approx`` takes the percentiles from one KLL sketch per column: a single
    scan without a shuffle of values (see ``sketches`` for states to store)."""
    if approx:
        x = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
        deviations = df.agg(*[F.stddev_samp(v).alias(c) for c, v in x.items()]).select(F.struct(*columns)).scalar()
        spread = F.create_map(*[e for c in columns for e in (F.lit(c), F.col("_std")[c])])
        found = sketches.estimates(sketches.states(df, columns), percentiles).where("count > 0")
        names = [f"p{p * 100:g}".replace(".", "_") for p in percentiles]
        return found.withColumn("_std", deviations).select(
            "column", "count", "mean", spread[F.col("column")].alias("std"), "min", *names, "max"
        )
    long = ranks.long_form(df, columns).where(F.col("value").isNotNull() & ~F.isnan("value"))
    freq = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    names = [f"p{p * 100:g}".replace(".", "_") for p in percentiles]
    cuts = ranks.quantiles_of(freq, "value", percentiles, names, ["column"], discrete)
    basics = long.groupBy("column").agg(
        F.count("*").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return basics.join(cuts, "column").select(
        "column", "count", "mean", "std", "min", *names, "max"
    )


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    f = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[f(c).alias(c) for c in columns])


def missing_counts(df: DataFrame) -> DataFrame:
    """Nulls per column in one scan: ``column``, ``missing``."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "missing")


def label_shares(df: DataFrame, label: str) -> DataFrame:
    """Rows and percentage per label, the null label included."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percent", F.col("n") * 100.0 / total)


def token_counts(df: DataFrame, column: str, top: int) -> DataFrame:
    """Most frequent lower-cased tokens of a text column."""
    entries = df.where(F.col(column).isNotNull()).select(
        F.explode(text.tokens(F.col(column))).alias("token")
    )
    return top_values(entries, "token", top, blank=True)


def sentiment_summary(df: DataFrame, discrete: bool = False) -> DataFrame:
    """One row: reviews, rows per label (map), score statistics, mean useful.

    The labels are few (classes of a model), so the map is small.
    """
    counts = df.groupBy(F.coalesce("sentiment_label", F.lit("None")).alias("label")).agg(
        F.count("*").alias("n")
    )
    by_label = counts.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n"))))
    ).scalar()
    median = ranks.quantiles(df, "sentiment_score", [0.5], ["m"], (), discrete).scalar()
    return df.agg(
        F.count("*").alias("total_reviews"),
        F.avg("sentiment_score").alias("sentiment_score_mean"),
        F.min("sentiment_score").alias("sentiment_score_min"),
        F.max("sentiment_score").alias("sentiment_score_max"),
        F.avg("useful").alias("useful_votes_mean"),
    ).select(
        "*", median.alias("sentiment_score_median"), by_label.alias("label_counts")
    )


def flag_means(df: DataFrame, flags: dict[str, Column], value: str) -> DataFrame:
    """Mean and number of rows for each 0/1 flag, by descending mean.

    All flags are aggregated in one pass, then turned into rows.
    """
    marked = df.select(value, *[e.alias(c) for c, e in flags.items()])
    wide = marked.agg(
        *[F.avg(F.when(F.col(c) == 1, F.col(value))).alias(f"{c}__mean") for c in flags],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}__count") for c in flags],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("flag"),
                F.col(f"{c}__mean").alias("mean"),
                F.col(f"{c}__count").alias("count"),
            )
            for c in flags
        ]
    )
    return wide.select(F.inline(rows)).orderBy(F.desc_nulls_last("mean"), F.asc("flag"))


def table_overview(df: DataFrame) -> DataFrame:
    """One row per column: position, type and the row count of the table."""
    names = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("type"))
            for i, (c, t) in enumerate(df.dtypes)
        ]
    )
    return df.agg(F.count("*").alias("rows")).select(F.inline(names), "rows").select(
        "position", "column", "type", "rows"
    )


def mean_by_bin(df: DataFrame, bin_column: str, value: str) -> DataFrame:
    return (
        df.where(F.col(bin_column).isNotNull())
        .groupBy(bin_column)
        .agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
        .orderBy(bin_column)
    )


def histogram(
    df: DataFrame, value: str, bins: int = 50, log: bool = False, density: bool = False
) -> DataFrame:
    """Counts of equal-width bins between minimum and maximum.

    Bins are ``[low, high)``, the last one is closed; empty bins are listed.
    A column with one value is centred in a range of width one.
    """
    x = F.col(value).cast("double")
    x = F.log1p(x) if log else x
    data = df.select(x.alias("x")).where("x is not null and not isnan(x)")
    ends = data.agg(
        F.when(F.min("x") == F.max("x"), F.min("x") - 0.5).otherwise(F.min("x")).alias("lo"),
        F.when(F.min("x") == F.max("x"), F.max("x") + 0.5).otherwise(F.max("x")).alias("hi"),
    ).select(F.struct("lo", "hi").alias("e"))
    placed = data.withColumn("e", ends.scalar())
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    raw = F.least(
        F.floor((F.col("x") - F.col("e.lo")) / (F.col("e.hi") - F.col("e.lo")) * bins),
        F.lit(bins - 1),
    )
    placed = placed.select("x", "e", width.alias("w"), raw.alias("b"))
    # settle values that rounding put on the wrong side of an edge
    low = F.col("e.lo") + F.col("b") * F.col("w")
    high = F.col("e.lo") + (F.col("b") + 1) * F.col("w")
    fixed = (
        F.when((F.col("x") < low) & (F.col("b") > 0), F.col("b") - 1)
        .when((F.col("x") >= high) & (F.col("b") < bins - 1), F.col("b") + 1)
        .otherwise(F.col("b"))
    )
    counts = placed.groupBy(fixed.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = (
        frame.join(F.broadcast(counts), "bin", "left")
        .withColumn("e", ends.scalar())
        .where("e.lo is not null")
        .withColumn("w", width)
    )
    out = full.select(
        "bin",
        (F.col("e.lo") + F.col("bin") * F.col("w")).alias("low"),
        (F.col("e.lo") + (F.col("bin") + 1) * F.col("w")).alias("high"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )
    if density:
        total = F.sum("n").over(W.partitionBy())  # one row per bin
        out = out.withColumn("density", F.col("n") / (total * (F.col("high") - F.col("low"))))
    return out.orderBy("bin")


# Upper ends and labels of the fan bins.
FAN_BINS = ((0, "0"), (5, "1-5"), (20, "6-20"), (100, "21-100"), (10**9, "100+"))


def fans_bin(fans: Column) -> Column:
    """Label of the ``(low, high]`` bin; null counts as no fans, below 0 none."""
    n = F.coalesce(fans, F.lit(0))
    label = F.when(n <= -1, F.lit(None).cast("string"))
    for top, name in FAN_BINS:
        label = label.when(n <= top, F.lit(name))
    return label


def fans_summary(df: DataFrame, fans: str, value: str) -> DataFrame:
    """Mean per fan bin, all five bins listed in order."""
    marked = df.select(fans_bin(F.col(fans)).alias("fans_bin"), value)
    return mean_by_domain(marked, "fans_bin", value, [name for _, name in FAN_BINS])


def bin_counts(df: DataFrame, bin_column: str) -> DataFrame:
    return value_counts(df, bin_column).orderBy(bin_column)


def first_members(df: DataFrame, columns: Iterable[str], n: int, order: str) -> DataFrame:
    """First rows in key order: a repeatable head."""
    return df.select(*columns).orderBy(order).limit(n)


def extremes(df: DataFrame, value: str, label: str, k: int) -> DataFrame:
    """The k highest and k lowest rows by value: ``side``, ``label``, ``value``."""
    pick = df.select(label, value)
    high = pick.orderBy(F.desc(value), F.asc(label)).limit(k).withColumn("side", F.lit("high"))
    low = pick.orderBy(F.asc(value), F.asc(label)).limit(k).withColumn("side", F.lit("low"))
    return high.unionByName(low)
