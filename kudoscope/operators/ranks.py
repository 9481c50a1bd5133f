"""Ranks, quantiles and running totals from value-frequency tables.

Rows are first folded to ``(group, value, count)`` by a partial aggregate, so a
group that holds a third of all rows becomes as many rows as it has distinct
values.  A running total is then cut into ranges of the value: splitters come
from a mergeable quantile sketch of the folded rows, so every range holds about
the same number of them however dense the column is; one window runs inside each
range, one over the totals of the ranges, whose number is fixed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kudoscope.operators.joins import salted_lookup

RANGES = 1024  # ranges of the value, a power of two
ACCURACY = 16 * RANGES  # a splitter is off by at most 1/16 of a range


def splitters(freq: DataFrame, value: str) -> Column:
    """The sorted values that cut the rows of ``freq`` into ``RANGES`` ranges of
    about the same size, as one array."""
    shares = [i / RANGES for i in range(1, RANGES)]
    return freq.agg(F.percentile_approx(F.col(value).cast("double"), shares, ACCURACY)).scalar()


def range_of(value: Column, cuts: Column) -> Column:
    """Number of splitters below ``value``, by binary search: it depends on the
    value alone and never decreases with it."""
    x = value.cast("double")
    steps = F.array(*[F.lit(1 << k) for k in range(RANGES.bit_length() - 2, -1, -1)])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.element_at(cuts, at + step) < x, at + step).otherwise(at)
    )


def ranged(freq: DataFrame, value: str) -> DataFrame:
    """``freq`` with the number ``_bucket`` of each row's value."""
    return freq.withColumn("_cuts", splitters(freq, value)).withColumn(
        "_bucket", range_of(F.col(value), F.col("_cuts"))
    ).drop("_cuts")


def frequencies(
    df: DataFrame, value: str, by: Sequence[str] = (), count: str = "n"
) -> DataFrame:
    """Rows per group and value; null values and null groups are left out."""
    present = df.dropna(subset=[value, *by])
    return present.groupBy(*by, value).agg(F.count("*").alias(count))


def running_total(
    freq: DataFrame,
    value: str,
    counts: Sequence[str],
    by: Sequence[str] = (),
    discrete: bool = False,
) -> DataFrame:
    """Add ``<c>_upto`` (running sum by value) and ``<c>_all`` per group.

    ``freq`` has one row per group and value.  ``discrete`` says that a group
    has few distinct values (votes, stars): a single window per group is used.
    """
    by = list(by)
    if discrete:
        ordered = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
        whole = W.partitionBy(*by)
        return freq.withColumns(
            {f"{c}_upto": F.sum(c).over(ordered) for c in counts}
            | {f"{c}_all": F.sum(c).over(whole) for c in counts}
        )
    cut = ranged(freq, value)
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    totals = cut.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_{c}") for c in counts])
    offsets = totals.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}_before") for c in counts],
        *[F.sum(f"_{c}").over(whole).alias(f"{c}_all") for c in counts],
    )
    inside = (
        W.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    )
    return (
        cut.withColumns({f"_{c}_in": F.sum(c).over(inside) for c in counts})
        .join(offsets, [*by, "_bucket"])
        .withColumns({f"{c}_upto": F.col(f"_{c}_before") + F.col(f"_{c}_in") for c in counts})
        .drop("_bucket", *[f"_{c}_before" for c in counts], *[f"_{c}_in" for c in counts])
    )


def with_neighbours(freq: DataFrame, value: str, columns: Sequence[str]) -> DataFrame:
    """Add the structs ``lower`` and ``higher``: the ``columns`` of the rows with
    the next value below and above, null at the ends.

    Neighbours inside a range come from a window; at its ends from the first and
    last row of the ranges beside it."""
    cut = ranged(freq, value).withColumn("_own", F.struct(*columns))
    ends = cut.groupBy("_bucket").agg(
        F.min_by("_own", value).alias("_first"), F.max_by("_own", value).alias("_last")
    )
    ranges = W.orderBy("_bucket")  # a row for each range
    ends = ends.select(
        "_bucket", F.lag("_last").over(ranges).alias("_below"), F.lead("_first").over(ranges).alias("_above")
    )
    inside = W.partitionBy("_bucket").orderBy(value)
    return (
        cut.withColumns({"lower": F.lag("_own").over(inside), "higher": F.lead("_own").over(inside)})
        .join(ends, "_bucket")
        .withColumns({"lower": F.coalesce("lower", "_below"), "higher": F.coalesce("higher", "_above")})
        .drop("_bucket", "_own", "_below", "_above")
    )


def rank_table(
    df: DataFrame, value: str, by: Sequence[str] = (), discrete: bool = False
) -> DataFrame:
    """One row per group and value: rows ``n``, ``rank_max``, ``rank_avg``, ``rank_pct``."""
    return _ranks_of(frequencies(df, value, by), value, by, discrete)


def _ranks_of(freq: DataFrame, value: str, by: Sequence[str], discrete: bool) -> DataFrame:
    cum = running_total(freq, value, ["n"], by, discrete)
    average = F.col("n_upto") - (F.col("n") - 1) / F.lit(2.0)
    return cum.select(
        *by,
        value,
        "n",
        F.col("n_upto").cast("bigint").alias("rank_max"),
        average.alias("rank_avg"),
        (average / F.col("n_all")).alias("rank_pct"),
    )


def average_rank(
    df: DataFrame, value: str, row_key: str, name: str = "rank_avg", discrete: bool = False
) -> DataFrame:
    """Global rank with ties averaged; null values stay unranked."""
    freq = frequencies(df, value)
    table = _ranks_of(freq, value, (), discrete).select(value, "n", F.col("rank_avg").alias(name))
    return salted_lookup(df, table, [value], "n", F.col(row_key), freq)


def rank_in_group(
    df: DataFrame,
    value: str,
    group: str,
    row_key: str,
    rank: str = "rank_in_group",
    percentile: str = "percentile_in_group",
    discrete: bool = True,
) -> DataFrame:
    """Rank (ties get the highest) and percentile (ties averaged) in a group."""
    freq = frequencies(df, value, [group])
    table = _ranks_of(freq, value, [group], discrete).select(
        group, value, "n", F.col("rank_max").alias(rank), F.col("rank_pct").alias(percentile)
    )
    return salted_lookup(df, table, [group, value], "n", F.col(row_key), freq)


def quantiles_of(
    freq: DataFrame,
    value: str,
    probabilities: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
    discrete: bool = False,
    count: str = "n",
) -> DataFrame:
    """Exact quantiles (linear interpolation) from a frequency table."""
    cum = running_total(freq, value, [count], by, discrete)
    upto, total, x = F.col(f"{count}_upto"), F.col(f"{count}_all"), F.col(value).cast("double")
    parts = []
    for i, p in enumerate(probabilities):
        place = F.lit(float(p)) * (total - 1)
        parts += [
            F.min(F.when(upto > F.floor(place), x)).alias(f"_lo{i}"),
            F.min(F.when(upto > F.ceil(place), x)).alias(f"_hi{i}"),
            F.max(place - F.floor(place)).alias(f"_w{i}"),
        ]
    found = cum.groupBy(*by).agg(*parts)
    return found.select(
        *by,
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(n)
            for i, n in enumerate(names)
        ],
    )


def quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
    discrete: bool = False,
) -> DataFrame:
    return quantiles_of(
        frequencies(df, value, by), value, probabilities, names, by, discrete
    )


def quantile_edges(df: DataFrame, value: str, q: int = 10, discrete: bool = False) -> DataFrame:
    """One row: the ``q + 1`` quantile edges, repeated edges dropped."""
    names = [f"e{i}" for i in range(q + 1)]
    table = quantiles(df, value, [i / q for i in range(q + 1)], names, (), discrete)
    return table.select(F.array_sort(F.array_distinct(F.array(*names))).alias("edges"))


def quantile_bin(
    df: DataFrame, value: str, q: int = 10, name: str = "bin", discrete: bool = False
) -> DataFrame:
    """Add the bin number ``0..`` of ``(low, high]`` quantile bins.

    The lowest value belongs to the first bin; a null has none, and neither
    has a column with a single distinct value.
    """
    edges = quantile_edges(df, value, q, discrete).scalar()
    x = F.col(value).cast("double")
    with_edges = df.withColumn("_edges", edges)
    inner = F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0)))
    place = F.aggregate(inner, F.lit(0), lambda acc, e: acc + (x > e).cast("int"))
    return with_edges.withColumn(
        name, F.when(x.isNotNull() & (F.size("_edges") > 1), place)
    ).drop("_edges")


def winsorize(
    df: DataFrame, values: Sequence[str], q: float = 0.99, discrete: bool = False
) -> DataFrame:
    """Cut each column at its own quantile ``q`` (one pass for all columns)."""
    table = quantiles(long_form(df, values), "value", [q], ["top"], ["column"], discrete)
    tops = table.agg(F.map_from_entries(F.collect_list(F.struct("column", "top"))))  # one entry per column
    with_tops = df.withColumn("_tops", tops.scalar())
    return with_tops.withColumns(
        {
            v: F.when(
                F.col(v).isNotNull(), F.least(F.col(v).cast("double"), F.col("_tops")[v])
            )
            for v in values
        }
    ).drop("_tops")


def long_form(
    df: DataFrame, values: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """One row per kept columns and value column: ``column``, ``value``."""
    pairs = F.array(
        *[F.struct(F.lit(v).alias("column"), F.col(v).cast("double").alias("value")) for v in values]
    )
    return df.select(*keep, F.inline(pairs))
