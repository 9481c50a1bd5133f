"""Vote counts, rates and targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_votes(c: Column, policy: str = "clip") -> Column:
    """One rule for the ``-1`` marker: ``clip`` to 0, ``null`` it, or ``keep``.

    ``clip`` and ``keep`` leave nulls alone; ``zero`` clips and fills nulls.
    """
    if policy == "clip":
        return F.when(c.isNotNull(), F.greatest(c, F.lit(0)))
    if policy == "zero":
        return F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    if policy == "null":
        return F.when(c != -1, c)
    if policy == "keep":
        return c
    raise ValueError(f"unknown vote policy {policy!r}")


def total_votes(*columns: Column) -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(c.cast("double"), F.lit(0.0))
    return total


def vote_ratio(votes: Column, total: Column) -> Column:
    return votes / (total + 1)


def smoothed_rate(votes: Column, total: Column, alpha: float = 1.0, beta: float = 5.0) -> Column:
    """Beta-binomial posterior mean of the useful share."""
    return (votes.cast("double") + alpha) / (total + alpha + beta)


def per_hundred(votes: Column, review_count: Column) -> Column:
    return votes / (review_count + 1) * 100


def density(review_count: Column, words: Column) -> Column:
    return F.coalesce(review_count, F.lit(0)) / (words + 1)


def log_votes(c: Column) -> Column:
    return F.log1p(c.cast("double"))


def from_log(c: Column) -> Column:
    """Back from log scale, never below zero."""
    return F.greatest(F.expm1(c), F.lit(0.0))


def flag_ratio(flag: Column, votes: Column) -> Column:
    """Flag over votes where there are votes, else null."""
    return F.when(votes != 0, flag / F.nullif(votes, F.lit(0)))


def targets(useful: Column) -> dict[str, Column]:
    votes = F.coalesce(useful, F.lit(0)).cast("int")
    return {"target_useful_votes": votes, "target_is_useful": (votes > 0).cast("int")}
