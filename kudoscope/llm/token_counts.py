"""Token counts from one exact histogram of encoded lengths.

Each text is encoded once, by the tiktoken library with a given rank file.
Documents are then only counted by their length; all answers (totals,
quantiles, truncated totals for a context limit) come from suffix sums over
the histogram, which has one row per length that occurs.

Null is an empty text of length 0; repeated rows count as often as they occur;
an empty table has an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def encoded_lengths(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``n_tokens`` of every row's text."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mergeable, split = shared.value
        coder = tiktoken.Encoding("given", pat_str=split, mergeable_ranks=mergeable, special_tokens={})
        for b in batches:
            sizes = [len(coder.encode_ordinary(t)) if t else 0 for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], names=["n_tokens"])

    return docs.select("text").mapInArrow(of, "n_tokens bigint")


def histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_table(hist: DataFrame, block: int = 4096) -> DataFrame:
    """For every length that occurs, taken as a context limit: documents of
    that length, documents and tokens up to it, documents beyond it, tokens
    left after truncation, and the share of documents that fit (so the first
    row with ``share >= q`` holds the q-quantile).

    Sums run inside blocks of lengths and over the blocks' totals."""
    cut = hist.withColumn("block", F.floor(F.col("n_tokens") / block))
    inner = Window.partitionBy("block").orderBy("n_tokens")
    tokens = F.col("n_tokens") * F.col("n_docs")
    totals = cut.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    # one row per block of lengths
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "block",
        F.coalesce(F.sum("docs").over(ahead), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("tokens_before"),
        F.sum("docs").over(whole).alias("all_docs"),
        F.sum("tokens").over(whole).alias("all_tokens"),
    )
    summed = cut.select(
        "block", "n_tokens", "n_docs",
        F.sum("n_docs").over(inner).alias("d"), F.sum(tokens).over(inner).alias("t"),
    ).join(offsets, "block")
    fit, used = F.col("docs_before") + F.col("d"), F.col("tokens_before") + F.col("t")
    return summed.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        fit.alias("docs_that_fit"),
        (F.col("all_docs") - fit).alias("docs_truncated"),
        used.alias("tokens_that_fit"),
        (used + F.col("n_tokens") * (F.col("all_docs") - fit)).alias("tokens_truncated"),
        "all_tokens",
        (fit / F.col("all_docs")).alias("share"),
    )


def quantile(table: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share q of the documents does not exceed."""
    return table.where(F.col("share") >= q).agg(F.min("context_limit").alias("quantile"))


def truncated_total(table: DataFrame, limit: int) -> DataFrame:
    """Tokens left if every document is cut to ``limit`` (any number)."""
    last = table.where(F.col("context_limit") <= limit).agg(
        F.max("docs_that_fit").alias("fit"), F.max("tokens_that_fit").alias("used")
    )
    docs = table.agg(F.max("docs_that_fit").alias("docs"))
    return last.crossJoin(docs).select(
        (F.coalesce("used", F.lit(0)) + F.lit(limit) * (F.coalesce("docs", F.lit(0)) - F.coalesce("fit", F.lit(0)))).alias("tokens")
    )
