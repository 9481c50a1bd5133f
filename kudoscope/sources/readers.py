"""Readers: raw JSON lines and parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kudoscope.operators import joins, sampling
from kudoscope.schemas import RAW_SCHEMAS
from kudoscope.sources import files

BAD_RECORD = "_corrupt_record"


def read_json_lines(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: StructType,
    limit: int | None = None,
    keep_bad: bool = False,
) -> DataFrame:
    """JSON lines, plain or gzip, with an explicit schema.

    Lines that are not JSON become rows of nulls; ``keep_bad`` adds their text.
    """
    full = StructType([*schema.fields, StructField(BAD_RECORD, StringType())]) if keep_bad else schema
    reader = spark.read.schema(full).option("mode", "PERMISSIVE")
    if keep_bad:
        reader = reader.option("columnNameOfCorruptRecord", BAD_RECORD)
    df = reader.json(list(paths) if not isinstance(paths, str) else paths)
    return df.limit(limit) if limit else df


def read_raw(spark: SparkSession, dataset: str, paths: str | Sequence[str], **options) -> DataFrame:
    return read_json_lines(spark, paths, RAW_SCHEMAS[files.dataset_name(dataset)], **options)


def read_matching_json(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: StructType,
    key: str,
    ids: DataFrame,
    keep: Sequence[str],
) -> DataFrame:
    """Raw rows whose key is among ``ids``, some columns only (pruned in the scan)."""
    rows = read_json_lines(spark, paths, schema).select(*dict.fromkeys([key, *keep]))
    return joins.keep_matching(rows, ids, key).select(*keep)


def read_shards(spark: SparkSession, dataset: str, root: str) -> DataFrame:
    """All parquet shards of a dataset, columns merged by name.

    Shards sit in ``root/dataset``; a single ``root/dataset.parquet`` is the
    older layout.
    """
    name = files.dataset_name(dataset)
    path = files.first_existing(spark, f"{root}/{name}", f"{root}/{name}.parquet")
    if path is None:
        raise FileNotFoundError(f"no parquet of dataset {name!r} in {root}")
    df = (
        spark.read.option("mergeSchema", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .parquet(path)
    )
    return df


def read_table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    n: int | None = None,
    order: str | None = None,
) -> DataFrame:
    """Parquet with a column list and a row cap.

    With ``order`` the head is the first rows by that column (repeatable).
    """
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    if n and n > 0:
        df = (df.orderBy(order) if order else df).limit(n)
    return df


def read_clean(spark: SparkSession, dataset: str, root: str) -> DataFrame | None:
    """Cleaned table under its current or older name, or None."""
    name = files.dataset_name(dataset)
    path = files.first_existing(
        spark, f"{root}/{name}_clean.parquet", f"{root}/{name}.parquet"
    )
    return spark.read.parquet(path) if path else None


def resolve_dataset(spark: SparkSession, folder: str, preferred: str) -> str:
    """Path of the preferred table in a folder, else of the first parquet there."""
    path = files.first_existing(spark, f"{folder}/{preferred}")
    if path:
        return path
    others = files.match(spark, f"{folder}/*.parquet")
    if not others:
        raise FileNotFoundError(f"no parquet in {folder}")
    return others[0]


SUBSET_COLUMNS = ("review_id", "user_id", "business_id", "text", "useful")


def review_subset(
    reviews: DataFrame,
    limit: int,
    positive_only: bool = False,
    seed: int | None = 42,
    columns: Sequence[str] = SUBSET_COLUMNS,
    key: str = "review_id",
) -> DataFrame:
    """At most ``limit`` reviews with known votes.

    A seed takes a sample of the whole table; without one the head by key.
    """
    df = reviews.select(*columns).where(F.col("useful").isNotNull())
    if positive_only:
        df = df.where(F.col("useful") > 0)
    limit = max(limit, 1)
    if seed is None:
        return df.orderBy(key).limit(limit)
    return sampling.sample_rows(df, limit, key, seed)
