"""JSON to parquet, one shard per raw file, all pending files in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kudoscope.schemas import RAW_SCHEMAS
from kudoscope.sources import files, readers

SHARD = "shard"


def shard_of(path: Column) -> Column:
    """Shard name of a raw file: its name with its ending, so ``a.json`` and
    ``a.json.gz`` are two shards."""
    return F.url_decode(F.substring_index(path, "/", -1))


def with_shard(rows: DataFrame) -> DataFrame:
    return rows.withColumn(SHARD, shard_of(F.col("_metadata.file_path")))


def pending_files(spark: SparkSession, paths: Sequence[str], target: str) -> list[str]:
    """Raw files without a shard in ``target``."""
    done = {p.rsplit(f"{SHARD}=", 1)[-1] for p in files.match(spark, f"{target}/{SHARD}=*")}
    return [p for p in paths if files.base_name(p) not in done]


def convert(
    spark: SparkSession,
    dataset: str,
    paths: Sequence[str],
    root: str,
    force: bool = False,
    limit: int | None = None,
    rows_per_file: int | None = None,
) -> list[str]:
    """Convert raw files to ``root/dataset/shard=<file>/``; returns those converted.

    A shard that exists is kept unless ``force``; ``limit`` looks at the first
    files only; ``rows_per_file`` splits the output.  Shards are replaced
    whole, so a job that was cut short can simply be run again.
    """
    name = files.dataset_name(dataset)
    target = f"{root}/{name}"
    chosen = [p for p in sorted(paths) if files.is_raw_file(p)][:limit]
    if not force:
        chosen = pending_files(spark, chosen, target)
    if not chosen:
        return []
    rows = with_shard(readers.read_json_lines(spark, chosen, RAW_SCHEMAS[name]))
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.partitionBy(SHARD).parquet(target)
    return chosen


def ingest(
    spark: SparkSession,
    raw_root: str,
    parquet_root: str,
    datasets: Sequence[str] = ("business", "reviews", "users"),
    **options,
) -> dict[str, list[str]]:
    """Find and convert the raw files of several datasets."""
    found = files.find_raw_files(spark, raw_root, datasets)
    return {
        name: convert(spark, name, paths, parquet_root, **options)
        for name, paths in found.items()
        if paths
    }
