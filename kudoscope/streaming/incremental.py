"""Incremental ingest: every raw file is read exactly once.

The chunked, skip-what-is-done ingest expressed as a file stream: the stream's
checkpoint remembers the converted files, memory use follows
``maxFilesPerTrigger``, and each run stops when no new file is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kudoscope.schemas import RAW_SCHEMAS
from kudoscope.sources import files


def read_raw_stream(
    spark: SparkSession, dataset: str, folder: str, files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(RAW_SCHEMAS[files.dataset_name(dataset)])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def convert_new_files(
    spark: SparkSession,
    dataset: str,
    folder: str,
    target: str,
    checkpoint: str,
    transform=None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Append the files that arrived since the last run and stop.

    ``transform`` may be any row-wise operator (a cleaner, text statistics).
    """
    rows = read_raw_stream(spark, dataset, folder, files_per_batch)
    if transform is not None:
        rows = transform(rows)
    return (
        rows.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
