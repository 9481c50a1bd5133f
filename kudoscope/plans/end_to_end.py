"""From raw files to model metrics in one Spark application."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kudoscope.operators import clean
from kudoscope.plans import feature_matrix, master, sweep
from kudoscope.sources import ingest, readers, sinks

DATASETS = ("reviews", "users", "business")  # fixed values


def clean_dataset(
    spark: SparkSession, dataset: str, parquet_root: str, clean_root: str, limit: int | None = None
) -> str:
    """Clean all shards of a dataset; ``limit`` caps the rows of a smoke run."""
    rows = clean.cap_rows(readers.read_shards(spark, dataset, parquet_root), limit)
    return sinks.write_parquet(clean.CLEANERS[dataset](rows), f"{clean_root}/{dataset}_clean.parquet")


def build_datasets(
    spark: SparkSession, clean_root: str, data_root: str, fraction: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Join the cleaned tables, derive targets and split, in one write.

    The table is partitioned by side, so each side is read without the other.
    """
    reviews = readers.read_clean(spark, "reviews", clean_root)
    if reviews is None:
        raise FileNotFoundError(f"no cleaned reviews in {clean_root}")
    table = master.split_master(
        reviews,
        readers.read_clean(spark, "business", clean_root),
        readers.read_clean(spark, "users", clean_root),
        fraction,
        seed,
    )
    sided = table.withColumn("side", F.when(F.col("is_eval"), "eval").otherwise("train")).drop("is_eval")
    path = sinks.write_parquet(sided, f"{data_root}/master.parquet", partition_by=["side"])
    written = spark.read.parquet(path)
    return tuple(written.where(F.col("side") == side).drop("side") for side in ("train", "eval"))


def run(
    spark: SparkSession,
    raw_root: str,
    work_root: str,
    datasets: Sequence[str] = DATASETS,
    force: bool = False,
    ingest_limit: int | None = None,
    clean_limit: int | None = None,
    rows_per_file: int | None = None,
    build_features: bool = True,
    model: bool = True,
    settings: sweep.RunSettings | None = None,
) -> dict[str, object]:
    """Ingest, clean, assemble, build features, model; later stages can be skipped."""
    settings = settings or sweep.RunSettings()
    done: dict[str, object] = {}
    shards = f"{work_root}/parquet"
    done["ingest"] = ingest.ingest(
        spark, raw_root, shards, datasets, force=force, limit=ingest_limit, rows_per_file=rows_per_file
    )
    cleaned = f"{work_root}/cleaned"
    done["clean"] = [clean_dataset(spark, d, shards, cleaned, clean_limit) for d in datasets]
    train, held = build_datasets(spark, cleaned, f"{work_root}/datasets")
    done["datasets"] = (train, held)
    if not (build_features or model):
        return done
    train, held = clean.popular_sides(train, held, at_least=settings.min_total_votes)
    tables = feature_matrix.feature_tables(train, held, settings.features)
    if build_features:
        done["features"] = tables.write(f"{work_root}/features")
    if model:
        from kudoscope.plans.training import compare_models

        result = compare_models(tables, settings.models)
        result.write(f"{work_root}/run")
        done["metrics"] = result.metrics
        done["best"] = result.best()
    return done
