"""Finding files on any file system Spark can read (local, HDFS, object store)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

# Dataset names, accepted endings and file names of the public dump.
DATASETS = ("business", "reviews", "users", "tips")
ALIASES = {
    "review": "reviews",
    "reviews": "reviews",
    "business": "business",
    "businesses": "business",
    "user": "users",
    "users": "users",
    "tip": "tips",
    "tips": "tips",
}
ENDINGS = (".json", ".json.gz", ".jsonl")
FLAT_PATTERNS = {
    "business": "yelp_academic_dataset_business*.json*",
    "reviews": "yelp_academic_dataset_review*.json*",
    "users": "yelp_academic_dataset_user*.json*",
    "tips": "yelp_academic_dataset_tip*.json*",
}


def dataset_name(name: str) -> str:
    """Canonical name; singular and plural are both accepted."""
    lowered = name.strip().lower()
    return ALIASES.get(lowered, lowered)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p = _path(spark, path)
    return _file_system(spark, p).exists(p)


def match(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted paths that match a glob pattern; empty when nothing does."""
    p = _path(spark, pattern)
    found = _file_system(spark, p).globStatus(p)
    return sorted(str(s.getPath().toString()) for s in found) if found else []


def is_raw_file(path: str) -> bool:
    return path.lower().endswith(ENDINGS)


def base_name(path: str) -> str:
    """File name without folder."""
    return path.rstrip("/").rsplit("/", 1)[-1]


def stem(path: str) -> str:
    """File name without folder and raw ending."""
    name = base_name(path)
    for ending in sorted(ENDINGS, key=len, reverse=True):
        if name.lower().endswith(ending):
            return name[: -len(ending)]
    return name


def find_raw_files(
    spark: SparkSession,
    root: str,
    datasets: Iterable[str] = DATASETS,
    folders: dict[str, str] | None = None,
) -> dict[str, list[str]]:
    """Raw files per dataset: a folder (or one file) of its own, else the flat names."""
    found = {}
    for name in map(dataset_name, datasets):
        folder = (folders or {}).get(name, f"{root}/{name}")
        if is_raw_file(folder) and exists(spark, folder):
            files = [folder]
        else:
            files = [f for f in match(spark, f"{folder}/*") if is_raw_file(f)]
        if not files and name in FLAT_PATTERNS:
            files = [f for f in match(spark, f"{root}/{FLAT_PATTERNS[name]}") if is_raw_file(f)]
        found[name] = files
    return found


def first_existing(spark: SparkSession, *candidates: str) -> str | None:
    return next((c for c in candidates if exists(spark, c)), None)
