"""Class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (classes * n_class): one row per class."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    whole = sizes.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("classes"))).scalar()
    return sizes.withColumn("_whole", whole).select(
        label,
        "n",
        (F.col("_whole.rows") / (F.col("_whole.classes") * F.col("n"))).alias("weight"),
    )


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Rows with their class weight; a label has few classes."""
    return df.join(F.broadcast(class_weights(df, label).select(label, "weight")), label)
