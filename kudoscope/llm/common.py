"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kudoscope.session import work_folder

# The white space and word pattern of the operators.
SPACE = " \t\n\x0b\x0c\r"
BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, also where the
    body uses it inside a lambda function."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words between ASCII white space; none for null and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, BREAK))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def before(values: Column, block: int = 256) -> Column:
    """For every place of an array of numbers, the sum of the places before it.

    Summed in blocks, so that the work stays near linear for long arrays."""

    def prefix(items: Column, start: Column) -> Column:
        out = F.aggregate(
            items,
            F.array(start.cast("bigint")),
            lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x),
        )
        return F.slice(out, F.lit(1), F.size(items))

    def blocked(v: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(block))
        blocks = F.transform(firsts, lambda b: F.slice(v, b, F.lit(block)))
        return let(
            blocks,
            lambda bs: F.flatten(F.zip_with(bs, prefix(F.transform(bs, total), F.lit(0)), prefix)),
        )

    return let(values, blocked)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read back: its lineage ends
    there, and a lost executor costs nothing.  (Under a local master without
    ``spark.checkpoint.dir`` the folder is a local one.)"""
    spark = df.sparkSession
    path = work_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`written`."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
