"""Named queries: a Spark callable and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kudoscope.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable types: whole numbers as bigint, doubles rounded, flags as
    numbers, times and lists as text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("tinyint", "smallint", "int", "boolean"):
            c = c.cast("bigint") if kind != "boolean" else c.cast("int").cast("bigint")
        elif kind in ("float", "double") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), digits)
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "array<string>":
            c = F.array_join(c, "|")
        out.append(c.alias(name))
    return df.select(*out)


def r6(x: str) -> str:
    """Rounded double in the comparison SQL (no negative zero)."""
    return f"(round(CAST({x} AS DOUBLE), 6) + 0.0)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"
