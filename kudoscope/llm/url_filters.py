"""URL filtering against dated lists.

List entries ``(list_name, pattern, action, at)`` add or remove a host (with
its subdomains) or a host with a path prefix.  Per entry key the changes become
validity intervals; every capture ``(url, fetched_at)`` is joined as of its
fetch time with the intervals of its keys: its host, the host's parent domains,
and these with each path prefix.

Intervals are cut at the borders of time buckets, and captures meet them on
(key, bucket), so a popular host is spread over its buckets, and a key with a
long history costs each capture one bucket of it only.

Ties: of changes at one instant, a removal wins; repeated entries count once.
Entries with a null pattern, list or time, and captures without a host, match
nothing; a capture without a time matches nothing.  All captures are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DAYS = 32
FOREVER = "9999-01-01 00:00:00"


def normal_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(host), r"^www\.|\.$", "")


def keys_of(url: Column) -> Column:
    """Entry keys a capture can match: parent domains (of two labels or more)
    and these with each path prefix."""
    labels = F.split(normal_host(url), r"\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    depth = F.size(parts)
    prefixes = F.when(depth == 0, F.array(F.lit(""))).otherwise(
        F.concat(
            F.array(F.lit("")),
            F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/"))),
        )
    )
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    return F.when(normal_host(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(keys))


def intervals(entries: DataFrame) -> DataFrame:
    """``list_name, pattern, valid_from, valid_to`` (exclusive) of listed times."""
    rows = entries.where("list_name is not null and pattern is not null and at is not null and action in ('add', 'remove')")
    once = rows.groupBy("list_name", "pattern", F.col("at").cast("timestamp").alias("at")).agg(F.max("action").alias("action"))
    by = Window.partitionBy("list_name", "pattern").orderBy("at")
    return (
        once.withColumn("valid_to", F.coalesce(F.lead("at").over(by), F.lit(FOREVER).cast("timestamp")))
        .where("action = 'add'")
        .select("list_name", "pattern", F.col("at").alias("valid_from"), "valid_to")
    )


def _bucket(at: Column) -> Column:
    return F.floor(F.unix_seconds(at) / (86400 * BUCKET_DAYS))


def blocked(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``page_id`` and the lists that hold the capture at its fetch time."""
    rows = captures.select("page_id", "url", F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    span = rows.agg(F.min("fetched_at").alias("lo"), F.max("fetched_at").alias("hi")).first()
    valid = intervals(entries)
    if span["lo"] is None:
        valid = valid.where(F.lit(False))
    else:
        lo, hi = F.lit(span["lo"]), F.lit(span["hi"])
        valid = valid.where((F.col("valid_from") <= hi) & (F.col("valid_to") > lo))
        first, last = _bucket(F.greatest("valid_from", lo)), _bucket(F.least("valid_to", hi))
        valid = valid.withColumn("bucket", F.explode(F.sequence(first, last)))
    if "bucket" not in valid.columns:
        valid = valid.withColumn("bucket", F.lit(0).cast("bigint"))
    keyed = rows.where("fetched_at is not null").select(
        "page_id", "url", "fetched_at", _bucket(F.col("fetched_at")).alias("bucket"), F.explode(keys_of(F.col("url"))).alias("pattern")
    )
    return (
        keyed.join(valid, ["pattern", "bucket"])
        .where((F.col("fetched_at") >= F.col("valid_from")) & (F.col("fetched_at") < F.col("valid_to")))
        .groupBy("page_id", "url", "fetched_at")
        .agg(F.array_sort(F.collect_set("list_name")).alias("lists"))
    )


def filtered(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every capture with its fetch time, the lists that held it and whether it stays."""
    hits = blocked(captures, entries).select(
        F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("fetched_at").alias("f"), "lists"
    )
    rows = captures.select("page_id", "url", F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    same = rows.page_id.eqNullSafe(hits.p) & rows.url.eqNullSafe(hits.u) & rows.fetched_at.eqNullSafe(hits.f)
    return rows.join(hits, same, "left").select(
        "page_id", "url", "fetched_at",
        F.coalesce("lists", F.array().cast("array<string>")).alias("lists"), F.col("lists").isNull().alias("kept"),
    )
