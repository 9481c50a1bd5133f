"""Near duplicates by SimHash and covering locality-sensitive hashing.

A fingerprint has the majority bits of the 64-bit hashes of a text's shingles.
For radius r, 2^(r+1) - 1 structured bit masks cover all pairs: the bits get
non-zero labels from {0,1}^(r+1), mask v keeps the bits whose label has an odd
product with v, and for any r differing bits some v has an even product with
all their labels, so the pair agrees on what that mask keeps.  Thus every pair
within the radius meets in some table, and no other pair is linked, because
candidates are compared in full.

Everything works on distinct fingerprints, so copies cost nothing beyond a
partial aggregate.  Buckets of up to ``PAIR_BUCKET`` fingerprints are compared
pair by pair.  In a larger bucket no pairs are made: its fingerprints are
linked through the values that lie between them (within one bit of the one and
r - 1 of the other), which is exact and linear in the bucket.  Links are
contracted round by round with shuffled aggregates; every round is written to
the shared folder.

A null or blank text has fingerprint zero, linked like any other.  A null
doc_id gets a fingerprint and takes part, but is never a component's id unless
all its members are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kudoscope.llm.common import forget, fresh, written

RADIUS = 3
SHINGLE = 3
SEED = 42
BITS = 64
PAIR_BUCKET = 256


def fingerprint(text: str | None) -> int:
    """Signed 64-bit fingerprint of a whole text."""
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    grams = [b" ".join(ws[i : i + SHINGLE]) for i in range(max(1, len(ws) - SHINGLE + 1))]
    h = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype=">u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(h), 65536):
        ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and fingerprint of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(of, "doc_id bigint, fp bigint")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Masks as signed numbers; see the module text."""
    values = range(1, 2 ** (radius + 1))
    labels = [1 + i % len(values) for i in range(bits)]
    masks = [sum(1 << i for i, x in enumerate(labels) if (x & v).bit_count() % 2) for v in values]
    return [m - (1 << bits) if m >> (bits - 1) else m for m in masks]


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i)


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints that connect exactly
    those that a chain of pairs within ``radius`` bits connects."""
    masks = covering_masks(radius)
    keyed = prints.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
        ).alias("x"),
    ).select("fp", "x.t", "x.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keyed.join(sizes, ["t", "key"]).select("t", "key", "fp", (F.col("n") <= PAIR_BUCKET).alias("small")))
    a = members.where("small").select("t", "key", F.col("fp").alias("a"))
    b = members.where("small").select("t", "key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = a.join(b, ["t", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    crowded = members.where("not small").select("fp").distinct()
    if crowded.isEmpty():
        return pairs.distinct()
    return pairs.unionByName(_links_between(crowded, radius)).distinct()


def _links_between(prints: DataFrame, radius: int) -> DataFrame:
    """Links through values between fingerprints: within one bit of the first
    and within ``radius - 1`` of the second."""

    def flipped(df: DataFrame, n: int) -> DataFrame:
        """All values within n bits, each once: flips go from high to low bits."""
        step = df.select("fp", F.col("fp").alias("z"), F.lit(BITS).alias("low"))
        out = step
        for _ in range(n):
            step = (
                step.where("low > 0")
                .select("fp", "z", F.explode(F.sequence(F.lit(0), F.col("low") - 1)).alias("low"))
                .select("fp", F.col("z").bitwiseXOR(_bit(F.col("low"))).alias("z"), "low")
            )
            out = out.unionByName(step)
        return out.select("fp", "z")

    hubs = flipped(prints, 1).groupBy("z").agg(F.min("fp").alias("hub"))
    spokes = flipped(prints, radius - 1)
    return spokes.join(hubs, "z").where("fp != hub").select(
        F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")
    )


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``: nodes share a
    root if and only if a path joins them.

    Every round each node joins its neighbour of lowest mixed number, which
    shrinks the graph by a constant factor on average, also for long chains;
    hot nodes are aggregated before the shuffle."""
    edges = written(edges.select("a", "b").where("a != b"))
    labels = None
    turn = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        joins = written(
            both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(rank("b")), F.min(rank("a")))["v"].alias("to"))
        )
        if labels is None:
            new = written(joins.select("node", F.col("to").alias("root")))
        else:
            to = joins.select(F.col("node").alias("root"), "to")
            new = written(labels.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
            forget(labels)
        labels = new
        by_a, by_b = (joins.select(F.col("node").alias(k), F.col("to").alias(f"{k}_to")) for k in "ab")
        rest = written(
            edges.join(by_a, "a")
            .join(by_b, "b")
            .where("a_to != b_to")
            .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
            .distinct()
        )
        forget(edges)
        forget(joins)
        edges = rest
        turn += 1
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels


def clusters(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row."""
    rows = written(fingerprints(docs))
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    roots = components(links(prints, radius))
    joined = written(
        prints.join(roots, prints.fp == roots.node, "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))
    )
    lowest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(lowest, "root").select("fp", "component_id", "copies")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "copies")


def cluster_table(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    found = clusters(docs, radius)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _row_key(docs: DataFrame) -> list[Column]:
    """Two independent 64-bit hashes over all columns of a row, nulls told apart from what stands beside them."""
    values = []
    for name, kind in docs.dtypes:
        c = F.col(f"`{name}`")
        # a map has no hash and no order of its own
        if "map<" in kind:
            flat = kind.startswith("map<") and kind.count("map<") == 1
            c = F.array_sort(F.map_entries(c)) if flat else F.to_json(F.struct(c))
        values += [F.col(f"`{name}`").isNull(), c]
    return [F.xxhash64(F.lit(seed), *values) for seed in (1, 2)]


def deduplicated(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component stays: the one of the smallest doc_id (null
    last), of rows that share it the one of the smallest row hash.

    Near means the digest contract of the query (three-word shingles, ``radius``
    of 64 bits), not a Jaccard similarity.

    Rows are picked as rows, never by doc_id: different texts under one id or
    under null ids stay unless they are near duplicates.  Only rows equal in
    all columns are taken as one."""
    one, two = fresh(docs, "one"), fresh(docs, "two")
    keyed = docs.select("*", *[k.alias(c) for k, c in zip(_row_key(docs), (one, two))])
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "one", "two")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp, b.column(2), b.column(3)], names=["doc_id", "fp", "one", "two"])

    # partial aggregates: a hot fingerprint is one row before it is shuffled
    prints = written(
        keyed.select(F.col("doc_id").cast("bigint"), "text", F.col(one).alias("one"), F.col(two).alias("two"))
        .mapInArrow(of, "doc_id bigint, fp bigint, one bigint, two bigint")
        .groupBy("fp")
        .agg(F.min(order).alias("first"))
    )
    roots = components(links(prints.select("fp"), radius))
    first = (
        prints.join(roots, prints.fp == roots.node, "left")
        .groupBy(F.coalesce("root", "fp").alias("root"))
        .agg(F.min("first").alias("first"))
        .select(F.col("first.one").alias(one), F.col("first.two").alias(two))
    )
    return keyed.join(first, [one, two], "left_semi").dropDuplicates([one, two]).select(*[F.col(f"`{c}`") for c in docs.columns])
