"""Collocations per language, mined by partitioning (SON) over hashed shards.

Texts fall into pieces, pieces into words; a phrase is one to four words in a
row inside a piece.  A phrase found ``least`` times in all is found
``ceil(least / shards)`` times in one shard at least.

1. Every task belongs to a shard by its number.  It reads its texts in blocks of
   words and counts the phrases of a block by a 48-bit hash of language and words.
   Counts are cut at the local support, which loses nothing: only reaching it
   matters.  They are written as sorted differences, a row for each hash range.
2. One task for each range adds the counts of every shard; hashes that reach the
   local support in any shard set their bit.  Equal hashes of different phrases can
   only add candidates.  All ranges together are a bitmap of a fixed size.
3. With the bitmap every task reads its texts again and counts the marked phrases
   exactly, by their words; Spark adds the counts, and the candidates that
   reach ``least`` in all remain, with their exact counts.

Shards are added up by Spark tasks, one for each range; no task sees a shard's
dictionary.  Number of ranges: in proportion to the bytes of text, so that a
range keeps its size; the bitmap keeps its size whatever the data, and where it
fills up more phrases than needed are counted in step 3 (never fewer).

A null text is empty, a null language is ``und``.  Repeated rows count as often
as they occur.  Long texts are read in slices that end between pieces.  Ties in
the score go by count and phrase.  An empty table gives no rows.  Other columns
are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kudoscope.llm.common import forget, written

SHARDS = 8
LONGEST = 4  # words of a phrase
BLOCK_WORDS = 500_000
SLICE = 1 << 20  # bytes of text split at a time
RANGE_BYTES = 1 << 20  # bytes of text for each hash range
BITS = 27  # log2 of the bitmap's size
HASH = 48  # bits of a phrase hash

# Marks that end a piece, and the blanks between words.
PIECE_END = b".,;:!?\n\x0b\x0c\r"
MARK = b","
_TO_MARK = bytes.maketrans(PIECE_END, MARK * len(PIECE_END))


class Block:
    """Words of some texts as numbers, a sequence for each language; zero parts
    two pieces."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {MARK: 0}
        self.parts: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, lang: str, data: bytes) -> None:
        tokens = data.replace(MARK, b" , ").split()
        codes, found = pd.factorize(np.array(tokens, dtype=object))
        known = np.array([self.numbers.setdefault(w, len(self.numbers)) for w in found], dtype=np.int64)
        self.parts.setdefault(lang, []).append(known[codes] if len(codes) else codes)
        self.size += len(codes)

    def sequences(self) -> Iterator[tuple[str, np.ndarray]]:
        for lang, parts in self.parts.items():
            yield lang, np.concatenate([*parts, np.zeros(LONGEST, dtype=np.int64)])


def _slices(data: bytes) -> Iterator[bytes]:
    """The text in slices that end where a piece ends."""
    at = 0
    while at < len(data):
        end = data.find(MARK, at + SLICE)
        end = len(data) if end < 0 else end + 1
        yield data[at:end]
        at = end


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Block]:
    block = Block()
    for b in batches:
        waiting: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            if not (raw := text.as_py()):
                continue
            for data in _slices(raw.lower().translate(_TO_MARK)):
                waiting.setdefault(lang, []).append(data)
                sizes[lang] = sizes.get(lang, 0) + len(data)
                if sizes[lang] >= SLICE:
                    block.add(lang, MARK.join(waiting.pop(lang)) + MARK)
                    del sizes[lang]
                    if block.size >= most:
                        yield block
                        block = Block()
        for lang, parts in waiting.items():
            block.add(lang, MARK.join(parts) + MARK)
        if block.size >= most:
            yield block
            block = Block()
    if block.size:
        yield block


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _word_hashes(block: Block) -> np.ndarray:
    return pd.util.hash_array(np.array(list(block.numbers), dtype=object), categorize=False)


def _phrase_hashes(lang: str, seq: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every phrase length: its words, the places of the phrases, their hashes."""
    n = len(seq) - LONGEST
    seed = pd.util.hash_array(np.array([lang], dtype=object), categorize=False)
    inside, h = np.ones(n, dtype=bool), np.full(n, seed[0], dtype=np.uint64)
    for k in range(LONGEST):
        inside = inside & (seq[k : k + n] > 0)
        h = _mixed(h + hashes[seq[k : k + n]])
        at = np.flatnonzero(inside)
        yield k + 1, at, h[at] >> np.uint64(64 - HASH)


def _packed(values: np.ndarray) -> bytes:
    """Sorted numbers as the first and the differences."""
    steps = np.diff(values, prepend=np.uint64(0))
    small = len(steps) < 2 or steps[1:].max() < 1 << 32
    rest = steps[1:].astype("<u4" if small else "<u8").tobytes()
    return (b"4" if small else b"8") + steps[:1].astype("<u8").tobytes() + rest


def _unpacked(data: bytes) -> np.ndarray:
    rest = np.frombuffer(data, dtype="<u4" if data[:1] == b"4" else "<u8", offset=9)
    first = np.frombuffer(data, dtype="<u8", count=1, offset=1)
    return np.cumsum(np.concatenate([first, rest.astype(np.uint64)]), dtype=np.uint64)


def _local_counts(ranges: int, shards: int, support: int, most: int):
    shift = np.uint64(HASH - int(math.log2(ranges)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        for block in blocks(batches, most):
            words = _word_hashes(block)
            every = [h for lang, seq in block.sequences() for _, _, h in _phrase_hashes(lang, seq, words)]
            found, counts = np.unique(np.concatenate(every), return_counts=True)
            counts = np.minimum(counts, support).astype("<u4" if support > 255 else "u1")
            part = found >> shift
            starts = np.flatnonzero(np.diff(part, prepend=np.uint64(ranges)))
            ends = [*starts[1:].tolist(), len(found)]
            for lo in range(0, len(starts), 4096):
                cut = list(zip(starts[lo : lo + 4096].tolist(), ends[lo : lo + 4096]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[starts[lo : lo + 4096]].astype(np.int64)),
                        pa.array(np.full(len(cut), shard, dtype=np.int32)),
                        pa.array([_packed(found[a:b]) for a, b in cut], pa.binary()),
                        pa.array([counts[a:b].tobytes() for a, b in cut], pa.binary()),
                    ],
                    names=["part", "shard", "hashes", "counts"],
                )

    return of


def _marked(ranges: int, support: int, bits: int):
    """Bits of a range: hashes that reach the support in any of the shards."""
    size, shift = 1 << (bits - int(math.log2(ranges))), np.uint64(HASH - bits)

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        part, out = int(pdf.part.iloc[0]), np.zeros(max(size, 8), dtype=np.uint8)
        for _, rows in pdf.groupby("shard"):
            hashes = np.concatenate([_unpacked(x) for x in rows.hashes])
            counts = np.concatenate([np.frombuffer(x, dtype="<u4" if support > 255 else "u1") for x in rows.counts])
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            starts = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]))
            sums = np.add.reduceat(counts[order].astype(np.int64), starts)
            frequent = hashes[starts[sums >= support]]
            out[(frequent >> shift).astype(np.int64) - part * size] = 1
        return pd.DataFrame({"part": [part], "bits": [np.packbits(out).tobytes()]})

    return of


def _is_marked(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> np.uint64(3)] << (at & np.uint64(7)).astype(np.uint8)) & np.uint8(128) != 0


def _exact_counts(shared, bits: int, most: int):
    shift = np.uint64(HASH - bits)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, dtype=np.uint8)
        for block in blocks(batches, most):
            names = np.array(list(block.numbers), dtype=object)
            words = _word_hashes(block)
            for lang, seq in block.sequences():
                yield _rows(lang, [(0, [b""], [int((seq > 0).sum())])])
                n = len(seq) - LONGEST
                pairs = None
                out = []
                for k, at, h in _phrase_hashes(lang, seq, words):
                    at = at[_is_marked(bitmap, h >> shift)]
                    if not len(at):
                        continue
                    if k > 2 and pairs is None:
                        pairs = np.unique((seq[: n + 2] << 32) | seq[1 : n + 3], return_inverse=True)[1]
                    key = (
                        seq[at] if k == 1
                        else (seq[at] << 32) | seq[at + 1] if k == 2
                        else (pairs[at] << 32) | (seq[at + 2] if k == 3 else pairs[at + 2])
                    )
                    _, first, counts = np.unique(key, return_index=True, return_counts=True)
                    shown = names[seq[at[first][:, None] + np.arange(k)]]
                    out.append((k, [b" ".join(x) for x in shown], counts))
                if out:
                    yield _rows(lang, out)

    return of


def _rows(lang: str, found: list[tuple[int, list[bytes], list[int]]]) -> pa.RecordBatch:
    sizes = [len(x) for _, x, _ in found]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * sum(sizes), pa.string()),
            pa.array(np.repeat([k for k, _, _ in found], sizes).astype(np.int32)),
            pa.array([p for _, x, _ in found for p in x], pa.binary()).cast(pa.string()),
            pa.array(np.concatenate([c for _, _, c in found]).astype(np.int64)),
        ],
        names=["lang", "k", "phrase", "f"],
    )


def frequent_phrases(
    docs: DataFrame, least: int = 30, shards: int = SHARDS, bits: int = BITS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``lang``, ``k`` (words), ``phrase``, ``f`` of all phrases found ``least``
    times; a row with ``k`` 0 holds a language's number of words."""
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("raw")
    )
    size = docs.agg(F.sum(F.octet_length(F.col("text")).cast("bigint"))).first()[0] or 0
    ranges = 1 << min(bits - 3, max(4, math.ceil(math.log2(max(1, size / RANGE_BYTES)))))
    support = max(1, math.ceil(least / shards))
    local = texts.mapInArrow(
        _local_counts(ranges, shards, support, block_words), "part bigint, shard int, hashes binary, counts binary"
    )
    marks = written(local.groupBy("part").applyInPandas(_marked(ranges, support, bits), "part bigint, bits binary"))
    bitmap = bytearray(1 << (bits - 3))  # of the same size for any data
    width = len(bitmap) // ranges
    for row in marks.toLocalIterator():
        bitmap[row["part"] * width : (row["part"] + 1) * width] = row["bits"]
    forget(marks)
    shared = spark.sparkContext.broadcast(bytes(bitmap))
    counts = texts.mapInArrow(_exact_counts(shared, bits, block_words), "lang string, k int, phrase string, f bigint")
    return counts.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where((F.col("k") == 0) | (F.col("f") >= least))


def _part(first, length):
    return F.array_join(F.slice("words", first, length), " ")


def collocations(
    docs: DataFrame, least: int = 30, top: int = 2000, covered: int = 80, scale: int = 2_000_000, **options
) -> DataFrame:
    """Each language's ``top`` phrases of two to four words by the score of
    their weakest cut, without those that a longer phrase mostly covers."""
    f = written(frequent_phrases(docs, least, **options))
    phrases = f.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    parts = f.where("k > 0").select("lang", "phrase", "f")

    cuts = phrases.select("lang", "phrase", "a", "k", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut",
        _part(F.lit(1), F.col("cut")).alias("first"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"),
    )
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(scale).cast("decimal(19,0)") * wide("a"), wide("l") + wide("r"))
    weakest = (
        cuts.join(left, ["lang", "first"])
        .join(right, ["lang", "rest"])
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("w"))
    )

    # every longer phrase covers its parts; of a part only the most frequent counts
    longer = phrases.where("k > 2").select("lang", "k", "a", "words", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("n"))
    inner = longer.select(
        "lang", "a", "n", "words", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("n") + 1)).alias("at")
    ).select("lang", "a", _part(F.col("at"), F.col("n")).alias("phrase"))
    cover = inner.groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    free = weakest.join(cover, ["lang", "phrase"], "left").where(
        F.col("cover").isNull() | (wide("cover") * 100 < wide("a") * covered)
    )

    order = Window.partitionBy("lang").orderBy(F.desc("w.score"), F.desc("a"), F.asc("phrase"))
    ranked = free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = f.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a",
        F.col("w.l").alias("l"), F.col("w.r").alias("r"), "n", F.col("w.score").alias("score"),
    )
