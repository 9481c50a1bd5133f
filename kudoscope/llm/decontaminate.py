"""Benchmark passages in training documents, by suffix arrays of the documents.

The documents are cut into shards of bounded size inside the tasks that read
them.  A shard's suffix array lists its word positions in the order of the
words that follow; it is sorted three words deep at first and deeper only in
the ranges that a test suffix reaches.  Every suffix of every test item is
looked up by binary search, which gives all its verbatim occurrences; runs of
occurrences on one diagonal are the longest matches and their places.

Nothing is shuffled.  The test items travel to the tasks in blocks of
``BLOCK_WORDS`` words.  At most ``PASS_BLOCKS`` blocks are broadcast for a pass
over the documents, however large the benchmark is; what a pass found is
written to the shared folder beside the texts, its broadcasts are given back,
and the next pass adds to it.  Items of more than ``PIECE_WORDS`` words are cut
into pieces that overlap, so no window is lost (only the longest match is
then measured per piece).

A null or wordless text has no words and no match; repeated rows are treated
alike; a null item id counts as an empty string.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kudoscope.llm.common import forget, total, written

WINDOW = 10
SHARD_WORDS = 1_500_000
BLOCK_WORDS = 1_000_000
PASS_BLOCKS = 4
PIECE_WORDS = 1_000_000
GAP = WINDOW + 3

# Words are runs of ASCII letters and digits and of any non-ASCII bytes.
_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


class Tests:
    """A block of test items: the numbers of their words, parted by zeros, and
    one window per suffix."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        self.numbers: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        seq, lengths, owners, places = [], [], [], []
        for owner, (_, ws) in enumerate(items):
            size = min(WINDOW, len(ws))
            n = len(ws) - size + 1
            places.append(np.arange(len(seq), len(seq) + n, dtype=np.int32))
            lengths.append(np.full(n, size, dtype=np.int8))
            owners.append(np.full(n, owner, dtype=np.int32))
            seq += [self.numbers.setdefault(w, len(self.numbers) + 1) for w in ws]
            seq += [0] * WINDOW
        self.seq = np.array(seq, dtype=np.int32)
        self.places, self.lengths, self.owners = map(np.concatenate, (places, lengths, owners))


def _keys(seq: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Three words from ``depth`` on as one number; ``seq`` is padded."""
    return (seq[at + depth] << 42) | (seq[at + depth + 1] << 21) | seq[at + depth + 2]


class Shard:
    """Suffix array over the word numbers of some documents.  Documents are
    parted by zeros, and zero is every word that no test item has."""

    def __init__(self, seqs: list[np.ndarray], starts: np.ndarray):
        self.seq = np.zeros(sum(len(s) + GAP for s in seqs), dtype=np.int64)
        for at, s in zip(starts.tolist(), seqs):
            self.seq[at : at + len(s)] = s
        suffixes = np.flatnonzero(self.seq)
        keys = _keys(self.seq, suffixes, 0)
        order = np.argsort(keys, kind="stable")
        self.sorted = {(0, 0, len(order)): (suffixes[order], keys[order])}
        self.size = len(order)

    def find(self, window: np.ndarray, length: int) -> np.ndarray:
        """Places where the first ``length`` words of the window stand."""
        lo, hi, at = 0, self.size, None
        path = (0, 0, self.size)
        for depth in range(0, length, 3):
            if path not in self.sorted:
                keys = _keys(self.seq, at, depth)
                order = np.argsort(keys, kind="stable")
                self.sorted[path] = (at[order], keys[order])
            places, keys = self.sorted[path]
            take = min(3, length - depth)
            low = sum(int(window[depth + j]) << (42 - 21 * j) for j in range(take))
            lo = np.searchsorted(keys, low, "left")
            hi = np.searchsorted(keys, low + (1 << (63 - 21 * take)) - 1, "right")
            if lo == hi:
                return places[:0]
            at = places[lo:hi]
            path = (*path, depth, int(lo), int(hi))
        return at

    def look_up(self, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences, as pairs of place and number of the test window."""
        hits, which = [], []
        _, first = self.sorted[(0, 0, self.size)]
        seq = tests.seq.astype(np.int64)
        low = _keys(seq, tests.places, 0)
        short = np.flatnonzero(tests.lengths < 3)
        there = np.searchsorted(first, low, "left") < np.searchsorted(first, low, "right")
        there[short] = True
        for k in np.flatnonzero(there):
            at = tests.places[k]
            found = self.find(seq[at : at + WINDOW], int(tests.lengths[k]))
            if len(found):
                hits.append(found)
                which.append(np.full(len(found), k))
        if not hits:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(hits), np.concatenate(which)


def _shard_rows(texts: list[list[bytes]], known: list[dict | None], shared: list[Broadcast]) -> list[dict]:
    """What the blocks show of every document, added to what is ``known`` of it."""
    sizes = np.array([len(ws) for ws in texts], dtype=np.int64)
    starts = np.cumsum(sizes + GAP) - sizes - GAP
    cover = np.zeros(int((sizes + GAP).sum()) + 1, dtype=np.int64)
    items: dict[int, set] = {}
    best: dict[int, tuple] = {}
    for d, k in enumerate(known):
        if k and k["spans"]:
            for x in k["spans"]:
                cover[starts[d] + x["start"]] += 1
                cover[starts[d] + x["end"]] -= 1
            items[d] = set(k["items"])
            best[d] = (-k["longest_words"], k["longest_at"], k["longest_item"])
    for tests in (s.value for s in shared):
        number = tests.numbers.get
        shard = Shard([np.array([number(w, 0) for w in ws], dtype=np.int64) for ws in texts], starts)
        at, which = shard.look_up(tests)
        if not len(at):
            continue
        lengths = tests.lengths[which].astype(np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + lengths, -1)
        doc = np.searchsorted(starts, at, "right") - 1
        for d, o in np.unique(np.stack([doc, tests.owners[which]], axis=1), axis=0).tolist():
            items.setdefault(d, set()).add(tests.ids[o])
        # runs of windows on one diagonal are one longer match
        diagonal = at - tests.places[which]
        order = np.lexsort((at, diagonal))
        a, g, n = at[order], diagonal[order], lengths[order]
        begin = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (a[1:] != a[:-1] + 1)]))
        end = np.concatenate([begin[1:], [len(a)]]) - 1
        size, owner = a[end] + n[end] - a[begin], tests.owners[which][order][begin]
        for d, s, p, o in zip(doc[order][begin].tolist(), size.tolist(), a[begin].tolist(), owner.tolist()):
            best[d] = min(best.get(d, (0, 0, "")), (-s, p - int(starts[d]), tests.ids[o]))
    edge = np.diff(np.concatenate([[False], np.cumsum(cover) > 0, [False]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    spans: dict[int, list] = {}
    for d, a, z in zip((np.searchsorted(starts, first, "right") - 1).tolist(), first.tolist(), last.tolist()):
        spans.setdefault(d, []).append({"start": a - int(starts[d]), "end": z - int(starts[d])})
    return [
        {
            "n_words": n,
            "spans": spans.get(d, []),
            "items": sorted(items.get(d, ())),
            "longest_words": -best[d][0] if d in best else 0,
            "longest_item": best[d][2] if d in best else None,
            "longest_at": best[d][1] if d in best else None,
        }
        for d, n in enumerate(sizes.tolist())
    ]


def _found(texts: list[str | None], known: list[dict | None], shared: list[Broadcast]) -> list[dict]:
    """:func:`_shard_rows` over shards of bounded size."""
    out, held, first, n = [], [], 0, 0
    for k, text in enumerate(texts, 1):
        held.append(words_of(text))
        n += len(held[-1])
        if n >= SHARD_WORDS or k == len(texts):
            out += _shard_rows(held, known[first:k], shared)
            held, first, n = [], k, 0
    return out


def blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Tests]:
    """The items, in blocks of bounded size."""
    block, n = [], 0
    for row in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator():
        ws = words_of(row[1])
        for k in range(0, max(1, len(ws) - WINDOW + 1) if ws else 0, PIECE_WORDS):
            piece = ws[k : k + PIECE_WORDS + WINDOW - 1]
            block.append((row[0], piece))
            n += len(piece)
            if n >= block_words:
                yield Tests(block)
                block, n = [], 0
    if block:
        yield Tests(block)


def _in_passes(
    rows: DataFrame,
    items: DataFrame,
    step: Callable[[DataFrame, list[Broadcast], bool], DataFrame],
    block_words: int,
    pass_blocks: int,
) -> DataFrame:
    """``step(rows, blocks, last)`` over the result of the step before, for
    ``pass_blocks`` blocks at a time; without items, one step with no block."""
    context = rows.sparkSession.sparkContext
    group: list[Broadcast] = []
    before = None
    for tests in blocks(items, block_words):
        if len(group) == pass_blocks:
            rows = written(step(rows, group, False))
            for shared in group:
                shared.destroy()
            if before is not None:
                forget(before)
            group, before = [], rows
        group.append(context.broadcast(tests))
    return step(rows, group, True)


_KNOWN = (
    "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>, "
    "longest_words bigint, longest_item string, longest_at bigint"
)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_KNOWN_TYPES = (pa.int64(), _SPANS, pa.list_(pa.string()), pa.int64(), pa.string(), pa.int64())


def matches(
    docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS, pass_blocks: int = PASS_BLOCKS
) -> DataFrame:
    """One row per document: words, hit words, matching items, and the longest
    match with its item and place (in words)."""
    names = [x.split()[0] for x in _KNOWN.split(", ")]

    def step(rows: DataFrame, shared: list[Broadcast], last: bool) -> DataFrame:
        ahead = rows.columns.index("text") + (not last)  # the last pass needs the texts no more

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                known = b.select(names).to_pylist() if "spans" in b.schema.names else [None] * b.num_rows
                found = _found(b.column(1).to_pylist(), known, shared)
                made = [pa.array([r[k] for r in found], t) for k, t in zip(names, _KNOWN_TYPES)]
                yield pa.RecordBatch.from_arrays(b.columns[:ahead] + made, names=b.schema.names[:ahead] + names)

        return rows.mapInArrow(of, f"doc_id bigint, {'' if last else 'text string, '}{_KNOWN}")

    rows = _in_passes(docs.select(F.col("doc_id").cast("bigint"), "text"), items, step, block_words, pass_blocks)
    n_hit = total(F.transform("spans", lambda x: x["end"] - x["start"]))
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), "items", "longest_words", "longest_item", "longest_at"
    )


def decontaminated(
    docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS, pass_blocks: int = PASS_BLOCKS
) -> DataFrame:
    """The documents, with all their columns, that share no window with an item."""
    at = docs.columns.index("text")

    def step(rows: DataFrame, shared: list[Broadcast], last: bool) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = _found(b.column(at).to_pylist(), [None] * b.num_rows, shared)
                yield b.filter(pa.array([not r["spans"] for r in found], pa.bool_()))

        return rows.mapInArrow(keep, docs.schema)

    return _in_passes(docs, items, step, block_words, pass_blocks)
