"""Removal of repeated 100-byte strings, by prefix-free parsing.

Parse.  A rolling hash is computed at every byte.  The lowest hash among the
places of a 100-byte window is the window's trigger; windows in a row with the
same trigger form a phrase, which runs from the first byte of the first window
to the last byte of the last.  Triggers depend on content alone, so equal
windows stand at the same place behind equal triggers, and every window is in
exactly one phrase.

Parse and dictionary in corpus order.  Phrase occurrences are shuffled by
trigger and sorted by phrase and place.  The first occurrence of a phrase is
its dictionary entry; the windows of all later ones start earlier in the
corpus and are removed whole.

Suffix arrays of the dictionary.  Only where different phrases share a trigger
can one hold a window of the other.  Their bytes are fetched, and the suffixes
(cut at 100 bytes, compared byte by byte) are sorted per trigger with corpus
order breaking ties; in every run of equal suffixes all but the first are
removed.

Occurrences that repeat inside a task's batch are settled there, before the
shuffle.  Groups are read as sorted streams; a trigger with more than
``HOT_ENTRIES`` dictionary entries is dealt out again by its windows.

Null is an empty text.  Texts under 100 bytes stay whole.  Repeated rows hold
the same places, so neither is earlier than the other; a null id sorts last.
Rows that give one id (or none) to different texts are told apart by a 64-bit
hash of the text; for the corpus order they hold the same places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kudoscope.llm.common import written

WIDTH = 100
GRAM = 24
PLACES = WIDTH - GRAM + 1
BATCH_BYTES = 2 << 20
GROUP_ENTRIES = 4000
HOT_ENTRIES = 50_000
NO_ID = (1 << 63) - 1
SETTLED = 255

_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Hashes of any byte ranges of an array, modulo 2^64."""

    up = _powers(_BASE, 1 << 16)
    down = _powers(_INVERSE, 1 << 16)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if n > len(Rolling.up):
            size = 1 << (n - 1).bit_length()
            Rolling.up, Rolling.down = _powers(_BASE, size), _powers(_INVERSE, size)
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(_TABLE[data] * Rolling.up[: n - 1], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * Rolling.down[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _lowest(h: np.ndarray, n: int) -> np.ndarray:
    """For each place, the place of the lowest of the next n values (the first of equals)."""
    at = np.arange(len(h), dtype=np.int32)
    width = 1

    def wider(h, at, by):
        right = h[by:] < h[:-by]
        return np.where(right, h[by:], h[:-by]), np.where(right, at[by:], at[:-by])

    while width * 2 <= n:
        h, at = wider(h, at, width)
        width *= 2
    if width < n:
        h, at = wider(h, at, n - width)
    return at


def parse(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Phrases of the texts: document, first and last window, trigger, key of
    the trigger and hash of the phrase; places are in their text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    none = np.empty(0, np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(data) < WIDTH:
        return dict.fromkeys(("doc", "a", "b", "t", "key", "phrase"), none)
    rolling = Rolling(data)
    grams = rolling.of(slice(0, len(data) - GRAM + 1), slice(GRAM, None))
    trigger = _lowest((grams >> np.uint64(32)).astype(np.uint32), PLACES)
    inside = np.zeros(len(data) + 1, dtype=np.int32)
    long = sizes >= WIDTH
    np.add.at(inside, (ends - sizes)[long], 1)
    np.add.at(inside, (ends - WIDTH + 1)[long], -1)
    s = np.flatnonzero(np.cumsum(inside[: len(trigger)]))
    t = trigger[s].astype(np.int64)
    if not len(s):
        return dict.fromkeys(("doc", "a", "b", "t", "key", "phrase"), none)
    cut = np.flatnonzero((t[1:] != t[:-1]) | (s[1:] != s[:-1] + 1))
    a, b = s[np.concatenate([[0], cut + 1])], s[np.concatenate([cut, [len(s) - 1]])]
    t = t[np.concatenate([[0], cut + 1])]
    doc = np.searchsorted(ends, a, "right")
    base = (ends - sizes)[doc]
    phrase = rolling.of(a, b + WIDTH) + (b - a).astype(np.uint64)
    return {"doc": doc, "a": a - base, "b": b - base, "t": t - base, "key": grams[t].view(np.int64), "phrase": phrase.view(np.int64)}


def _batches(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes, with the number of the first, in lists of bounded size."""
    held, n, first = [], 0, 0
    for k, text in enumerate(column.to_pylist()):
        held.append((text or "").encode())
        n += len(held[-1])
        if n >= BATCH_BYTES:
            yield first, held
            held, n, first = [], 0, k + 1
    if held:
        yield first, held


def _pack(a, t, b) -> np.ndarray:
    return (a.astype(np.int64) << 32) | (t << 8) | b


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrase occurrences ``(key, phrase, doc, tag, place)``; those with an
    earlier twin in the batch come as settled runs ``(first phrase, end, doc, tag, start)``."""
    for batch in batches:
        ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for first, texts in _batches(batch.column(2)):
            p = parse(texts)
            doc, tag = ids[first + p["doc"]], tags[first + p["doc"]]
            order = np.lexsort((p["a"], doc, p["phrase"], p["key"]))
            same = np.zeros(len(order), dtype=bool)
            x, y = order[1:], order[:-1]
            twin = (p["key"][x] == p["key"][y]) & (p["phrase"][x] == p["phrase"][y])
            # repeated rows hold the same place: none of them is earlier
            head = np.maximum.accumulate(np.where(np.concatenate([[True], ~twin]), np.arange(len(order)), 0)) if len(order) else order
            lead = order[head]
            same[order] = (doc[order] != doc[lead]) | (p["a"][order] != p["a"][lead])
            new = ~same
            out = [(p["key"][new], p["phrase"][new], doc[new], tag[new], _pack(p["a"][new], (p["t"] - p["a"])[new], (p["b"] - p["a"])[new]))]
            d = np.flatnonzero(same)
            if len(d):
                start = np.concatenate([[True], (p["doc"][d[1:]] != p["doc"][d[:-1]]) | (p["a"][d[1:]] != p["b"][d[:-1]] + 1)])
                i = np.flatnonzero(start)
                j = np.concatenate([i[1:], [len(d)]]) - 1
                i, j = d[i], d[j]
                out.append((p["phrase"][i], p["b"][j] + WIDTH, doc[i], tag[i], _pack(p["a"][i], np.full(len(i), SETTLED), np.zeros(len(i), np.int64))))
            for columns in out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "phrase", "doc", "tag", "place"])


def _classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted occurrences in, removed ranges (no key) and dictionary entries
    that share their trigger with another phrase (with key) out."""
    held = None  # first entry of the key at hand, not yet given out
    last = None  # key, phrase and leading place of the last row
    for batch in batches:
        key, phrase, doc, tag, place = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        settled = (place >> 8) & 255 == SETTLED
        outs = [(doc[settled], place[settled] >> 32, phrase[settled], tag[settled], None)]
        key, phrase, doc, tag, place = (c[~settled] for c in (key, phrase, doc, tag, place))
        n = len(key)
        if n:
            a, t, b = place >> 32, (place >> 8) & 255, place & 255
            fresh_key = np.concatenate([[last is None or key[0] != last[0]], key[1:] != key[:-1]])
            fresh = fresh_key | np.concatenate([[last is None or phrase[0] != last[1]], phrase[1:] != phrase[:-1]])
            lead = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
            inner = lead >= 0
            led = last[2] if last else (0, 0)
            lead_doc = np.where(inner, doc[lead], led[0])
            lead_a = np.where(inner, a[lead], led[1])
            later = (doc != lead_doc) | (a != lead_a)
            outs.append((doc[later], a[later], (a + b + WIDTH)[later], tag[later], None))
            # entries: one per phrase; the key's first waits for a second
            entry = np.flatnonzero(~later)
            rows = np.stack([doc, a, a + b, tag, a + t], axis=1)[entry]
            keys, first = key[entry], fresh_key[entry]
            group = np.cumsum(first)
            size = np.bincount(group, weights=fresh[entry], minlength=int(group[-1]) + 1 if len(group) else 1)
            send = size[group] > 1 if len(group) else np.empty(0, bool)
            carried = group == 0 if len(group) else send
            if carried.any():
                second = fresh[entry][carried].any() or held == "sent"
                if second:
                    send = send | carried
                    if held is not None and held != "sent":
                        keys, rows = np.concatenate([[held[0]] * len(held[1]), keys]), np.concatenate([held[1], rows])
                        send = np.concatenate([[True] * len(held[1]), send])
                        carried = np.concatenate([[True] * len(held[1]), carried])
                        group = np.concatenate([[0] * len(held[1]), group])
                    held = "sent"
                elif held is not None:
                    held = (held[0], np.concatenate([held[1], rows[carried]])[:2])
            if len(group) and group[-1] > 0:
                tail = group == group[-1]
                held = "sent" if send[tail].any() else (keys[tail][0], rows[tail])
            r = rows[send]
            outs.append((r[:, 0], r[:, 1], r[:, 2], r[:, 3], (keys[send], r[:, 4])))
            last = (key[-1], phrase[-1], (lead_doc[-1], lead_a[-1]))
        for d, start, end, tag, more in outs:
            m = len(d)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(d, pa.int64()), pa.array(tag, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()),
                    pa.nulls(m, pa.int64()) if more is None else pa.array(more[0], pa.int64()),
                    pa.nulls(m, pa.int64()) if more is None else pa.array(more[1], pa.int64()),
                ],
                names=["doc", "tag", "start", "end", "key", "t"],
            )


def _windows(rows: list[dict]) -> Iterator[tuple]:
    """For dictionary entries in corpus order: key and offset before the
    trigger with the suffix (as one sortable value), document, tag, place."""
    parts, numbers = [], []
    for k, r in enumerate(rows):
        data = np.frombuffer(r["bytes"], dtype=np.uint8)
        n = r["end"] - r["start"] + 1
        w = np.lib.stride_tricks.sliding_window_view(data, WIDTH)[:n]
        head = np.empty((n, 9), dtype=np.uint8)
        head[:, :8] = np.frombuffer(int(r["key"]).to_bytes(8, "big", signed=True), dtype=np.uint8)
        head[:, 8] = r["t"] - r["start"] - np.arange(n)
        parts.append(np.concatenate([head, w], axis=1))
        numbers.append(np.stack([np.full(n, k), r["start"] + np.arange(n)], axis=1))
    return np.ascontiguousarray(np.concatenate(parts)).view(f"V{WIDTH + 9}").ravel(), np.concatenate(numbers)


def _suffix_runs(rows: list[dict]) -> list[tuple]:
    """Removed windows, as ranges, of the dictionary entries of some triggers."""
    # by trigger, not start: texts that share an id may hold longer phrases before it
    rows = sorted(rows, key=lambda r: (r["doc"], r["t"]))
    values, numbers = _windows(rows)
    order = np.argsort(values, kind="stable")
    v, m = values[order], numbers[order]
    lead = np.maximum.accumulate(np.where(np.concatenate([[True], v[1:] != v[:-1]]), np.arange(len(v)), 0))
    doc = np.array([r["doc"] for r in rows])[m[:, 0]]
    later = (doc != doc[lead]) | (m[:, 1] != m[lead, 1])
    out = m[later]
    out = out[np.lexsort((out[:, 1], out[:, 0]))]
    if not len(out):
        return []
    new = np.concatenate([[True], (out[1:, 0] != out[:-1, 0]) | (out[1:, 1] != out[:-1, 1] + 1)])
    i = np.flatnonzero(new)
    j = np.concatenate([i[1:], [len(out)]]) - 1
    return [(rows[k]["doc"], rows[k]["tag"], s, e + WIDTH) for k, s, e in zip(out[i, 0].tolist(), out[i, 1].tolist(), out[j, 1].tolist())]


RANGE = "doc bigint, tag bigint, start bigint, end bigint"


def _range_batch(ranges: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*ranges)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["doc", "tag", "start", "end"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dictionary entries sorted by key in, removed ranges out."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if len(held) >= GROUP_ENTRIES and row["key"] != held[-1]["key"]:
                yield _range_batch(_suffix_runs(held))
                held = []
            held.append(row)
    if held:
        yield _range_batch(_suffix_runs(held))


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the dictionary entries of each document."""
    for batch in batches:
        for row in batch.to_pylist():
            text = (row["text"] or "").encode()
            e = row["entries"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array([x[k] for x in e], pa.int64()) for k in ("key", "t", "start", "end")],
                    pa.array([row["doc"]] * len(e), pa.int64()), pa.array([row["tag"]] * len(e), pa.int64()),
                    pa.array([text[x["start"] : x["end"] + WIDTH] for x in e], pa.binary()),
                ],
                names=["key", "t", "start", "end", "doc", "tag", "bytes"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their removed ranges in; counts and kept bytes' digest out."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            text, kept, at, removed, spans = (row["text"] or "").encode(), [], 0, 0, 0
            reach = -1
            for r in sorted(row["ranges"] or [], key=lambda r: (r["start"], r["end"])):
                if r["start"] > reach:
                    spans += 1
                if r["end"] > max(at, r["start"]) or r["start"] > at:
                    kept.append(text[at : r["start"]] if r["start"] > at else b"")
                    removed += r["end"] - max(at, r["start"])
                    at = max(at, r["end"])
                reach = max(reach, r["end"])
            kept.append(text[at:])
            data = b"".join(kept)
            out.append((row["doc_id"], len(text), len(text) - len(data), spans, hashlib.sha256(data).hexdigest(), data))
        c = list(zip(*out)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(c, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes and runs, digest and bytes of what is left."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64("text").alias("tag"),
        "text",
    )
    found = rows.select("doc", "tag", "text").mapInArrow(_occurrences, "key bigint, phrase bigint, doc bigint, tag bigint, place bigint")
    classified = written(
        found.repartition("key")
        .sortWithinPartitions("key", "phrase", "doc", "place")
        .mapInArrow(_classified, RANGE + ", key bigint, t bigint")
    )
    ranges = classified.where("key is null").select("doc", "tag", "start", "end")
    entries = classified.where("key is not null")
    dealt = rows.repartition("doc", "tag")
    by_doc = entries.groupBy("doc", "tag").agg(F.collect_list(F.struct("key", "t", "start", "end")).alias("entries"))
    fetched = (
        dealt.join(by_doc, ["doc", "tag"])
        .select("doc", "tag", "text", "entries")
        .mapInArrow(_fetch, "key bigint, t bigint, start bigint, end bigint, doc bigint, tag bigint, bytes binary")
    )
    hot = [r["key"] for r in entries.groupBy("key").count().where(F.col("count") > HOT_ENTRIES).select("key").toLocalIterator()]
    usual = fetched.where(~F.col("key").isin(hot)) if hot else fetched
    settled = usual.repartition("key").sortWithinPartitions("key").mapInArrow(_settle, RANGE)
    if hot:
        settled = settled.unionByName(_hot_ranges(fetched.where(F.col("key").isin(hot))))
    merged = (
        ranges.unionByName(settled)
        .groupBy("doc", "tag")
        .agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    )
    return (
        dealt.join(merged, ["doc", "tag"], "left")
        .select("doc_id", "text", "ranges")
        .mapInArrow(_cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    )


def _hot_ranges(entries: DataFrame) -> DataFrame:
    """Removed ranges of triggers with very many entries, dealt out by window."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, GROUP_ENTRIES):
                rows = batch.slice(k, GROUP_ENTRIES).to_pylist()
                values, numbers = _windows(rows)
                which = numbers[:, 0].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([v.tobytes() for v in values], pa.binary()),
                        *[pa.array([rows[i][c] for i in which], pa.int64()) for c in ("doc", "tag")],
                        pa.array(numbers[:, 1], pa.int64()),
                    ],
                    names=["window", "doc", "tag", "start"],
                )

    windows = entries.mapInArrow(of, "window binary, doc bigint, tag bigint, start bigint")
    first = windows.groupBy("window").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = windows.join(first, "window").where((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    return later.select("doc", "tag", "start", (F.col("start") + WIDTH).alias("end"))


def repeat_table(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
