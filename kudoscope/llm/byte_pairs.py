"""Byte-level BPE by recursive queries of DuckDB inside each partition.

A task splits its texts into words, and encodes each distinct word once.  The
words' bytes are rows of a token table (word, place, token); a recursive query
joins neighbouring tokens with the merge table, contracts the leftmost pair of
lowest rank of every word, and repeats until no word has a pair left.  An
ordered aggregation turns token rows back into bytes.  A text's ids are those
of its words in order.

Words of more than ``LONG_BYTES`` bytes would need as many rounds as they have
pairs; they are merged with a heap instead (same result).  Whole texts are
encoded; null is an empty text; repeated rows are treated alike.  The rank
file is read once on the driver, its size bounds what is broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_BYTES = 96
CHUNK_WORDS = 25_000
KNOWN_WORDS = 400_000
PART_WORDS = 150_000
PLAIN_END = 0x100

# g = word * 128 + place of the token's first byte;
# best = rank * 128 + place of the word's leftmost pair of lowest rank, null: done
_CONTRACT = """
WITH RECURSIVE state(g, tok, best) AS (
  SELECT g, tok, min(made * 128 + (g & 127)) OVER (PARTITION BY g >> 7)
  FROM (SELECT g, tok, lead(tok) OVER (PARTITION BY g >> 7 ORDER BY g) AS nxt FROM bytes)
  LEFT JOIN merges ON pair = tok * 1048576 + nxt
  UNION ALL
  (WITH contracted AS MATERIALIZED (
     SELECT g, tok, made
     FROM (SELECT g,
                  CASE WHEN g & 127 = best & 127 THEN best >> 7 ELSE tok END AS tok,
                  CASE WHEN g & 127 = best & 127
                       THEN CASE WHEN (lead(g, 2) OVER w) >> 7 = g >> 7 THEN lead(tok, 2) OVER w END
                       WHEN (lead(g) OVER w) >> 7 <> g >> 7 THEN NULL
                       WHEN (lead(g) OVER w) & 127 = best & 127 THEN best >> 7
                       ELSE lead(tok) OVER w END AS nxt,
                  (lag(g) OVER w) IS DISTINCT FROM ((g >> 7) << 7) + (best & 127) AS stays
           FROM state WHERE best IS NOT NULL WINDOW w AS (ORDER BY g))
     LEFT JOIN merges ON pair = tok * 1048576 + nxt
     WHERE stays)
   SELECT g, tok, b.best
   FROM contracted
   LEFT JOIN (SELECT g >> 7 AS word, min(made * 128 + (g & 127)) AS best FROM contracted GROUP BY 1) b ON b.word = g >> 7))
SELECT g >> 7 AS word, g & 127 AS pos, tok FROM state WHERE best IS NULL"""

_DECODE = """
SELECT doc, from_hex(string_agg(hex, '' ORDER BY pos)) AS bytes
FROM ids JOIN vocabulary USING (tok) GROUP BY doc"""


class Vocabulary:
    """Ranks of a ``.tiktoken`` file with the merge table they imply: every
    split of a token into two tokens is a pair that makes it."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        self.digest = hashlib.sha256(raw + pattern.encode()).hexdigest()
        self.pattern = pattern
        pairs, made = [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs.append(a * 1048576 + b)
                    made.append(rank)
        self.pairs, self.made = np.array(pairs, dtype=np.int64), np.array(made, dtype=np.int64)

    def connect(self) -> duckdb.DuckDBPyConnection:
        con = duckdb.connect(config={"threads": 1, "memory_limit": "250MB"})
        con.register("m", pa.table({"pair": self.pairs, "made": self.made}))
        con.execute("CREATE TABLE merges AS SELECT * FROM m")
        tokens = [t.hex() for t in self.ranks]
        con.register("v", pa.table({"tok": pa.array(list(self.ranks.values()), pa.int64()), "hex": tokens}))
        con.execute("CREATE TABLE vocabulary AS SELECT * FROM v")
        return con


def merged_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word: the lowest, leftmost pair first, from a heap."""
    n = len(word)
    start, end = list(range(n)), list(range(1, n + 1))
    ahead, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(word[start[i] : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[i], end[j]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            ahead[after[i]] = i
        offer(i)
        if ahead[i] >= 0:
            offer(ahead[i])
    return [ranks[word[start[i] : end[i]]] for i in range(n) if alive[i]]


def _plain_pattern(pattern: str) -> str:
    """The pattern for texts of code points below ``PLAIN_END``, its Unicode
    classes written out (the standard library matches it faster)."""
    for name in ("L", "N"):
        chars = "".join(
            re.escape(chr(c)) for c in range(PLAIN_END) if regex.match(rf"\p{{{name}}}", chr(c))
        )
        pattern = pattern.replace(rf"\p{{{name}}}", f"\0{name}\0")
        pattern = re.sub(rf"\[(\^?[^\]]*)\0{name}\0([^\]]*)\]", lambda m, x=chars: f"[{m[1]}{x}{m[2]}]", pattern)
        pattern = pattern.replace(f"\0{name}\0", f"[{chars}]")
    return pattern


class _Numbers(dict):
    """Numbers for words, given as they first appear."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Coder:
    """Words of a worker with their ids and decoded bytes (at most about
    ``KNOWN_WORDS``, then it starts anew)."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.split_any = regex.compile(vocabulary.pattern).findall
        self.split_plain = re.compile(_plain_pattern(vocabulary.pattern)).findall
        self.con = vocabulary.connect()
        self.byte = np.array([vocabulary.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.forget()

    def split(self, text: str) -> list[str]:
        # the libraries differ on the four separators only, in this range
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_any(text)
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        return self.split_any(text) if odd else self.split_plain(text)

    def forget(self) -> None:
        self.known = _Numbers()
        self.counts = np.empty(0, np.int64)
        self.tokens = np.empty(0, np.int64)
        self.bytes: list[bytes] = []

    def learn(self, words: list[str]) -> None:
        for k in range(0, len(words), CHUNK_WORDS):
            self._learn([w.encode() for w in words[k : k + CHUNK_WORDS]])

    def _learn(self, words: list[bytes]) -> None:
        ranks = self.vocabulary.ranks
        word, pos, tok, ready = [], [], [], [[], [], []]
        for k, w in enumerate(words):
            if w in ranks:
                ids = [ranks[w]]
            elif len(w) > LONG_BYTES:
                ids = merged_by_heap(w, ranks)
            else:
                word.append(k)
                continue
            ready[0] += [k] * len(ids)
            ready[1] += range(len(ids))
            ready[2] += ids
        if word:
            raw = np.frombuffer(b"".join(words[k] for k in word), dtype=np.uint8)
            sizes = np.array([len(words[k]) for k in word], dtype=np.int64)
            pos = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            self.con.register("bytes", pa.table({"g": np.repeat(word, sizes) * 128 + pos, "tok": self.byte[raw]}))
            done = self.con.execute(_CONTRACT).fetchnumpy()
            word, pos, tok = done["word"], done["pos"], done["tok"]
        word, pos, tok = (np.concatenate([np.asarray(a, np.int64), np.asarray(b, np.int64)]) for a, b in zip((word, pos, tok), ready))
        order = np.lexsort((pos, word))
        word, pos, tok = word[order], pos[order], tok[order]
        self.bytes += self.decode(word, pos, tok, len(words))
        self.counts = np.concatenate([self.counts, np.bincount(word, minlength=len(words))])
        self.tokens = np.concatenate([self.tokens, tok])

    def decode(self, doc: np.ndarray, pos: np.ndarray, tok: np.ndarray, n: int) -> list[bytes]:
        """The bytes of ``n`` id lists, given as rows."""
        self.con.register("ids", pa.table({"doc": doc, "pos": pos, "tok": tok}))
        out = [b""] * n
        for d, b in self.con.execute(_DECODE).fetchall():
            out[d] = b
        return out

    def code(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
        """Parts of the texts: how many, offsets and ids, decoded bytes."""
        held, n = [], 0
        for text in texts:
            held.append(self.split(text or ""))
            n += len(held[-1])
            if n >= PART_WORDS:
                yield self._part(held)
                held, n = [], 0
        if held:
            yield self._part(held)

    def _part(self, held: list[list[str]]) -> tuple[int, np.ndarray, np.ndarray, list[bytes]]:
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        flat = list(map(self.known.__getitem__, chain.from_iterable(held)))
        new, self.known.new = self.known.new, []
        self.learn(new)
        at = np.array(flat, dtype=np.int64)
        counts = self.counts[at]
        ends = np.cumsum(counts)
        first = np.cumsum(self.counts) - self.counts
        ids = self.tokens[np.arange(int(counts.sum())) + np.repeat(first[at] - (ends - counts), counts)]
        words_at = np.concatenate([[0], np.cumsum([len(ws) for ws in held])]).astype(np.int64)
        offsets = np.concatenate([[0], ends])[words_at]
        back = list(map(self.bytes.__getitem__, flat))
        cuts = words_at.tolist()
        return len(held), offsets, ids, [b"".join(back[i:j]) for i, j in zip(cuts, cuts[1:])]


_CODERS: dict[str, Coder] = {}


def _coder(vocabulary: Vocabulary) -> Coder:
    """The worker's coder for a vocabulary: it outlives a task, so that later
    tasks of the worker know the words already."""
    if vocabulary.digest not in _CODERS:
        _CODERS.clear()
        _CODERS[vocabulary.digest] = Coder(vocabulary)
    return _CODERS[vocabulary.digest]


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id``, the ids of each text, and the bytes decoded from them."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for b in batches:
            done = 0
            for n, offsets, ids, back in coder.code(b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(done, n),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())),
                        pa.array(back, pa.binary()),
                    ],
                    names=["doc_id", "ids", "decoded"],
                )
                done += n

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(of, "doc_id bigint, ids array<int>, decoded binary")


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """The bytes of each row's id list (null: empty), beside its ``doc_id``.
    An id that the vocabulary lacks is an error."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        top = max(shared.value.ranks.values())
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                lists = [x or [] for x in part.column(1).to_pylist()]
                sizes = np.array([len(x) for x in lists], dtype=np.int64)
                tok = np.array([x for ws in lists for x in ws], dtype=np.int64)
                if len(tok) and (tok.min() < 0 or tok.max() > top):
                    raise ValueError("an id is not in the vocabulary")
                doc = np.repeat(np.arange(len(lists)), sizes)
                pos = np.arange(len(tok)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                back = coder.decode(doc, pos, tok, len(lists))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(back, pa.binary())], names=["doc_id", "decoded"])

    return rows.select(F.col("doc_id").cast("bigint"), ids).mapInArrow(of, "doc_id bigint, decoded binary")


def token_table(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded bytes."""
    return round_trip(docs, vocabulary).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
