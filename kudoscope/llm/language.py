"""Language of a text: mean of hashed subword embeddings, linear softmax.

A word (letters and their marks, lower case) gives its letter n-grams of one to
four, with its borders, and itself; each is hashed to a row of an embedding table.
The mean of the rows of all subwords of a text goes through one linear layer and a
softmax.  Both are trained by stochastic gradient descent in numpy on the driver,
in ``steps`` mini-batches of a bounded sample of labelled rows: ``sample_docs`` in
all, the same number of each language, drawn by a hash of id and text, of which
``window`` words in a row and ``short`` words are used.  One part in five of the sample is held back: on it a
temperature is fitted and the least confidence at which ``precision`` of the
accepted texts are right.  Predictions below it are marked as not accepted.

Prediction reads whole texts, in Arrow batches; a word's subwords are summed once
per batch.  The model (a table of a fixed size) goes to the tasks by broadcast.

Null texts and texts without a letter are ``und`` with score 0; so is everything
where no labelled row exists.  Null languages and rows whose id is null are not
learned from.  Repeated rows are predicted alike.  Very long texts are split into
words piece by piece and count in full.  An empty table gives no rows.  Other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNKNOWN = "und"
BUCKETS, WIDTH = 1 << 16, 16
LONGEST = 4  # letters of a subword
WORDS, PART = 2048, 1 << 20  # words and bytes of text looked at together


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # subword bucket -> vector
    weights: np.ndarray  # vector -> language
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0  # confidence below which a prediction is not accepted

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        logits = (means @ self.weights + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(axis=1, keepdims=True)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of all words, and the number of each word's."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    codes[codes == 32] = 0  # borders of words
    border = codes == 0
    owner = np.cumsum(border) - 1  # a border opens the word behind it
    n = len(codes)
    h, inner = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
    buckets, owners = [], []
    for k in range(1, LONGEST + 1):
        m = n - k + 1
        if m <= 0:
            break
        h = _mixed(h[:m] * np.uint64(31) + codes[k - 1 :] + np.uint64(k))
        inner = inner[:m]
        # a border may only open or close a subword, and is none by itself
        if k > 1:
            inner = inner | (border[k - 2 : n - 1][:m] if k > 2 else False)
        good = ~inner if k > 1 else ~border
        at = np.flatnonzero(good)
        if k == 2:  # no pair of two borders
            at = at[~(border[at] & border[at + 1])]
        buckets.append(h[at])
        owners.append(owner[at])
    whole = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    buckets.append(_mixed(whole))
    owners.append(np.arange(len(words)))
    bucket, own = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return (bucket[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(own, minlength=len(words))


def means(texts: list[list[str]], table: np.ndarray) -> np.ndarray:
    """Mean subword vector of every list of words; zeros for an empty one."""
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    flat = [w for t in texts for w in t]
    out = np.zeros((len(texts), table.shape[1]))
    if not flat:
        return out
    codes, found = pd.factorize(np.array(flat, dtype=object))
    sums, sizes = np.empty((len(found), table.shape[1])), np.empty(len(found), dtype=np.int64)
    for lo in range(0, len(found), WORDS):  # a word has some dozens of subwords
        part = slice(lo, lo + WORDS)
        buckets, sizes[part] = subwords(list(found[part]))
        starts = np.concatenate([[0], np.cumsum(sizes[part])[:-1]])
        sums[part] = np.add.reduceat(table[buckets], starts, axis=0)
    for d in range(table.shape[1]):
        out[:, d] = np.bincount(owner, weights=sums[codes, d], minlength=len(texts))
    number = np.bincount(owner, weights=sizes[codes], minlength=len(texts))
    return out / np.maximum(number, 1)[:, None]


def _trained(texts: list[list[str]], labels: np.ndarray, langs: list[str], steps: int, rate: float, seed: int) -> Model:
    """Stochastic gradient descent over mini-batches, the rate falling to zero."""
    rng = np.random.default_rng(seed)
    model = Model(
        langs, rng.uniform(-1, 1, (BUCKETS, WIDTH)) / WIDTH, np.zeros((WIDTH, len(langs))), np.zeros(len(langs))
    )
    features = []
    for t in texts:
        found, counts = np.unique(subwords(t)[0], return_counts=True)
        features.append((found, counts / counts.sum()))
    size, done = 16, 0
    while done < steps:
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), size)[: steps - done]:
            at = order[lo : lo + size]
            lr = rate * (1 - done / steps)
            done += 1
            ids = np.concatenate([features[i][0] for i in at])
            share = np.concatenate([features[i][1] for i in at])
            ends = np.cumsum([len(features[i][0]) for i in at])
            hidden = np.add.reduceat(model.table[ids] * share[:, None], np.concatenate([[0], ends[:-1]]), axis=0)
            error = model.probabilities(hidden)
            error[np.arange(len(at)), labels[at]] -= 1
            error /= len(at)
            back = error @ model.weights.T
            model.weights -= lr * hidden.T @ error
            model.bias -= lr * error.sum(axis=0)
            owner = np.repeat(np.arange(len(at)), [len(features[i][0]) for i in at])
            np.subtract.at(model.table, ids, lr * share[:, None] * back[owner])
    return model


def _calibrate(model: Model, texts: list[list[str]], labels: np.ndarray, precision: float) -> None:
    """Temperature of least loss, then the least accepted confidence."""
    if not len(texts):
        return
    hidden, rows = means(texts, model.table), np.arange(len(texts))
    losses = {}
    for t in np.geomspace(0.1, 10, 41):
        model.temperature = float(t)
        losses[model.temperature] = -np.log(np.maximum(model.probabilities(hidden)[rows, labels], 1e-12)).mean()
    model.temperature = min(losses, key=losses.get)
    p = model.probabilities(hidden)
    order = np.argsort(-p.max(axis=1), kind="stable")
    right = np.cumsum(p.argmax(axis=1)[order] == labels[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= precision)
    # where no confidence reaches the precision only a certain answer is accepted
    model.least = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0


def letters(text: Column) -> Column:
    """Lower-case words of letters and marks, one blank between them; empty
    where there is no letter."""
    plain = F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))
    return F.when(text.rlike(r"\p{L}"), plain).otherwise("")


def fit(
    docs: DataFrame,
    learn: Column,
    text: str = "text",
    lang: str = "lang",
    row_id: str = "doc_id",
    sample_docs: int = 3000,
    window: int = 200,
    short: int = 12,
    steps: int = 1200,
    rate: float = 4.0,
    precision: float = 0.99,
    seed: int = 7,
) -> Model | None:
    """The model of the labelled rows where ``learn`` holds (a condition on the
    given table); None where there is none."""
    draw = F.xxhash64(row_id, text)
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).cast("string").alias("lang"), draw.alias("draw"), F.col(text).alias("text")
    )
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    # a language that has no room left in a sample of this size is not learned
    known = {r["lang"]: r["n"] for r in sizes.orderBy(F.desc("n"), "lang").limit(max(1, sample_docs // 20)).collect()}
    langs = sorted(known)
    if not langs:
        return None
    each = max(1, sample_docs // len(langs))
    # a share of the rows by hash that holds about twice the sample, then exactly the first
    shares = F.create_map(*[F.lit(x) for k in langs for x in (k, (2.0 * each + 100) / known[k])])
    first = W.partitionBy("lang").orderBy("draw")
    drawn = (
        rows.where(F.col("draw") / F.lit(2.0**64) + 0.5 <= shares[F.col("lang")])
        .select("lang", "draw", F.split(letters(F.col("text")), " ").alias("words"))
        .select("lang", "draw", F.slice("words", F.pmod("draw", F.size("words")).cast("int") + 1, window).alias("words"))
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= each)
        .orderBy("lang", "draw")
        .select("lang", "draw", F.array_join("words", " ").alias("words"))
        .collect()  # a sample of bounded size
    )
    texts, labels, held = [], [], []
    for r in drawn:
        words = r["words"].split(" ")
        for part in (words, words[:short]):
            texts.append(part)
            labels.append(langs.index(r["lang"]))
            held.append(r["draw"] // 16 % 5 == 0)
    labels, held = np.array(labels), np.array(held)
    pick = lambda mask: ([texts[i] for i in np.flatnonzero(mask)], labels[mask])
    model = _trained(*pick(~held if (~held).any() else held), langs, steps, rate, seed)
    _calibrate(model, *pick(held), precision)
    return model


PREDICTED = "lang_pred string, score double, accepted boolean"


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns ``keep`` (names and values) with the language of each text."""
    kept = docs.select(
        F.struct(*[c.alias(n) for n, c in (keep or {}).items()]).alias("kept") if keep else F.lit(None).cast("int").alias("kept"),
        letters(F.col(text)).alias("words"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for part in _parts(b):
                n = part.num_rows
                lang, score, accepted = [UNKNOWN] * n, np.zeros(n), np.zeros(n, dtype=bool)
                texts = [t.split() for t in part.column(1).to_pylist()]
                at = np.flatnonzero([len(t) > 0 for t in texts])
                if m is not None and len(at):
                    p = m.probabilities(means([texts[i] for i in at], m.table))
                    best = p.argmax(axis=1)
                    score[at] = p[np.arange(len(at)), best]
                    accepted[at] = score[at] >= m.least
                    for i, k in zip(at, best):
                        lang[i] = m.langs[k]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lang, pa.string()), pa.array(np.round(score, 6)), pa.array(accepted)],
                    names=["kept", "lang_pred", "score", "accepted"],
                )

    kind = kept.schema["kept"].dataType.simpleString()
    found = kept.mapInArrow(of, f"kept {kind}, {PREDICTED}")
    return found.select(*(["kept.*"] if keep else []), "lang_pred", "score", "accepted")


def _parts(batch: pa.RecordBatch, most: int = PART) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text."""
    lengths = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)], dtype=np.int64)
    run = np.cumsum(lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(lengths)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def held_out(row_id: Column) -> Column:
    """Rows that the model must not learn from: one in four, by their id."""
    return F.coalesce(F.crc32(row_id.cast("string")) % 4 == 2, F.lit(False))


def language_table(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``accepted`` of every
    row, by a model of the rows that are not held out."""
    doc = F.col("doc_id")
    model = fit(docs, doc.isNotNull() & ~held_out(doc), **options)
    return predict(docs, model, keep={"doc_id": doc, "held_out": held_out(doc)})
