"""TF-IDF over one- and two-word terms, fitted on the training rows.

The vocabulary is found with plain group-bys (ties settled by term, so a rerun
gives the same one); vectors are then made row by row by Spark ML transformers
from that vocabulary, without a shuffle and without leaving sparse form.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import partial

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    StopWordsRemover,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kudoscope.functions import text
from kudoscope.session import keep, release


def english_stop_words() -> list[str]:
    """Default stop list of Spark ML; every function takes another list."""
    return StopWordsRemover.loadDefaultStopWords("english")


@dataclass(frozen=True)
class TermSettings:
    """What counts as a term and how many of them are kept."""

    max_features: int = 3000
    min_df: int = 5
    ngram_range: tuple[int, int] = (1, 2)
    stop_words: tuple[str, ...] | None = None

    def stops(self) -> Sequence[str]:
        return english_stop_words() if self.stop_words is None else self.stop_words


def add_terms(df: DataFrame, column: str, settings: TermSettings, name: str = "terms") -> DataFrame:
    """Array of terms: tokens without stop words, then n-grams of what is left."""
    words = text.without(text.tokens(text.filled(F.col(column))), settings.stops())
    low, high = settings.ngram_range
    return (
        df.withColumn("_words", words)
        .withColumn(name, text.ngrams(F.col("_words"), low, high))
        .drop("_words")
    )


def term_frequencies(df: DataFrame, key: str, column: str, settings: TermSettings) -> DataFrame:
    """Long form ``key``, ``term``, ``tf``; a row of the table is in one task
    already, so counts are folded before the shuffle.

    The outer explode keeps Spark from testing the list for emptiness first,
    which would build all terms of a text once more.
    """
    return (
        add_terms(df.select(key, column), column, settings)
        .select(key, F.explode_outer("terms").alias("term"))
        .where("term is not null")
        .groupBy(key, "term")
        .agg(F.count("*").alias("tf"))
    )


def vocabulary(tf: DataFrame, settings: TermSettings) -> DataFrame:
    """At most ``max_features`` rows ``term``, ``df``, ``total``: the terms of
    enough documents with the highest corpus count."""
    return (
        tf.groupBy("term")
        .agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
        .where(F.col("df") >= settings.min_df)
        .orderBy(F.desc("total"), F.asc("term"))
        .limit(settings.max_features)
    )


def smooth_idf(df_count, rows):
    return F.log((F.lit(1.0) + rows) / (F.lit(1.0) + df_count)) + 1


def tfidf_long(
    train: DataFrame, key: str, column: str, settings: TermSettings, score: DataFrame | None = None
) -> DataFrame:
    """Long form ``key``, ``term``, ``tf``, ``weight`` with unit rows.

    Fitted on ``train``, applied to ``score`` (or to ``train``).  The vocabulary
    is bounded by ``max_features`` and is broadcast; only its terms are shuffled.
    """
    found, tf = _kept_vocabulary(train, key, column, settings)
    rows = train.agg(F.count("*")).scalar()
    vocab = found.withColumn("idf", smooth_idf(F.col("df"), rows))
    target = tf if score is None else _listed_frequencies(score, key, column, settings, found)
    raw = target.join(F.broadcast(vocab.select("term", "idf")), "term").withColumn(
        "_raw", F.col("tf") * F.col("idf")
    )
    # a row has at most max_features terms, so its window is small
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(W.partitionBy(key)))
    return raw.select(key, "term", "tf", (F.col("_raw") / norm).alias("weight"))


def _listed_frequencies(
    df: DataFrame, key: str, column: str, settings: TermSettings, terms: DataFrame
) -> DataFrame:
    """:func:`term_frequencies` of the listed ``terms`` alone; others stop in the task that read them."""
    every = add_terms(df.select(key, column), column, settings).select(key, F.explode_outer("terms").alias("term"))
    return every.join(F.broadcast(terms.select("term")), "term").groupBy(key, "term").agg(F.count("*").alias("tf"))


def _kept_vocabulary(
    train: DataFrame, key: str, column: str, settings: TermSettings
) -> tuple[DataFrame, DataFrame]:
    """:func:`vocabulary` of ``train``, and the kept term frequencies with those terms.

    Rows with equal keys are one document.  Candidates are the terms with the highest
    count that are in ``min_df`` rows, so no other term has more documents; they are
    the vocabulary unless repeated keys put one below ``min_df``: then twice as many
    are looked at."""
    size = settings.max_features
    words = keep(_words(train, column, settings))
    try:
        while True:
            listed = [t for t, _, _ in most_frequent(words, replace(settings, max_features=size))]
            terms = train.sparkSession.createDataFrame([(t,) for t in listed], "term string")
            tf = keep(_listed_frequencies(train, key, column, settings, terms))
            found = vocabulary(tf, settings)
            if len(listed) < size or found.count() >= settings.max_features:
                return found, tf
            release(tf)
            size *= 2
    finally:
        release(words)


@dataclass
class TfidfModel:
    """Fitted vocabulary (sorted by term) and idf weights."""

    terms: list[str]
    idf: list[float]
    settings: TermSettings
    column: str

    def names(self) -> list[str]:
        return text.unique_names(f"tfidf_{text.slug_name(t)}" for t in self.terms)

    def transform(self, df: DataFrame, output: str = "tfidf") -> DataFrame:
        if not self.terms:
            return df
        return self.stages(output).transform(
            add_terms(df, self.column, self.settings, "_terms")
        ).drop("_terms", "_counts", "_weighted")

    def of_words(self, words: DataFrame, output: str = "tfidf") -> DataFrame:
        """Vectors of rows whose texts are split into ``words``; other columns stay."""
        terms = text.ngrams(F.col("words"), *self.settings.ngram_range)
        found = words.withColumn("_terms", terms).drop("words")
        if not self.terms:
            return found.drop("_terms")
        return self.stages(output).transform(found).drop("_terms", "_counts", "_weighted")

    def stages(self, output: str = "tfidf") -> PipelineModel:
        counts = CountVectorizerModel.from_vocabulary(self.terms, "_terms", "_counts")
        weigh = ElementwiseProduct(
            scalingVec=Vectors.dense(self.idf), inputCol="_counts", outputCol="_weighted"
        )
        unit = Normalizer(p=2.0, inputCol="_weighted", outputCol=output)
        return PipelineModel(stages=[counts, weigh, unit])


CELLS = 1 << 20  # counters of the first pass
HEAVY = 4  # cells looked into first, for every term wanted


def _words(df: DataFrame, column: str, settings: TermSettings, *more: Column) -> DataFrame:
    words = text.without(text.tokens(text.filled(F.col(column))), settings.stops())
    return df.select(*more, words.alias("words"))


def _cell(n: int, i: Column) -> Column:
    """Hash cell of the ``n`` words from place ``i`` (0 is the first)."""
    return F.pmod(F.xxhash64(*[F.get("words", i + k) for k in range(n)]), F.lit(CELLS)).cast("int")


def _term(n: int, i: Column) -> Column:
    return F.concat_ws(" ", *[F.get("words", i + k) for k in range(n)])


def _is_listed(n: int, i: Column) -> Column:
    return _in_cells(_cell(n, i), F.col("bits"))


def _places(n: int) -> Column:
    """First places of the n-grams of a row."""
    return F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n)).otherwise(
        F.array().cast("array<int>")
    )


def _grams(words: DataFrame, settings: TermSettings) -> DataFrame:
    """A row for every place of a word: the n-grams from there as ``n1``, ``n2`` ... structs
    of words; null where the text ends before.

    Zipped and exploded lists run in compiled code, functions of list elements do not."""
    low, high = settings.ngram_range
    after = [
        F.slice("words", k + 1, F.greatest(F.size("words") - k, F.lit(0))).alias(f"w{k}") for k in range(high)
    ]
    rows = words.select(F.explode(F.arrays_zip(*after)).alias("z")).select("z.*")
    return rows.select(
        *[F.when(F.col(f"w{n - 1}").isNotNull(), F.struct(*[f"w{k}" for k in range(n)])).alias(f"n{n}") for n in range(low, high + 1)]
    )


def _gram_cell(n: int) -> Column:
    """:func:`_cell` of an n-gram of :func:`_grams`; null for none."""
    gram = F.col(f"n{n}")
    cell = F.pmod(F.xxhash64(*[gram[f"w{k}"] for k in range(n)]), F.lit(CELLS)).cast("int")
    return F.when(gram.isNotNull(), cell)


def cell_totals(words: DataFrame, settings: TermSettings) -> DataFrame:
    """``cell``, ``n``: how often the terms of a hash cell occur together.

    Only cell numbers are shuffled, folded per task before; their number is fixed."""
    low, high = settings.ngram_range
    cells = F.array(*[_gram_cell(n) for n in range(low, high + 1)])
    every = _grams(words, settings).select(F.explode(cells).alias("cell")).where("cell is not null")
    return every.groupBy("cell").agg(F.count("*").alias("n"))


def term_counts(words: DataFrame, settings: TermSettings, cells: DataFrame) -> DataFrame:
    """``term``, ``total`` of the terms in the listed hash cells."""
    low, high = settings.ngram_range
    terms = [
        F.when(
            _in_cells(_gram_cell(n), F.col("bits")),
            F.concat_ws(" ", *[F.col(f"n{n}")[f"w{k}"] for k in range(n)]),
        )
        for n in range(low, high + 1)
    ]
    rows = _grams(words, settings).withColumn("bits", _bits(cells))
    every = rows.select(F.explode(F.array(*terms)).alias("term")).where("term is not null")
    return every.groupBy("term").agg(F.count("*").alias("total"))


def document_counts(words: DataFrame, settings: TermSettings, terms: Sequence[str]) -> dict[str, int]:
    """Rows that have each of the ``terms``: their places in the vectors of counts, counted."""
    counts = CountVectorizerModel.from_vocabulary(list(terms), "_terms", "_counts")
    vectors = counts.transform(words.select(text.ngrams(F.col("words"), *settings.ngram_range).alias("_terms")))
    places = vectors.select(F.explode(F.unwrap_udt("_counts")["indices"]).alias("place"))
    return {terms[r["place"]]: r["count"] for r in places.groupBy("place").count().collect()}


def _bits(cells: DataFrame) -> Column:
    """The listed cells as bits of one array of numbers."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("cell", F.lit(64)).cast("int"))
    words = cells.groupBy(F.floor(F.col("cell") / 64).alias("id")).agg(F.bit_or(bit).alias("bits"))
    every = cells.sparkSession.range(max(CELLS // 64, 1)).join(words, "id", "left")  # of a fixed size
    listed = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))
    return every.agg(F.transform(listed, lambda e: e["bits"])).scalar()


def _in_cells(cell: Column, bits: Column) -> Column:
    word = F.element_at(bits, F.floor(cell / 64).cast("int") + 1)
    shifted = F.call_function("shiftright", word, F.pmod(cell, F.lit(64)).cast("int"))
    return shifted.bitwiseAND(F.lit(1).cast("bigint")) == 1


def row_counts(words: DataFrame, settings: TermSettings, cells: DataFrame) -> DataFrame:
    """``term``, ``df``, ``total`` of the terms in the listed hash cells.

    Other terms are dropped inside the row, before a string is made of their words.
    The terms left are sorted in the row, so the first of equal ones counts the document."""
    low, high = settings.ngram_range
    parts = [
        F.transform(F.filter(_places(n), partial(_is_listed, n)), partial(_term, n)) for n in range(low, high + 1)
    ]
    listed = words.withColumn("bits", _bits(cells)).select(F.sort_array(F.concat(*parts)).alias("t"))
    entry = F.transform(
        F.col("t"),
        lambda x, i: F.struct(x.alias("term"), ((i == 0) | (x != F.get("t", i - 1))).cast("int").alias("first")),
    )
    return listed.select(F.inline(entry)).groupBy("term").agg(F.sum("first").alias("df"), F.count("*").alias("total"))


def most_frequent(words: DataFrame, settings: TermSettings) -> list[tuple[str, int, int]]:
    """At most ``max_features`` (term, df, total) of the terms in ``min_df`` rows with
    the highest total, ties by term.

    A term occurs no more often than its cell.  The terms of the heaviest cells are
    counted; if the last one wanted occurs as often as every cell left out, no term is
    missing.  Else its total tells which further cells matter, and where there are
    too few terms all cells that reach ``min_df`` do.

    The rows that have a term are counted for the terms with the highest totals alone;
    only where too many of those are in too few rows are they counted for all looked at."""
    cells = keep(cell_totals(words, settings))
    try:
        heaviest = cells.orderBy(F.desc("n")).limit(HEAVY * settings.max_features)
        bound = heaviest.agg(F.min("n")).first()[0] or 1
        found = _first_by_total(words, settings, cells, bound)
        if found is not None:
            return found
        while True:
            found = (
                row_counts(words, settings, cells.where(F.col("n") >= bound))
                .where(F.col("df") >= settings.min_df)
                .orderBy(F.desc("total"), F.asc("term"))
                .limit(settings.max_features)
                .collect()
            )
            full = 0 < len(found) == settings.max_features
            needed = found[-1]["total"] if full else max(settings.min_df, 1)
            if bound <= needed:
                return [(r["term"], r["df"], r["total"]) for r in found]
            bound = needed
    finally:
        release(cells)


def _first_by_total(
    words: DataFrame, settings: TermSettings, cells: DataFrame, bound: int
) -> list[tuple[str, int, int]] | None:
    """:func:`most_frequent` where twice as many terms hold enough that are in ``min_df``
    rows; None where not.  No term of a cell left out occurs more often than ``bound``."""
    listed = (
        term_counts(words, settings, cells.where(F.col("n") >= bound))
        .where(F.col("total") >= bound)
        .orderBy(F.desc("total"), F.asc("term"))
        .limit(2 * settings.max_features)
        .collect()
    )
    if not 0 < settings.max_features <= len(listed):
        return None
    rows = document_counts(words, settings, [r["term"] for r in listed])
    found = [(r["term"], rows[r["term"]], r["total"]) for r in listed if rows[r["term"]] >= settings.min_df]
    return found[: settings.max_features] if len(found) >= settings.max_features else None


def fit_tfidf(train: DataFrame, column: str = "text", settings: TermSettings | None = None) -> TfidfModel:
    """Learn vocabulary and idf; only the bounded vocabulary reaches the driver.

    The texts are split into words once; all passes read the kept words.
    """
    settings = settings or TermSettings()
    kept = keep(_words(train, column, settings))
    try:
        return _fit_words(kept, column, settings)
    finally:
        release(kept)


def _fit_words(kept: DataFrame, column: str, settings: TermSettings) -> TfidfModel:
    """:func:`fit_tfidf` of texts split into kept ``words`` before."""
    rows = kept.count()
    found = most_frequent(kept.select("words"), settings)
    table = sorted(((t, n) for t, n, _ in found), key=lambda r: r[0].encode())
    idf = [math.log((1.0 + rows) / (1.0 + n)) + 1 for _, n in table]
    return TfidfModel([t for t, _ in table], idf, settings, column)


def rank_phrases(
    df: DataFrame,
    label: str,
    column: str = "text",
    settings: TermSettings | None = None,
    k: int = 25,
    max_iter: int = 400,
    reg: float = 1.0,
) -> DataFrame:
    """Terms tied to a 0/1 label: the k highest and lowest logistic weights.

    The penalty is an L2 one of strength ``reg`` on the summed loss, so it is
    divided by the number of rows for Spark's averaged loss.
    """
    from pyspark.ml.classification import LogisticRegression

    from kudoscope.operators.aggregates import extremes

    settings = settings or TermSettings(max_features=6000)
    label = F.col(label).cast("double").alias("label")
    # texts are split once; the solver reads kept vectors, not the texts again
    kept = keep(_words(df, column, settings, label))
    try:
        model = _fit_words(kept, column, settings)
        data = keep(model.of_words(kept))
        rows = kept.count()
    finally:
        release(kept)
    try:
        fit = LogisticRegression(
            featuresCol="tfidf",
            labelCol="label",
            maxIter=max_iter,
            regParam=reg / max(rows, 1),
            standardization=False,
        ).fit(data)
    finally:
        release(data)
    weights = list(zip(model.terms, (float(w) for w in fit.coefficients)))
    table = df.sparkSession.createDataFrame(weights, "term string, weight double")
    return extremes(table, "weight", "term", k)

