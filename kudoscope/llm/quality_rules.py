"""Line-first cleaning of texts.

Every line is judged on its own by punctuation, navigation and boilerplate
rules; failing lines go, and a document that loses too much of its text, or
that fails the base rules, is rejected.  Everything is a column expression in
the task that reads the text: no shuffle.

Nulls and blank texts have no words and no lines; they are rejected by the
base rules (under ten words).  Repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kudoscope.llm.common import fresh, let, total, words

# Base rules of the query.
NO_SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

# Line rules.
SENTENCE = r"""[.!?…。][\x20\x09-\x0D"'”’»)\]]*\z|[.!?…。]["'”’»)\]]?[\x20\x09-\x0D]"""
MARK_RUN = r"""[!?#*$%&=~^_<>]{2,}["',.;:]*\z|^[!?#*$%&=~^_<>]+\z"""
MENU_MARK = r"^[|>»›•·]+\z"
# The words that MARK_RUN and MENU_MARK find, as one pattern over a line.
MARK_CHAR, MENU_CHAR = "[!?#*$%&=~^_<>]", "[|>»›•·]"
MARKED_WORD = r"""(?:[!?#*$%&=~^_<>]{2,}["',.;:]*|(?<![^\x20\x09-\x0D])[!?#*$%&=~^_<>])(?=[\x20\x09-\x0D]|\z)"""
MENU_WORD = r"(?<![^\x20\x09-\x0D])[|>»›•·]+(?=[\x20\x09-\x0D]|\z)"
BOILERPLATE = (
    r"(?i)\b(all rights reserved|terms of (use|service)|privacy policy|cookie policy|we use cookies"
    r"|accept cookies|enable javascript|click here|subscribe to our newsletter|powered by"
    r"|licensed under|released under the|lorem ipsum|copyright \(c\))"
)
BOILERPLATE_WORDS = 25
MAX_MARKED = 0.2
MENU_WORDS = 0.2
MAX_LOST = 0.5


def repeated_words(ws: Column) -> Column:
    """Number of words covered by windows of five words found twice or more.

    Windows are told apart by a 64-bit hash within their text."""

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            ordered,
            lambda ps: let(
                F.sort_array(
                    F.filter(
                        F.transform(
                            ps,
                            lambda p, j: F.when(
                                F.coalesce(F.get(ps, j - 1)["h"] == p["h"], F.lit(False))
                                | F.coalesce(F.get(ps, j + 1)["h"] == p["h"], F.lit(False)),
                                p["i"],
                            ),
                        ),
                        lambda x: x.isNotNull(),
                    )
                ),
                lambda at: total(
                    F.transform(
                        at,
                        lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1), x + WINDOW) - x),
                    )
                ),
            ),
        )

    windows = F.transform(
        F.slice(ws, F.lit(1), F.size(ws) - (WINDOW - 1)),
        lambda w, i: F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, WINDOW)]),
    )
    return F.when(F.size(ws) <= WINDOW, F.lit(0).cast("bigint")).otherwise(
        let(
            windows,
            lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(covered(w)),
        )
    )


def line_verdicts(lines: Column) -> Column:
    """Per line: the line, its words, their number and the rule it fails, if any."""

    def judge(line: Column) -> Column:
        def of(ws: Column) -> Column:
            n = F.size(ws)
            rule = (
                F.when(n == 0, F.lit(None).cast("string"))
                .when((n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE), F.lit("boilerplate"))
                .when(
                    line.rlike(MENU_CHAR) & (F.regexp_count(line, F.lit(MENU_WORD)) > n * MENU_WORDS),
                    F.lit("navigation"),
                )
                .when(
                    line.rlike(MARK_CHAR) & (F.regexp_count(line, F.lit(MARKED_WORD)) > n * MAX_MARKED),
                    F.lit("marks"),
                )
                .when(~line.rlike(SENTENCE), F.lit("punctuation"))
            )
            return F.struct(line.alias("line"), ws.alias("words"), n.cast("bigint").alias("n_words"), rule.alias("rule"))

        return let(words(line), of)

    return F.transform(lines, judge)


def assessment(text: str = "text") -> Column:
    """Counts, cleaned text and verdict of a text column, as a struct."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n")

    def of(ws: Column, ls: Column) -> Column:
        n = F.size(ws).cast("bigint")
        full = F.filter(ls, lambda x: x["n_words"] > 0)
        repeat = repeated_words(ws)
        lost = total(F.transform(F.filter(ls, lambda x: x["rule"].isNotNull()), lambda x: x["n_words"]))
        out = F.struct(
            n.alias("n_words"),
            F.length(F.array_join(ws, "")).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace(t, NO_SYMBOLS, "")).cast("bigint").alias("n_symbols"),
            (F.size(full) - F.size(F.array_distinct(F.transform(full, lambda x: x["line"]))))
            .cast("bigint")
            .alias("n_dup_lines"),
            repeat.alias("n_repeat_words"),
            F.size(full).cast("bigint").alias("n_lines"),
            F.size(F.filter(ls, lambda x: x["rule"].isNotNull())).cast("bigint").alias("n_failed_lines"),
            lost.alias("n_lost_words"),
            F.array_join(
                F.transform(F.filter(ls, lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n"
            ).alias("cleaned"),
        )
        return out

    def verdict(q: Column) -> Column:
        failed = (q["n_words"] < MIN_WORDS) | (q["n_repeat_words"] * 100 > q["n_words"] * MAX_REPEAT_PERCENT)
        kept = ~failed & (q["n_lost_words"] <= q["n_words"] * MAX_LOST)
        return F.struct(q.alias("counts"), failed.alias("base_failed"), kept.alias("kept"))

    return let(
        line_verdicts(lines),
        lambda ls: let(F.flatten(F.transform(ls, lambda x: x["words"])), lambda ws: let(of(ws, ls), verdict)),
    )


def quality_table(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document."""
    q = docs.select("doc_id", assessment().alias("quality"))
    names = [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_lines", "n_failed_lines", "n_lost_words",
    ]
    return q.select(
        "doc_id", *[F.col(f"quality.counts.{n}").alias(n) for n in names], "quality.base_failed", "quality.kept"
    )


def clean(docs: DataFrame) -> DataFrame:
    """Kept documents without their failing lines; all columns stay, and
    ``n_chars`` (where there is one) follows the text."""
    name = fresh(docs, "quality")
    # generated, not filtered: a filter would assess every text twice
    q = docs.select("*", F.explode(F.filter(F.array(assessment()), lambda x: x["kept"])).alias(name))
    text = F.col(f"{name}.counts.cleaned")
    changed = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return q.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])
