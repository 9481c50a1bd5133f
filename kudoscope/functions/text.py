"""Text statistics and tokens, all built from native expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that define a word, a blank and a capital.
BLANK = r"[\s\x1c-\x1f]"
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
CAPITAL = r"\p{IsUppercase}"
# plain letters and marks are named beside the Unicode class: they are found in a
# table, and the class is asked for other characters only
WORD_CHAR = r"[0-9A-Z_a-z\w]"
NO_BLANK = r"[!-~[^\s\x1c-\x1f]]"
WORD_RUN = rf"(?U){WORD_CHAR}+"
# one character and a plain run: Java scans runs of ``+`` in a tight loop, not ``{2,}``
TOKEN_RUN = rf"(?U){WORD_CHAR}{WORD_CHAR}+"
BOUNDED_TOKEN = r"(?U)\b\w\w+\b"

TEXT_STATS = (
    "text_len_chars",
    "text_len_words",
    "avg_word_length",
    "caps_ratio",
    "exclaim_count",
    "question_count",
)


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Remove blanks of any kind (not only spaces) at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def char_length(c: Column) -> Column:
    return F.length(c).cast("int")


def word_count(c: Column) -> Column:
    """Words between blanks: the runs of other characters."""
    return F.regexp_count(c, F.lit(rf"(?U){NO_BLANK}+"))


def mean_word_length(c: Column) -> Column:
    """Non-blank characters per word, 0 when there is no word."""
    words = word_count(c)
    letters = F.length(F.regexp_replace(c, rf"(?U){BLANK}+", ""))
    return F.when(words > 0, letters / words).otherwise(F.when(c.isNotNull(), F.lit(0.0)))


def mean_token_length(c: Column) -> Column:
    r"""Mean length of the ``\w+`` runs, 0 when there is none."""
    runs = F.regexp_count(c, F.lit(WORD_RUN))
    letters = F.length(F.regexp_replace(c, r"(?U)\W+", ""))
    return F.when(runs > 0, letters / runs).otherwise(F.when(c.isNotNull(), F.lit(0.0)))


def caps_ratio(c: Column) -> Column:
    """Share of capitals among all characters, 0 for an empty text."""
    chars = F.length(c)
    return F.when(chars > 0, F.regexp_count(c, F.lit(CAPITAL)) / chars).otherwise(
        F.when(c.isNotNull(), F.lit(0.0))
    )


def count_of(c: Column, mark: str) -> Column:
    """Occurrences of one character."""
    return F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))


def exclaim_count(c: Column) -> Column:
    return count_of(c, "!")


def question_count(c: Column) -> Column:
    return count_of(c, "?")


def text_stats(c: Column) -> dict[str, Column]:
    """The six statistics of a review text; a null text counts as empty."""
    t = filled(c)
    columns = (
        char_length(t),
        word_count(t),
        mean_word_length(t),
        caps_ratio(t),
        exclaim_count(t),
        question_count(t),
    )
    return dict(zip(TEXT_STATS, columns))


def tokens(c: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_RUN), F.lit(0))


def without(words: Column, stop_words: Iterable[str]) -> Column:
    stops = sorted(set(stop_words))
    return F.filter(words, lambda w: ~w.isin(stops)) if stops else words


def ngrams(words: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams with ``low <= n <= high``, joined by one space."""
    parts = []
    for n in range(low, high + 1):
        if n == 1:
            parts.append(words)
            continue
        starts = F.when(
            F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - F.lit(n - 1))
        ).otherwise(F.array().cast("array<int>"))
        parts.append(
            F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + (k - 1)) for k in range(n)]))
        )
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def lexical_richness(words: Column) -> Column:
    """Distinct tokens per token, 0 when there is none."""
    n = F.size(words)
    return F.when(n > 0, F.size(F.array_distinct(words)) / n).otherwise(F.lit(0.0))


def stop_word_ratio(words: Column, stop_words: Iterable[str]) -> Column:
    stops = sorted(set(stop_words))
    n = F.size(words)
    hits = F.size(F.filter(words, lambda w: w.isin(stops)))
    return F.when(n > 0, hits / n).otherwise(F.lit(0.0))


def slug(c: Column, fallback: str = "unk") -> Column:
    """Lower case, everything but letters and digits to ``_``, ends stripped."""
    s = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def slug_name(name: str, fallback: str = "unk") -> str:
    """:func:`slug` for a column name made on the driver."""
    return re.sub(r"\W", "_", name.lower()).strip("_") or fallback


def unique_names(names: Iterable[str]) -> list[str]:
    """Add ``_2``, ``_3`` ... to repeated names, keeping the order."""
    taken: set[str] = set()
    result = []
    for name in names:
        candidate, n = name, 1
        while candidate in taken:
            n += 1
            candidate = f"{name}_{n}"
        taken.add(candidate)
        result.append(candidate)
    return result


def text_column(columns: Iterable[str]) -> str:
    """First column whose name speaks of a text (fixed name fragments)."""
    for name in columns:
        if any(part in name.lower() for part in ("review", "text", "comment")):
            return name
    raise ValueError(f"no text-like column among {list(columns)}")
