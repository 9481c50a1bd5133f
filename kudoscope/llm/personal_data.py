"""Personal data in texts: exact base patterns, and further spans that boosted
trees select among overlapping candidates.

* Base: e-mail, IP, card and phone patterns, leftmost and non-overlapping per
  kind, with their checks.  Base spans always stay.
* Candidates: wide patterns (written-out addresses and their like, digit groups,
  long tokens).  They may overlap each other and the base spans.
* One boosted-tree model per generator scores its candidates by format and context.
  The marks that the base asks for are hidden from it: at and dot are written alike
  before features are taken, a leading ``+`` is cut off, Luhn, the ranges of numbers and
  cue words are no features.  So an address that is written out, a phone without ``+``
  or a token without a cue word scores like the one that the base or a cue shows.
* A base phone also stands in the sample without its country code.
* Labels: a candidate that overlaps a base span (a token behind a cue word) is positive;
  one that could not be personal data by its shape alone (see ``_label``) is negative; free
  near misses are not labelled, as they are what is to be found.
* Labels are counted over all documents.  The trees are fitted on at most ``sample_rows``
  candidates of each generator and label, drawn by (row id, place) over all documents; one
  candidate in four is never fitted on, and the cut of each generator comes from the scores
  of all of those, in all documents: the lowest score from which on at least ``precision``
  of them are positive.  A generator without candidates of both labels, or without
  such a score, selects nothing, and a warning says so.

The fitted trees become column expressions, so documents are read, matched and
scored in one pass without a shuffle.  Nulls and blank texts have no spans;
repeated rows are treated alike, very long texts are matched whole, other columns are
not looked at.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kudoscope.llm.common import before, fresh, forget, let, written
from kudoscope.session import keep, release

# Kinds in the order of the query, and their patterns.  Loops at
# the end of a pattern are possessive (nothing follows that could need a way
# back), and a look-behind starts a run at its first character only.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": r"\+[0-9]"}

# Candidate patterns and cue words.
CANDIDATES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:\x20?(?:@|\(at\)|\[at\])\x20?|\x20at\x20)"
    r"[A-Za-z0-9-]++(?:(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?|\x20dot\x20)[A-Za-z0-9-]{2,}+)*+",
    "number": r"(?<![A-Za-z0-9])[+(]{0,2}[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+(?![A-Za-z0-9])",
    "token": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
}
CANDIDATE_NEEDS = {"email": r"@|\(at\)|\[at\]|\x20at\x20", "number": "[0-9][\\x20()./-]{0,2}[0-9]", "token": "[A-Za-z0-9_-]{20}"}
AT, DOT = r"\x20?(?:@|\(at\)|\[at\])\x20?|\x20at\x20", r"\x20?[(\[]dot[)\]]\x20?|\x20dot\x20"
CUE = r"(?i)(token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\x20?[=:]\x20?[\"']?\z"
CONTEXT = 24

SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
CANDIDATE_SPANS = "array<struct<start:bigint,end:bigint,text:string,maker:string,ahead:string,behind:string,plain:string>>"

FEATURES = (
    "n_digits", "n_letters", "n_upper", "n_seps", "n_dots", "n_groups", "longest_group", "first_group", "last_group",
    "ahead_of_at", "ending", "length", "quoted", "line_start", "digit_before", "colon_before", "word_before", "word_after",
)


@dataclass(frozen=True)
class Trees:
    """Nested ``(feature, threshold, left, right)`` or leaf values, their weights and the cut."""

    trees: tuple
    weights: tuple
    cut: float


@dataclass(frozen=True)
class Model:
    """The fitted trees of the generators that select anything."""

    parts: dict[str, Trees]


def found(text: Column, pattern: str, needs: str) -> Column:
    """Leftmost non-overlapping matches with code-point places."""

    def placed(matches: Column) -> Column:
        gaps = F.transform(
            F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), lambda p: F.length(p)
        )
        return let(
            gaps,
            lambda g: F.zip_with(
                F.zip_with(before(F.zip_with(g, matches, lambda x, m: x + F.length(m))), g, lambda b, x: b + x),
                matches,
                lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("text")),
            ),
        )

    none = F.array().cast("array<struct<start:bigint,end:bigint,text:string>>")
    return F.when(
        text.rlike(needs),
        let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none)),
    ).otherwise(none)


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "phone":
        return n.between(10, 15)
    return F.when(n.between(14, 19), let(digits, _luhn)).otherwise(F.lit(False))


def base_spans(text: Column) -> Column:
    """Valid base spans as ``(start, rank, end, kind)``, in order."""

    def of(rank: int, kind: str) -> Column:
        return F.transform(
            F.filter(found(text, PATTERNS[kind], NEEDS[kind]), lambda m: _valid(kind, m["text"])),
            lambda m: F.struct(
                m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")
            ),
        )

    return F.sort_array(F.concat(*[of(rank, kind).cast(SPANS) for rank, kind in enumerate(KINDS)]))


def candidates(text: Column) -> Column:
    """Candidate spans with their generator, text and surroundings."""

    def of(maker: str) -> Column:
        return F.transform(
            found(text, CANDIDATES[maker], CANDIDATE_NEEDS[maker]),
            lambda m: F.struct(
                m["start"].alias("start"),
                m["end"].alias("end"),
                m["text"].alias("text"),
                F.lit(maker).alias("maker"),
                F.substr(
                    text,
                    (F.greatest(m["start"] - CONTEXT, F.lit(0)) + 1).cast("int"),
                    F.least(m["start"], F.lit(CONTEXT)).cast("int"),
                ).alias("ahead"),
                F.substr(text, (m["end"] + 1).cast("int"), F.lit(2)).alias("behind"),
                plain(m).alias("plain"),
            ),
        )

    return F.concat(*[of(maker).cast(CANDIDATE_SPANS) for maker in CANDIDATES])


def plain(c: Column) -> Column:
    """The candidate with the marks of the base hidden: one way to write at and dot,
    no leading plus."""
    return F.ltrim(F.regexp_replace(F.regexp_replace(c["text"], AT, "@"), DOT, "."), F.lit("+"))


def _features(c: Column) -> dict[str, Column]:
    t, ahead = c["plain"], c["ahead"]

    def count(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)).cast("double")

    def flag(x: Column) -> Column:
        return F.when(x, F.lit(1.0)).otherwise(F.lit(0.0))

    def size(i: int, groups: Column) -> Column:
        return F.coalesce(F.try_element_at(groups, F.lit(i)), F.lit(0)).cast("double")

    groups = F.transform(F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0)), lambda g: F.length(g))
    values = (
        count("[0-9]"), count("[A-Za-z]"), count("[A-Z]"), count("[ ()/-]"), count(r"\."), count("[0-9]+"),
        F.coalesce(F.array_max(groups), F.lit(0)).cast("double"), size(1, groups), size(-1, groups),
        F.greatest(F.instr(t, "@") - 1, F.lit(0)).cast("double"), F.length(F.regexp_extract(t, r"\.([A-Za-z]+)\z", 1)).cast("double"),
        F.length(t).cast("double"),
        flag(ahead.rlike("[\"']\\z")), flag(ahead.rlike(r"(\n|\A)\z")), flag(ahead.rlike(r"[0-9]\x20?\z")),
        flag(ahead.rlike(r"[:=]\x20?[\"']?\z")), flag(ahead.rlike(r"[A-Za-z]\x20\z")), flag(c["behind"].rlike(r"^\x20?[A-Za-z]")),
    )
    return dict(zip(FEATURES, values))


def _label(c: Column, base: Column, f: dict[str, Column]) -> Column:
    """1, 0, or null for a free candidate of a shape that could be personal data.

    By shape alone these are no personal data: no dot behind the at, less than 10 or more
    than 19 digits, a single run of 10 to 13 digits, a token without digits or without
    letters."""
    hit = F.exists(base, lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))
    digits = f["n_digits"]
    free = (
        F.when(c["maker"] == "email", f["ending"] == 0)
        .when(c["maker"] == "number", (digits < 10) | (digits > 19) | ((f["n_groups"] == 1) & (digits < 14)))
        .otherwise((digits == 0) | (f["n_letters"] == 0))
    )
    positive = F.when(c["maker"] == "token", c["ahead"].rlike(CUE) & ~free).otherwise(hit)
    return F.when(positive, F.lit(1.0)).when(~hit & free, F.lit(0.0))


def _tree(node, f: Column) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    name, at, left, right = node
    return F.when(f[name] <= at, _tree(left, f)).otherwise(_tree(right, f))


def _sum_of_trees(model: Trees, f: Column) -> Column:
    """Positive sums lean to personal data."""
    out = F.lit(0.0)
    for weight, t in zip(model.weights, model.trees):
        out = out + _tree(t, f) * weight
    return out


def _chosen(model: Model, c: Column) -> Column:
    """Do the trees of the candidate's generator score it at their cut or above?"""
    out = F.lit(False)
    packed = F.struct(*[v.alias(k) for k, v in _features(c).items()])
    for maker, part in model.parts.items():
        score = let(packed, lambda f: _sum_of_trees(part, f))  # noqa: B023
        out = F.when(c["maker"] == maker, score >= part.cut).otherwise(out)
    return out


def _nodes(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return (FEATURES[split.featureIndex()], float(split.threshold()), _nodes(node.leftChild()), _nodes(node.rightChild()))


def _masked(c: Column, base: Column) -> Column:
    """The candidate and, for one that holds a base phone, the same without its
    country code: the form that the base cannot show."""
    phone = F.exists(base, lambda b: (b["kind"] == "phone") & (b["start"] < c["end"]) & (b["end"] > c["start"]))
    short = F.regexp_replace(c["plain"], r"^[0-9]{1,3}[\x20.-]+", "")
    both = F.array(c, c.withField("plain", short))
    return F.when(phone & (short != c["plain"]), both).otherwise(F.array(c))


def labelled(docs: DataFrame, seed: int) -> DataFrame:
    """Labelled candidates of all documents: maker, label, features, and a draw that
    depends on the row's id, its text and the place."""
    t = F.coalesce("text", F.lit(""))
    rows = docs.select(F.xxhash64(F.lit(seed), "doc_id", "text").alias("row"), t.alias("text")).select(
        "row", base_spans(F.col("text")).alias("base"), F.explode(candidates(F.col("text"))).alias("c")
    )
    rows = rows.select("row", "base", F.explode(_masked(F.col("c"), F.col("base"))).alias("c"))
    packed = F.struct(*[v.alias(k) for k, v in _features(F.col("c")).items()])
    rows = rows.select("row", "base", "c", packed.alias("f"))
    label = _label(F.col("c"), F.col("base"), {k: F.col(f"f.{k}") for k in FEATURES})
    return rows.select(
        F.col("c.maker").alias("maker"), label.alias("label"), F.xxhash64("row", "c.start", "c.text").alias("draw"), "f.*"
    ).where("label is not null")


def fit(
    docs: DataFrame, sample_rows: int = 2000, precision: float = 0.95, rounds: int = 6, depth: int = 3, seed: int = 7
) -> Model | None:
    """Fit on a bounded sample, calibrate on all documents; None for an empty table."""
    if docs.isEmpty():
        return None
    # read three times: the texts are matched once
    table = written(labelled(docs, seed))
    sizes = {(r["maker"], r["label"]): r["n"] for r in table.groupBy("maker", "label").agg(F.count("*").alias("n")).collect()}
    held = F.pmod("draw", F.lit(4)) == 0
    share = F.lit(0.0)
    for (maker, label), n in sizes.items():
        mine = (F.col("maker") == maker) & (F.col("label") == label)
        share = F.when(mine, F.lit(min(1.0, sample_rows / n))).otherwise(share)
    # the draw's high bits; its low bits say what is held back
    drawn = keep(table.where(~held & (F.shiftrightunsigned("draw", 11) * F.lit(2.0**-53) < share)))
    parts = {}
    try:
        for maker in CANDIDATES:
            mine = drawn.where(F.col("maker") == maker)
            if {r["label"] for r in mine.select("label").distinct().collect()} != {0.0, 1.0}:
                warnings.warn(f"{maker}: no labelled candidates of both kinds, only base spans are found", stacklevel=2)
                continue
            fitted = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed).fit(
                VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(mine)
            )
            trees = tuple(_nodes(t._java_obj.rootNode()) for t in fitted.trees)
            parts[maker] = Trees(trees, tuple(float(w) for w in fitted.treeWeights), 0.0)
    finally:
        release(drawn)
    cuts = _calibrated(table.where(held), parts, precision)
    forget(table)
    return Model(cuts)


def _calibrated(held: DataFrame, parts: dict[str, Trees], precision: float) -> dict[str, Trees]:
    """The trees with their cuts, from all held candidates of all documents."""
    if not parts:
        return {}
    score = F.lit(None).cast("double")
    for maker, part in parts.items():
        score = F.when(F.col("maker") == maker, _sum_of_trees(part, F.struct(*FEATURES))).otherwise(score)
    steps = (  # as many rows as the trees have distinct sums
        held.groupBy("maker", F.round(score, 4).alias("score"))
        .agg(F.sum("label").alias("yes"), F.count("*").alias("n"))
        .where("score > 0")
        .orderBy("maker", F.desc("score"))
        .collect()
    )
    out = {}
    for maker, part in parts.items():
        cut, yes, total = float("inf"), 0.0, 0
        for row in steps:
            if row["maker"] == maker:
                yes, total = yes + row["yes"], total + row["n"]
                if yes >= precision * total:
                    cut = row["score"] - 1e-4
        if cut == float("inf"):
            warnings.warn(f"{maker}: no score reaches the precision, only base spans are found", stacklevel=3)
        else:
            out[maker] = Trees(part.trees, part.weights, cut)
    return out


def all_spans(text: Column, base: Column, model: Model | None) -> Column:
    """Base spans and the selected candidates that no base span already covers
    or overlaps, in order.  Added spans carry the kind of their shape."""
    if model is None or not model.parts:
        return base
    digits = lambda c: F.regexp_count(c["text"], F.lit("[0-9]"))
    kind = lambda c: (
        F.when(c["maker"] == "email", F.lit("email"))
        .when(c["maker"] == "token", F.lit("secret"))
        .when(c["text"].rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}\z"), F.lit("ip"))
        .when(digits(c) >= 14, F.lit("card"))
        .otherwise(F.lit("phone"))
    )
    free = F.filter(
        candidates(text), lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))
    )
    chosen = F.filter(free, lambda c: _chosen(model, c))
    added = F.transform(
        chosen,
        lambda c: let(
            kind(c),
            lambda k: F.struct(
                c["start"].alias("start"),
                F.coalesce(F.array_position(F.lit(list(KINDS)), k), F.lit(0)).cast("int").alias("rank"),
                c["end"].alias("end"), k.alias("kind"),
            ),
        ),
    )
    ranked = F.transform(
        added,
        lambda s: F.struct(
            s["start"], F.when(s["rank"] == 0, F.lit(len(KINDS))).otherwise(s["rank"] - 1).alias("rank"), s["end"], s["kind"]
        ),
    )
    return F.sort_array(F.array_distinct(F.concat(base, ranked.cast(SPANS))))


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def spans_of(docs: DataFrame, model: Model | None) -> DataFrame:
    """The id of every document, its base spans and all its spans."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", t.alias("text")).select(
        "doc_id",
        let(
            base_spans(F.col("text")),
            lambda b: F.struct(b.alias("base"), all_spans(F.col("text"), b, model).alias("all")),
        ).alias("found"),
    )


def personal_table(docs: DataFrame, model: Model | None) -> DataFrame:
    s = spans_of(docs, model)
    base = F.col("found.base")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("bigint")

    return s.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found.all")).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by ``[KIND]`` of
    the run's first span."""
    start = F.array(F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")))

    def step(acc: Column, s: Column) -> Column:
        a = acc[0]
        gap = F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        return F.array(
            F.when(
                s["start"] >= a["at"],
                F.struct(F.concat(a["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), s["end"].alias("at")),
            ).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at")))
        )

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(
        let(done, lambda d: F.concat(d[0]["out"], F.substr(text, (d[0]["at"] + 1).cast("int"), F.length(text))))
    )


def redact(docs: DataFrame, model: Model | None) -> DataFrame:
    """All documents and columns, personal data replaced in the text (null
    texts stay null); ``n_chars`` (where there is one) follows the text."""
    name, text = fresh(docs, "found"), F.col("text")
    t = F.coalesce(text, F.lit(""))
    base = docs.withColumn(name, let(base_spans(t), lambda b: all_spans(t, b, model)))
    out = fresh(base, "redacted")
    base = base.withColumn(out, F.when(text.isNotNull(), redacted(text, F.col(name))))
    changed = {"text": F.col(out), "n_chars": F.length(out).cast("bigint")}
    return base.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])
