"""Queries of the text operators over the given tables, with comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kudoscope.llm import (
    byte_pairs,
    collocations,
    decontaminate,
    hard_negatives,
    language,
    main_text,
    near_duplicates,
    personal_data,
    perspectives,
    quality_rules,
    repeated_text,
    token_counts,
    url_filters,
)
from kudoscope.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


OP6_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
five AS (SELECT doc_id, i, CASE WHEN lead(i, 4) OVER (PARTITION BY doc_id ORDER BY i) IS NOT NULL THEN
           word || ' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY i) || ' '
           || lead(word, 2) OVER (PARTITION BY doc_id ORDER BY i) || ' '
           || lead(word, 3) OVER (PARTITION BY doc_id ORDER BY i) || ' '
           || lead(word, 4) OVER (PARTITION BY doc_id ORDER BY i) END AS five FROM p),
twice AS (SELECT doc_id, i, five IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, five) > 1 AS again FROM five),
rep AS (SELECT doc_id, count(*) FILTER (WHERE c) AS n FROM
          (SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c
           FROM twice) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
judged AS (
  SELECT doc_id, line, len(ws) AS n,
         CASE WHEN len(ws) <= {quality_rules.BOILERPLATE_WORDS} AND regexp_matches(line, {_quoted(quality_rules.BOILERPLATE)}) THEN TRUE
              WHEN len(list_filter(ws, lambda x: regexp_matches(x, {_quoted(quality_rules.MENU_MARK)}))) > len(ws) * {quality_rules.MENU_WORDS} THEN TRUE
              WHEN len(list_filter(ws, lambda x: regexp_matches(x, {_quoted(quality_rules.MARK_RUN)}))) > len(ws) * {quality_rules.MAX_MARKED} THEN TRUE
              ELSE NOT regexp_matches(line, {_quoted(quality_rules.SENTENCE)}) END AS failed
  FROM lw WHERE len(ws) > 0),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
             count(*) FILTER (WHERE failed) AS n_failed_lines,
             coalesce(sum(n) FILTER (WHERE failed), 0) AS n_lost_words FROM judged GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(s.n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(s.n_lines, 0) AS BIGINT) AS n_lines,
             CAST(coalesce(s.n_failed_lines, 0) AS BIGINT) AS n_failed_lines,
             CAST(coalesce(s.n_lost_words, 0) AS BIGINT) AS n_lost_words
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN s USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND n_lost_words <= n_words * {quality_rules.MAX_LOST} AS kept FROM b
"""


@_query("op6_quality_rules", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_table(table(spark, sf_dir, "documents"))


@_query("op9_personal_data")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return personal_data.personal_table(docs, personal_data.fit(docs))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
items AS (SELECT item_id, unnest(CASE WHEN len(ws) BETWEEN 1 AND 9 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 8), lambda i: array_to_string(ws[i:i + 9], ' ')) END) AS win,
             least(len(ws), 10) AS n FROM b WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM items),
dw AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM d, sizes WHERE len(ws) >= n),
hits AS (SELECT dw.doc_id, i, dw.n, item_id FROM
           (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM dw) dw JOIN items ON items.win = dw.win AND items.n = dw.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
            string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@_query("op8_decontamination", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def vocabulary() -> byte_pairs.Vocabulary:
    return byte_pairs.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_query("op7_byte_pairs")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.token_table(table(spark, sf_dir, "documents"), vocabulary())


@_query("op1_near_duplicates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.cluster_table(table(spark, sf_dir, "documents"))


@_query("op2_repeated_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_text.repeat_table(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id, turn, role, text) AS copy FROM conversations),
sides AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
s AS (SELECT t.*, perspective,
             CASE WHEN role = 'system' THEN '<|system|>' || chr(10) WHEN role = perspective THEN '<|assistant|>' || chr(10)
                  ELSE '<|user|>' || role || chr(10) END AS head
      FROM t JOIN sides USING (conv_id)),
g AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM s),
p AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text, copy) AS BIGINT) AS "end" FROM g)
SELECT conv_id, perspective, turn, segment, CAST("end" - length(segment) AS BIGINT) AS start, "end",
       CASE WHEN role = perspective THEN CAST("end" - length(segment) + length(head) AS BIGINT) ELSE "end" END AS mask_start,
       "end" AS mask_end, role = perspective AS trained
FROM p
"""


@_query("op3_perspectives", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.segments(table(spark, sf_dir, "conversations"))


@_query("op4_main_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_texts(table(spark, sf_dir, "pages"))


@_query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vocabulary()
    lengths = token_counts.encoded_lengths(table(spark, sf_dir, "documents"), v.ranks, v.pattern)
    return token_counts.context_table(token_counts.histogram(lengths))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a fetch time that follows from their id (the table has none)."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") % 365 * 86400 + F.col("page_id") % 86399)
    return table(spark, sf_dir, "pages").select("page_id", "url", at.alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries that follow from the pages' hosts: every host is listed on
    a day given by its length and its pages, taken off after some weeks, and
    one in two is listed again on a second list."""
    hosts = (
        pages.select(url_filters.normal_host(F.col("url")).alias("pattern"), "page_id")
        .where("pattern != ''")
        .groupBy("pattern")
        .agg(F.min("page_id").alias("k"))
        .withColumn("n", F.length("pattern").cast("bigint"))
    )
    day = F.lit(1704067200) + (F.col("n") * 11 + F.col("k")) % 300 * 86400

    def change(name: Column, action: str, at: Column) -> Column:
        return F.struct(name.alias("list_name"), F.lit(action).alias("action"), at.alias("s"))

    spam = F.lit("spam")
    changes = F.array(
        change(spam, "add", day),
        change(spam, "remove", day + (F.col("n") % 7 + 1) * 7 * 86400),
        change(spam, "add", day + (F.col("n") % 7 + 5) * 14 * 86400),
        change(F.when(F.col("k") % 2 == 0, F.lit("adult")), "add", day + 30 * 86400),
    )
    return hosts.select("pattern", F.explode(changes).alias("c")).select(
        "c.list_name", "pattern", "c.action", F.timestamp_seconds("c.s").alias("at")
    )


OP10_SQL = r"""
WITH cap AS (SELECT page_id, url, make_timestamp((1704067200 + page_id % 365 * 86400 + page_id % 86399) * 1000000) AS fetched_at,
       regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.|\.$', '') AS host FROM pages),
h AS (SELECT host AS pattern, min(page_id) AS k, length(host) AS n FROM cap WHERE host <> '' GROUP BY host),
d AS (SELECT *, 1704067200 + (n * 11 + k) % 300 * 86400 AS day FROM h),
e AS (SELECT 'spam' AS list_name, pattern, 'add' AS action, day AS s FROM d
      UNION ALL SELECT 'spam', pattern, 'remove', day + (n % 7 + 1) * 7 * 86400 FROM d
      UNION ALL SELECT 'spam', pattern, 'add', day + (n % 7 + 5) * 14 * 86400 FROM d
      UNION ALL SELECT 'adult', pattern, 'add', day + 30 * 86400 FROM d WHERE k % 2 = 0),
u AS (SELECT list_name, pattern, s, max(action) AS action FROM e GROUP BY ALL),
v AS (SELECT *, lead(s) OVER (PARTITION BY list_name, pattern ORDER BY s) AS until FROM u),
i AS (SELECT list_name, pattern, make_timestamp(s * 1000000) AS f, coalesce(make_timestamp(until * 1000000), TIMESTAMP '9999-01-01') AS t FROM v WHERE action = 'add'),
hit AS (SELECT page_id, url, fetched_at, list_sort(list(DISTINCT list_name)) AS lists FROM cap, i
        WHERE (host = pattern OR ends_with(host, '.' || pattern)) AND fetched_at >= f AND fetched_at < t GROUP BY ALL)
SELECT cap.page_id, cap.url, strftime(cap.fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at,
       coalesce(array_to_string(lists, ','), '') AS lists, lists IS NULL AS kept
FROM cap LEFT JOIN hit USING (page_id, url, fetched_at)
"""


@_query("op10_url_filters", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = captures(spark, sf_dir)
    found = url_filters.filtered(seen, list_entries(seen))
    return found.select(
        "page_id",
        "url",
        F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"),
        F.array_join("lists", ",").alias("lists"),
        "kept",
    )


@_query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP12_SQL = r"""
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM r WHERE vec_id % 50 = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label, r.vec_id AS row_id, r.label AS row_label,
             a.vec_id = r.vec_id AND a.label = r.label AND a.v = r.v AS own,
             CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM a, r),
p AS (SELECT anchor_id, label, row_id AS positive_id, score AS positive_score,
             row_number() OVER (PARTITION BY anchor_id, label ORDER BY score DESC, row_id) AS place
      FROM s WHERE row_label = label AND NOT own QUALIFY place <= 5),
g AS (SELECT p.anchor_id, positive_id, positive_score, row_id AS negative_id, score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.label, place ORDER BY score DESC, row_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label = p.label AND s.row_label <> p.label
        AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM g WHERE rank <= 3
"""


@_query("op12_hard_negatives", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    shifted = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=shifted)


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT d, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS p
      FROM (SELECT d, lang, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') AS ps FROM d)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM
        (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 30),
cuts AS (SELECT lang, k, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS h, array_to_string(ws[cut + 1:k], ' ') AS t
         FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r, (2000000 * a::HUGEINT) // (x.f::HUGEINT + y.f::HUGEINT) AS score
      FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = h JOIN f y ON y.lang = cuts.lang AND y.phrase = t
      QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, cut) = 1),
sub AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS cover FROM
         (SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL),
o AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
      FROM s LEFT JOIN sub ON sub.lang = s.lang AND sub.phrase = s.phrase WHERE cover IS NULL OR 100 * cover::HUGEINT < 80 * a::HUGEINT)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


@_query("op11_collocations", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@_query("op13_language")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_table(table(spark, sf_dir, "documents"))
