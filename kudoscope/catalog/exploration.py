"""Queries of the exploratory report, one for each of its tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kudoscope.catalog.base import sql, table
from kudoscope.catalog.features import clean_tables
from kudoscope.catalog.registry import big, query, r6, tidy
from kudoscope.catalog.relational import ENTRY, LISTED, _bin_sql, _histogram_sql, _spearman_sql
from kudoscope.functions.categories import META_GROUPS
from kudoscope.plans import exploration

# The report's base: reviews with their sides, the mean label of a labelled text
# as its sentiment.
BASE = r"""base AS (SELECT r.*, useful AS helpful, ln(1 + useful) AS helpful_log1p, coalesce(length(text), 0) AS text_len_chars,
  len(regexp_extract_all(coalesce(text, ''), '\S+')) AS text_len_words,
  coalesce(length(text) - length(replace(text, '!', '')), 0) AS exclaim_count, coalesce(length(text) - length(replace(text, '?', '')), 0) AS question_count,
  CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) / length(text) ELSE 0 END AS caps_ratio,
  sentiment_compound FROM review r LEFT JOIN (SELECT doc_id, avg(quality) * 2 - 1 AS sentiment_compound FROM labels GROUP BY doc_id) s ON s.doc_id = r.review_id)"""


def _base(spark, sf):
    r, b, u = clean_tables(spark, sf)
    scores = (
        table(spark, sf, "labels")
        .groupBy(F.col("doc_id").alias("review_id"))
        .agg((F.avg("quality") * 2 - 1).alias("sentiment_compound"))
    )
    return exploration.report_base(r, b, u, scores)


def _report(name: str, body: str, *ctes: str):
    """Register the report's table ``name`` under ``J23_report_<name>``."""

    def run(spark, sf):
        return tidy(exploration.report_tables(_base(spark, sf))[name])

    return query(f"J23_report_{name}", sql(body, BASE, *ctes))(run)


_report("helpful_histogram", f"SELECT bin, low, high, n FROM ({_histogram_sql('helpful_log1p', 'base', exploration.BINS)})")
_report("by_month", f"""SELECT {big('m - 1')} AS position, {big('m')} AS month, {r6('avg(helpful)')} AS mean
FROM (SELECT unnest(range(1, 13)) AS m) LEFT JOIN base ON month(date) = m GROUP BY m""")
_report("by_weekday", f"""SELECT {big('d')} AS position,
  ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][d + 1] AS weekday, {r6('avg(helpful)')} AS mean
FROM (SELECT unnest(range(0, 7)) AS d) LEFT JOIN base ON isodow(date) - 1 = d GROUP BY d""")
_report("by_category", f"""SELECT category, {r6('avg(useful)')} AS mean, {r6('median(useful)')} AS median, {big('count(*)')} AS n
FROM entry WHERE category IN (SELECT category FROM entry GROUP BY category ORDER BY count(*) DESC, category LIMIT {exploration.TOP_CATEGORIES})
GROUP BY category""", ENTRY)
_report("by_meta_category", " UNION ALL ".join(
    f"SELECT '{name}' AS flag, {r6(f'avg(CASE WHEN {flag} THEN helpful END)')} AS mean, {big(f'count(CASE WHEN {flag} THEN 1 END)')} AS count FROM base"
    for name, members in META_GROUPS.items()
    for flag in [f"len(list_filter({LISTED}, lambda x: lower(x) IN ({', '.join(repr(m) for m in members)}))) > 0"]))
_report("by_length_decile", f"SELECT {big('bin')} AS decile, {r6('avg(helpful)')} AS mean, {big('count(*)')} AS n FROM (SELECT helpful, {_bin_sql('text_len_words', 10)}) WHERE bin IS NOT NULL GROUP BY bin",
        "t AS (SELECT helpful, text_len_words FROM base)")
_report("by_fans", f"""SELECT {big('p')} AS position, label AS fans_bin, {r6('avg(helpful)')} AS mean
FROM (VALUES (0, '0', -1, 0), (1, '1-5', 0, 5), (2, '6-20', 5, 20), (3, '21-100', 20, 100), (4, '100+', 100, 1000000000)) b(p, label, lo, hi)
LEFT JOIN base ON coalesce(user_fans, 0) > lo AND coalesce(user_fans, 0) <= hi GROUP BY p, label""")
_report("distinct_ids", f"SELECT {big('count(DISTINCT business_id)')} AS business_id, {big('count(DISTINCT user_id)')} AS user_id FROM base")

_PAIRS = [(a, b) for i, a in enumerate(exploration.CORRELATED) for b in exploration.CORRELATED[i + 1 :]]


@query("J23_report_spearman", sql(" UNION ALL ".join(_spearman_sql("base", a, b) for a, b in _PAIRS), BASE))
def report_spearman(spark, sf):
    """All 13 columns; the sides' and the sentiment's nulls leave each pair rows of its own."""
    return tidy(exploration.correlations(_base(spark, sf)))
