"""Queries of the feature jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kudoscope.catalog.base import business, documents, review_base, reviews, sql, table, users, with_text
from kudoscope.catalog.functions import STOP_SQL, STOPS, TEXT_STATS_SQL, TOKENS
from kudoscope.catalog.registry import big, query, r6, tidy
from kudoscope.functions import categories
from kudoscope.operators import checks, encoders, ranks, sentiment, tfidf
from kudoscope.plans import feature_matrix, master, review_features
from kudoscope.session import keep

# ---- sentiment ------------------------------------------------------------------

# A caller's lexicon, taken from the data: tokens of labelled documents with the
# mean label (-1..1) as valence, for tokens of at least 20 documents.
LEXICON_SQL = f"""tok AS (SELECT DISTINCT d.doc_id, token, quality FROM documents d JOIN labels USING (doc_id),
  unnest({TOKENS}) u(token)),
lexicon AS (SELECT token, round(avg(quality) * 2 - 1, 3) AS valence FROM tok GROUP BY token HAVING count(*) >= 20)"""


def learned_lexicon(spark, sf):
    from kudoscope.functions import text

    docs = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    words = docs.select("quality", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("token"))
    return (
        words.groupBy("token")
        .agg(F.round(F.avg("quality") * 2 - 1, 3).alias("valence"), F.count("*").alias("n"))
        .where("n >= 20")
        .drop("n")
    )


@query("I2_lexicon_sums", f"""WITH {LEXICON_SQL},
hit AS (SELECT doc_id, count(*) AS hits, sum(valence) AS valence FROM
  (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')) AS token FROM documents) JOIN lexicon USING (token) GROUP BY doc_id)
SELECT d.doc_id, {big('coalesce(hits, 0)')} AS hits, (round(CAST(coalesce(valence, 0) AS DOUBLE), 4) + 0.0) AS valence,
  (round(CAST(coalesce(valence / sqrt(valence * valence + 15), 0) AS DOUBLE), 4) + 0.0) AS compound
FROM documents d LEFT JOIN hit h ON h.doc_id = d.doc_id""")
def lexicon_sums(spark, sf):
    docs = documents(spark, sf)
    return tidy(sentiment.lexicon_sums(docs, "doc_id", "text", learned_lexicon(spark, sf)), 4)


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def rule_score_ctes(lexicon: str, negations=sentiment.NEGATIONS, intensifiers=sentiment.INTENSIFIERS, dampeners=sentiment.DAMPENERS) -> str:
    """``scores``: the published rules in SQL, the three words before a word by ``lag``."""
    edge = r"[^\p{L}\p{N}\p{M}_]+"

    def step(d: int, damping: float) -> str:
        push = f"CASE WHEN r{d} = 'i' THEN {sentiment.BOOST * damping!r} WHEN r{d} IN ('d', 'nd') THEN {-sentiment.BOOST * damping!r} ELSE 0 END"
        return (f"step{d} AS (SELECT *, (v{d - 1} + CASE WHEN v{d - 1} < 0 THEN -({push}) ELSE {push} END) "
                f"* CASE WHEN r{d} IN ('n', 'nd') THEN {sentiment.NEGATION} ELSE 1 END AS v{d} FROM step{d - 1})")

    steps = ",\n".join(step(d, x) for d, x in enumerate(sentiment.DISTANCE_DAMPING, 1))
    return rf"""parts AS (SELECT doc_id, t, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM
  (SELECT doc_id, coalesce(text, '') AS t, regexp_split_to_array(coalesce(text, ''), '[\s\x0b\x1c-\x1f]+') AS ws FROM documents)),
bare AS (SELECT doc_id, i, regexp_replace(replace(replace(w, '''', ''), '’', ''), '^{edge}|{edge}$', '', 'g') AS w FROM parts),
word AS (SELECT doc_id, lower(w) AS token, length(w) > 1 AND regexp_matches(w, '\p{{Lu}}') AND NOT regexp_matches(w, '\p{{Ll}}') AS caps,
  row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM bare WHERE w <> ''),
role AS (SELECT *, CASE WHEN token IN (SELECT token FROM {lexicon}) THEN ''
  WHEN token IN ({_listed(negations)}) THEN CASE WHEN token IN ({_listed(dampeners)}) THEN 'nd' ELSE 'n' END
  WHEN token IN ({_listed(dampeners)}) THEN 'd' WHEN token IN ({_listed(intensifiers)}) THEN 'i' ELSE '' END AS r FROM word),
near AS (SELECT doc_id, token, caps, place, lag(r, 1) OVER o AS r1, lag(r, 2) OVER o AS r2, lag(r, 3) OVER o AS r3,
  bool_or(caps) OVER (PARTITION BY doc_id) AND bool_or(NOT caps) OVER (PARTITION BY doc_id) AS mixed,
  min(CASE WHEN token = 'but' THEN place END) OVER (PARTITION BY doc_id) AS but FROM role WINDOW o AS (PARTITION BY doc_id ORDER BY place)),
step0 AS (SELECT near.*, CAST(valence AS DOUBLE) + CASE WHEN caps AND mixed THEN CASE WHEN valence > 0 THEN {sentiment.CAPS_BOOST} ELSE -{sentiment.CAPS_BOOST} END ELSE 0 END AS v0
  FROM near LEFT JOIN {lexicon} USING (token)),
{steps},
sided AS (SELECT doc_id, coalesce(v3 * CASE WHEN place < but THEN {sentiment.BEFORE_BUT} WHEN place > but THEN {sentiment.AFTER_BUT} ELSE 1 END, 0) AS v FROM step3),
sums AS (SELECT doc_id, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS p, sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END) AS n,
  count(*) FILTER (v = 0) AS neu FROM sided GROUP BY doc_id),
marks AS (SELECT doc_id, least(length(t) - length(replace(t, '!', '')), {sentiment.EXCLAIM_MAX}) * {sentiment.EXCLAIM_WEIGHT}
  + CASE WHEN q > {sentiment.QUESTION_MAX} THEN {sentiment.QUESTION_CAP} WHEN q > 1 THEN q * {sentiment.QUESTION_WEIGHT} ELSE 0 END AS stress
  FROM (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) - length(replace(coalesce(text, ''), '?', '')) AS q FROM documents)),
total AS (SELECT doc_id, s + sign(s) * stress AS s, p + CASE WHEN p > n THEN stress ELSE 0 END AS p, n + CASE WHEN n > p THEN stress ELSE 0 END AS n, neu
  FROM marks LEFT JOIN sums USING (doc_id)),
scores AS (SELECT doc_id, coalesce(round(n / nullif(p + n + neu, 0), 3), 0) + 0.0 AS sentiment_neg, coalesce(round(neu / nullif(p + n + neu, 0), 3), 0) + 0.0 AS sentiment_neu,
  coalesce(round(p / nullif(p + n + neu, 0), 3), 0) + 0.0 AS sentiment_pos, coalesce(round(s / sqrt(s * s + {sentiment.ALPHA}), 4), 0) + 0.0 AS sentiment_compound FROM total)"""


@query("I2_lexicon_rule_scores", f"WITH {LEXICON_SQL},\n{rule_score_ctes('lexicon')}\nSELECT * FROM scores")
def lexicon_scores(spark, sf):
    docs = documents(spark, sf)
    return tidy(sentiment.score_sentiment(docs, "doc_id", "text", "lexicon", lexicon=learned_lexicon(spark, sf)))


# Modifiers that the texts do use, beside a lexicon of longer words.
OWN_MODIFIERS = {"negations": ("of", "der", "un"), "intensifiers": ("the", "la", "und", "que"), "dampeners": ("and", "de", "of", "tion")}


@query("I2_rule_scores_own_modifiers", f"""WITH {LEXICON_SQL},
longer AS (SELECT * FROM lexicon WHERE length(token) > 3),
{rule_score_ctes('longer', **OWN_MODIFIERS)}
SELECT * FROM scores""")
def own_modifier_scores(spark, sf):
    docs, lexicon = documents(spark, sf), learned_lexicon(spark, sf).where(F.length("token") > 3)
    return tidy(sentiment.score_sentiment(docs, "doc_id", "text", "lexicon", lexicon=lexicon, **OWN_MODIFIERS))


@query("I3_sentiment_labels", f"""WITH {LEXICON_SQL},
hit AS (SELECT doc_id, sum(valence) AS v FROM
  (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')) AS token FROM documents) JOIN lexicon USING (token) GROUP BY doc_id)
SELECT sentiment_label, {big('count(*)')} AS n FROM (SELECT CASE WHEN c >= 0.05 THEN 'positive' WHEN c <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment_label
  FROM (SELECT round(coalesce(v / sqrt(v * v + 15), 0), 9) AS c FROM documents d LEFT JOIN hit h ON h.doc_id = d.doc_id)) GROUP BY 1""")
def sentiment_labels(spark, sf):
    docs = documents(spark, sf)
    sums = sentiment.lexicon_sums(docs, "doc_id", "text", learned_lexicon(spark, sf))
    label = sentiment.sentiment_label(F.round("compound", 9)).alias("sentiment_label")
    return tidy(sums.select(label).groupBy("sentiment_label").agg(F.count("*").alias("n")))


def load_length_model():
    """Stands in for a caller's model: long texts are positive."""

    def predict(texts: list[str]) -> list[dict[str, float]]:
        out = []
        for t in texts:
            p = len(t) / (len(t) + 500.0)
            out.append({"POSITIVE": p, "NEGATIVE": 1.0 - p} if t else {})
        return out

    return predict


MODEL_SQL = """SELECT {key}, CASE WHEN n = 0 THEN NULL WHEN n / (n + 500.0) >= 0.5 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS sentiment_label,
  (round(CASE WHEN n > 0 THEN greatest(n / (n + 500.0), 500.0 / (n + 500.0)) END, 6) + 0.0) AS sentiment_score,
  (round(CASE WHEN n > 0 THEN n / (n + 500.0) END, 6) + 0.0) AS sentiment_positive,
  (round(CASE WHEN n > 0 THEN 500.0 / (n + 500.0) END, 6) + 0.0) AS sentiment_negative
FROM (SELECT {key}, CAST(length(coalesce(text, '')) AS DOUBLE) AS n FROM {source})"""


@query("I4_I5_model_scores", MODEL_SQL.format(key="doc_id", source="documents"))
def model_scores(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    return tidy(sentiment.score_sentiment(
        docs, "doc_id", "text", "model", load=load_length_model, labels=["POSITIVE", "NEGATIVE"]))


@query("I5_lexicon_branch_joined", f"""WITH {LEXICON_SQL},
{rule_score_ctes('lexicon')}
SELECT d.doc_id, d.source, sentiment_neg, sentiment_neu, sentiment_pos, sentiment_compound FROM documents d JOIN scores USING (doc_id)""")
def lexicon_branch(spark, sf):
    """The default branch of the dispatch, joined to its texts."""
    docs = documents(spark, sf).select("doc_id", "source", "text")
    return tidy(sentiment.with_sentiment(docs, "doc_id", "text", lexicon=learned_lexicon(spark, sf)).drop("text"))


# ---- feature tables ----------------------------------------------------------------


def clean_tables(spark, sf):
    """Review model with list categories, ready for the feature jobs."""
    r = with_text(reviews(spark, sf), spark, sf)
    b = business(spark, sf).withColumn("categories", categories.split_list(F.col("categories")))
    u = users(spark, sf)
    return r, b, u


CATS = "list_transform(string_split(categories, ','), lambda x: trim(x))"


@query("I6_review_features", sql(f"""SELECT {big('review_id')} AS review_id, {big('year(date)')} AS review_year, {big('month(date)')} AS review_month,
  {big('isodow(date) - 1')} AS review_day_of_week, {big('isodow(date) >= 6')} AS review_is_weekend, {big('greatest(useful, 0)')} AS target_helpful_votes,
  {r6('ln(1 + useful)')} AS target_helpful_log1p, {big("date_diff('day', date, (SELECT max(date) FROM review))")} AS review_age_days,
  {TEXT_STATS_SQL}, city, {big('business_stars')} AS business_stars, {big('coalesce(business_review_count, 0)')} AS business_review_count,
  {r6('coalesce(business_review_count, 0) / (len(' + "regexp_extract_all(t, '" + r'\S+' + "')" + ') + 1)')} AS business_review_density,
  {big(f'coalesce(len({CATS}), 0)')} AS business_category_count,
  {big(f"coalesce(len(list_filter({CATS}, lambda x: x IN (SELECT category FROM top))), 0)")} AS top_category_hits,
  {big('user_review_count')} AS user_review_count, {big('user_fans')} AS user_fans, {r6('user_average_stars')} AS user_average_stars
FROM (SELECT *, coalesce(text, '') AS t FROM review)""",
    "entry AS (SELECT unnest(" + CATS + ") AS category FROM review WHERE categories IS NOT NULL)",
    "top AS (SELECT category FROM entry GROUP BY category ORDER BY count(*) DESC, category LIMIT 15)").replace(
        "coalesce(len(list_filter(" + CATS + ", lambda x: x IN (SELECT category FROM top))), 0)",
        "coalesce(len(list_intersect(" + CATS + ", (SELECT list(category) FROM top))), 0)"))
def features(spark, sf):
    r, b, u = clean_tables(spark, sf)
    df = review_features.review_features(r, b, u, backend=None)
    flags = [c for c in df.columns if c.startswith("cat_")]
    hits = sum((F.col(c) for c in flags), F.lit(0))
    return tidy(df.withColumn("top_category_hits", hits).select(
        "review_id", "review_year", "review_month", "review_day_of_week", "review_is_weekend",
        "target_helpful_votes", "target_helpful_log1p", "review_age_days", "text_len_chars", "text_len_words",
        "avg_word_length", "caps_ratio", "exclaim_count", "question_count", "city", "business_stars",
        "business_review_count", "business_review_density", "business_category_count", "top_category_hits",
        "user_review_count", "user_fans", "user_average_stars"))


FLAG_NAMES_SQL = """flag AS (SELECT category, 'cat_' || slug || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS name FROM
  (SELECT category, slug, row_number() OVER (PARTITION BY slug ORDER BY n DESC, category) AS k FROM
    (SELECT category, n, regexp_replace(regexp_replace(lower(category), '[^a-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM
      (SELECT category, count(*) AS n FROM entry GROUP BY category ORDER BY count(*) DESC, category LIMIT 15))))"""


@query("I6_sentiment_and_category_flags", sql(
    "SELECT DISTINCT CAST(review_id AS BIGINT) AS review_id, name AS feature, 1.0::DOUBLE AS value FROM entry JOIN flag USING (category)\n"
    + "\n".join(
        f"UNION ALL SELECT CAST(review_id AS BIGINT), '{c}', CAST(coalesce({c}, 0) AS DOUBLE) FROM review LEFT JOIN scores ON doc_id = review_id"
        for c in sentiment.SCORES),
    LEXICON_SQL, rule_score_ctes("lexicon"),
    f"entry AS (SELECT review_id, unnest(list_filter({CATS}, lambda x: x <> '')) AS category FROM review WHERE categories IS NOT NULL)",
    FLAG_NAMES_SQL))
def sentiment_and_flags(spark, sf):
    """The sentiment columns and the 15 named category flags of the feature table, in long form."""
    r, b, u = clean_tables(spark, sf)
    df = review_features.review_features(r, b, u, lexicon=learned_lexicon(spark, sf))
    flags = [c for c in df.columns if c.startswith("cat_")]
    long = ranks.long_form(df, [*flags, *sentiment.SCORES], ["review_id"])
    is_flag = F.col("column").startswith("cat_")
    return tidy(long.where(~is_flag | (F.col("value") == 1)).select("review_id", F.col("column").alias("feature"), "value"))


@query("I7_master_table", sql(f"""SELECT {big('review_id')} AS review_id, city, state, {big('is_open')} AS is_open, {big('business_stars')} AS business_stars,
  {big('business_review_count')} AS business_review_count, {big('user_review_count')} AS user_review_count, {r6('user_average_stars')} AS user_average_stars,
  {big('user_fans')} AS user_fans, {big("length(coalesce(text, ''))")} AS review_char_len,
  {big("len(regexp_extract_all(coalesce(text, ''), '" + chr(92) + "S+'))")} AS review_word_len, {big('isodow(date) >= 6')} AS review_is_weekend, {big('week(date)')} AS review_weekofyear,
  {big('useful')} AS target_useful_votes, {big('useful > 0')} AS target_is_useful, {r6('useful + funny + cool')} AS total_votes,
  {r6('(useful + 1.0) / (useful + funny + cool + 6.0)')} AS useful_rate_smoothed, {big('r <= take')} AS is_eval
FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat('42:', CAST(review_id AS VARCHAR))), CAST(review_id AS VARCHAR)) AS r FROM labelled) JOIN quota USING (y)""",
    "labelled AS (SELECT *, CAST(useful > 0 AS INT) AS y FROM review)",
    """sizes AS (SELECT y, count(*) AS n, sum(count(*)) OVER () AS total FROM labelled GROUP BY y),
shares AS (SELECT y, n, total, (total - ceil(total * 0.2)) AS train, (total - ceil(total * 0.2)) * n / total AS s FROM sizes),
quota AS (SELECT y, n - (floor(s) + CASE WHEN row_number() OVER (ORDER BY round(s - floor(s), 9) DESC, y) <= train - sum(floor(s)) OVER () THEN 1 ELSE 0 END) AS take FROM shares)"""))
def master_table(spark, sf):
    r, b, u = clean_tables(spark, sf)
    df = master.split_master(r, b, u)
    return tidy(df.select(
        "review_id", "city", "state", "is_open", "business_stars", "business_review_count", "user_review_count",
        "user_average_stars", "user_fans", "review_char_len", "review_word_len", "review_is_weekend",
        "review_weekofyear", "target_useful_votes", "target_is_useful", "total_votes", "useful_rate_smoothed", "is_eval"))


# first spelling of names that differ only in case
NORMAL = f"list_filter({CATS}, lambda x, i: list_position(list_transform({CATS}, lambda y: lower(y)), lower(x)) = i)"


def _top_cat(source: str, k: int) -> str:
    """Top categories with their column names (a repeated slug gets a number)."""
    return (
        f"top_cat AS (SELECT v, 'cat_' || lower(v) || CASE WHEN row_number() OVER (PARTITION BY lower(v) ORDER BY n DESC, v) > 1 "
        f"THEN '_2' ELSE '' END AS name FROM (SELECT c AS v, count(*) AS n FROM {source} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {k}))"
    )


ONE_HOT_SQL = sql(
    """SELECT CAST(review_id AS BIGINT) AS review_id, 'city_' || regexp_replace(lower(city), '[^a-z0-9]', '_', 'g') AS feature FROM review WHERE city IN (SELECT v FROM top_city)
UNION ALL SELECT CAST(review_id AS BIGINT), 'state_' || lower(state) FROM review WHERE state IN (SELECT v FROM top_state)
UNION ALL SELECT CAST(review_id AS BIGINT), name FROM parts JOIN top_cat ON c = v""",
    f"parts AS (SELECT review_id, unnest({NORMAL}) AS c FROM review WHERE categories IS NOT NULL)",
    "top_city AS (SELECT city AS v FROM review WHERE city IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)",
    "top_state AS (SELECT state AS v FROM review WHERE state IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)",
    _top_cat("parts", 8))


@query("I8_I9_top_value_indicators", ONE_HOT_SQL)
def indicators(spark, sf):
    df = review_base(spark, sf, ["city"]).withColumn("categories", categories.split_list(F.col("categories")))
    top = encoders.fit_top_values(
        df, {"city": 10, "state": 3, "categories": 8}, ["categories"], {"categories": "cat"})
    wide = top.transform(df).select("review_id", *top.columns)
    return tidy(ranks.long_form(wide, top.columns, ["review_id"]).where("value = 1").select("review_id", F.col("column").alias("feature")))


def term_settings(max_features: int = 1000) -> tfidf.TermSettings:
    return tfidf.TermSettings(max_features, 5, (1, 2), STOPS)


TFIDF_SQL = f"""WITH words AS (SELECT doc_id, list_filter({TOKENS}, lambda x: x NOT IN ({STOP_SQL})) AS w FROM documents),
terms AS (SELECT doc_id, unnest(w) AS term FROM words UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words WHERE len(w) > 1),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
vocab AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term HAVING count(*) >= 5 ORDER BY total DESC, term LIMIT 1000),
raw AS (SELECT doc_id, term, tf, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS x FROM tf JOIN vocab USING (term)),
norm AS (SELECT doc_id, sqrt(sum(x * x)) AS z FROM raw GROUP BY doc_id)
"""


@query("I10_tfidf_weights", TFIDF_SQL + f"SELECT doc_id, term, {big('tf')} AS tf, {r6('x / z')} AS weight FROM raw JOIN norm USING (doc_id)")
def tfidf_weights(spark, sf):
    return tidy(tfidf.tfidf_long(documents(spark, sf), "doc_id", "text", term_settings()))


def vector_entries(vector: str):
    """The stored entries of a vector column, in order: a sparse one is not filled up."""
    return F.unwrap_udt(F.col(vector))["values"]


@query("I10_tfidf_vector_sums", TFIDF_SQL + f"""SELECT doc_id, {big('count(r.term)')} AS terms, (round(CAST(coalesce(sum(x / z), 0) AS DOUBLE), 5) + 0.0) AS weight_sum
FROM documents LEFT JOIN raw r USING (doc_id) LEFT JOIN norm USING (doc_id) GROUP BY doc_id""")
def tfidf_vectors(spark, sf):
    """Row-wise vectors of the fitted model (no shuffle of documents)."""
    docs = documents(spark, sf).select("doc_id", "text")
    model = tfidf.fit_tfidf(docs, "text", term_settings())
    values = vector_entries("tfidf")
    return tidy(model.transform(docs).select(
        "doc_id",
        F.size(F.filter(values, lambda v: v != 0)).alias("terms"),
        F.aggregate(values, F.lit(0.0), lambda a, v: a + v).alias("weight_sum")), 5)


@query("I12_numeric_groups", sql(f"SELECT {big('review_id')} AS review_id, {big('user_review_count')} AS user_review_count, {r6('user_average_stars')} AS user_average_stars, {big('user_fans')} AS user_fans FROM review"))
def numeric_groups(spark, sf):
    df = review_base(spark, sf, ["business", "users"])
    chosen = encoders.numeric_group(df, review_length=True, user_stats=True, business_stats=False)
    return tidy(df.select("review_id", *chosen))


@query("I13_median_impute", sql(f"""SELECT {big('review_id')} AS review_id, {r6('coalesce(business_stars, (SELECT median(business_stars) FROM review)) / (SELECT coalesce(nullif(max(abs(business_stars)), 0), 1) FROM review)')} AS business_stars,
  {r6('coalesce(is_open, (SELECT median(is_open) FROM review)) / (SELECT coalesce(nullif(max(abs(is_open)), 0), 1) FROM review)')} AS is_open FROM review"""))
def impute_and_scale(spark, sf):
    from pyspark.ml.feature import MaxAbsScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from kudoscope.models.text_models import median_fill

    names = ["business_stars", "is_open"]
    df = review_base(spark, sf, ["business"]).select("review_id", *names)
    filled = median_fill(df, names).transform(df)
    packed = VectorAssembler(inputCols=[f"_num_{c}" for c in names], outputCol="v").transform(filled)
    scaled = MaxAbsScaler(inputCol="v", outputCol="s").fit(packed).transform(packed)
    parts = vector_to_array("s")
    return tidy(scaled.select("review_id", *[parts[i].alias(c) for i, c in enumerate(names)]))


RECIPE_SQL = TFIDF_SQL + """, text_part AS (SELECT doc_id, count(r.term) AS n, coalesce(sum(x / z), 0) AS s
  FROM documents LEFT JOIN raw r USING (doc_id) LEFT JOIN norm USING (doc_id) GROUP BY doc_id),
number AS (SELECT doc_id, coalesce(n_chars, (SELECT median(n_chars) FROM documents)) / (SELECT max(n_chars) FROM documents)::DOUBLE AS v FROM documents)
"""


@query("I13_three_recipes", RECIPE_SQL + " UNION ALL ".join(
    f"SELECT doc_id, '{recipe}' AS recipe, {big(n)} AS entries, (round(CAST({s} AS DOUBLE), 5) + 0.0) AS total FROM text_part JOIN number USING (doc_id)"
    for recipe, n, s in (("text_tfidf", "n", "s"), ("text_tfidf_dense", "n", "s"), ("text_tfidf_plus_numeric", "n + CAST(v <> 0 AS INT)", "s + v"))))
def three_recipes(spark, sf):
    """Entries and sums of the vectors that each feature recipe makes."""
    from kudoscope.models import text_models

    docs = documents(spark, sf).select("doc_id", "text", "n_chars").withColumn("text", F.coalesce("text", F.lit("")))
    fitted = tfidf.fit_tfidf(docs, "text", term_settings())
    parts = []
    for recipe in text_models.RECIPES:
        rows = text_models.feature_model(docs, recipe, term_settings(), ["n_chars"], fitted).transform(docs)
        values = vector_entries("features")
        parts.append(rows.select(
            "doc_id", F.lit(recipe).alias("recipe"), F.size(F.filter(values, lambda v: v != 0)).alias("entries"),
            F.aggregate(values, F.lit(0.0), lambda a, v: a + v).alias("total")))
    return tidy(parts[0].unionByName(parts[1]).unionByName(parts[2]), 5)


def master_split(spark, sf):
    """Both sides of the split, cut from one kept master table."""
    r, b, u = clean_tables(spark, sf)
    # the passes of the split and the counts of hot keys read kept rows, not the joins again
    return master.sides_of(keep(master.split_master(keep(r), b, u)))


SPLIT_CTES = (
    "labelled AS (SELECT *, CAST(useful > 0 AS INT) AS y FROM review)",
    """sizes AS (SELECT y, count(*) AS n, sum(count(*)) OVER () AS total FROM labelled GROUP BY y),
shares AS (SELECT y, n, total, (total - ceil(total * 0.2)) AS train, (total - ceil(total * 0.2)) * n / total AS s FROM sizes),
quota AS (SELECT y, n - (floor(s) + CASE WHEN row_number() OVER (ORDER BY round(s - floor(s), 9) DESC, y) <= train - sum(floor(s)) OVER () THEN 1 ELSE 0 END) AS take FROM shares),
ordered AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat('42:', CAST(review_id AS VARCHAR))), CAST(review_id AS VARCHAR)) AS r FROM labelled),
train AS (SELECT o.* FROM ordered o JOIN quota USING (y) WHERE r > take),
held AS (SELECT o.* FROM ordered o JOIN quota USING (y) WHERE r <= take)""",
)

NUMERIC_SQL = {
    "stars": "stars", "funny": "funny", "cool": "cool", "business_stars": "business_stars",
    "business_review_count": "business_review_count", "is_open": "is_open", "user_review_count": "user_review_count",
    "user_fans": "user_fans", "review_char_len": "length(coalesce(text, ''))",
    "review_word_len": r"len(regexp_extract_all(coalesce(text, ''), '\S+'))",
    "review_is_weekend": "CAST(isodow(date) >= 6 AS INT)", "review_weekofyear": "week(date)",
}


@query("I14_feature_matrix", sql(
    "\nUNION ALL ".join(
        [f"SELECT CAST(review_id AS BIGINT) AS review_id, '{c}' AS feature, {r6(e)} AS value FROM held WHERE coalesce({e}, 0) <> 0" for c, e in NUMERIC_SQL.items()]
        + ["SELECT CAST(review_id AS BIGINT), 'city_' || regexp_replace(lower(city), '[^a-z0-9]', '_', 'g'), 1.0 FROM held WHERE city IN (SELECT v FROM top_city)",
           "SELECT CAST(review_id AS BIGINT), 'state_' || lower(state), 1.0 FROM held WHERE state IS NOT NULL",
           "SELECT CAST(review_id AS BIGINT), name, 1.0 FROM (SELECT review_id, unnest(" + NORMAL + ") AS c FROM held WHERE categories IS NOT NULL) JOIN top_cat ON c = v"]),
    *SPLIT_CTES,
    "top_city AS (SELECT city AS v FROM train WHERE city IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 12)",
    f"train_parts AS (SELECT unnest({NORMAL}) AS c FROM train WHERE categories IS NOT NULL)",
    _top_cat("train_parts", 30)))
def feature_matrix_rows(spark, sf):
    """Evaluation side of X in long form; top values come from the training side."""
    train, held = master_split(spark, sf)
    s = feature_matrix.FeatureSettings(top_cities=12)
    tables = feature_matrix.feature_tables(
        train.drop("user_id", "business_id", "user_average_stars"), held.drop("user_id", "business_id", "user_average_stars"), s)
    long = ranks.long_form(tables.evaluation, tables.features, ["review_id"])
    return tidy(long.where("value <> 0").select("review_id", F.col("column").alias("feature"), "value"))


@query("I15_checked_features", sql(f"SELECT {big('review_id')} AS review_id, {big('funny')} AS funny, {big('cool')} AS cool FROM review"))
def checked(spark, sf):
    df = reviews(spark, sf).select("review_id", "funny", "cool")
    checks.no_duplicate_columns(df, "reviews")
    checks.no_leakage(df.columns, feature_matrix.LEAKAGE)
    checks.has_columns(df, ["review_id"])
    checks.same_columns(df, df.select(*df.columns))
    return tidy(df)


@query("I16_phrases_tied_to_quality")
def phrases(spark, sf):
    docs = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return tidy(tfidf.rank_phrases(docs, "quality"))


@query("I16_planted_phrase", f"""SELECT 'plantedword' AS term, 'high' AS side, {big('25')} AS high, {big('25')} AS low""")
def planted_phrase(spark, sf):
    """A word that is frequent in the texts of one label only comes first."""
    docs = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    word = F.when(F.col("quality") == 1, F.repeat(F.lit(" plantedword"), F.lit(100))).otherwise("")
    found = keep(tfidf.rank_phrases(docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), word)), "quality"))
    first = found.where("side = 'high'").orderBy(F.desc("weight"), "term").limit(1)
    sizes = found.agg(F.struct(F.count_if(F.col("side") == "high").alias("high"), F.count_if(F.col("side") == "low").alias("low"))).scalar()
    return tidy(first.withColumn("s", sizes).select("term", "side", "s.high", "s.low"))
