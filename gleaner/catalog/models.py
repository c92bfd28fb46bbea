"""Scoring, topic-model and explorer queries.

Explorer and coherence operators run on two models: one fitted by LDA (rows only), and one whose
topics are the four languages of the documents, which SQL can recompute.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gleaner import constants as K, schemas
from gleaner.catalog.registry import query, r6, rounded
from gleaner.catalog.reviews import METRIC_SQL, REPORT_SQL
from gleaner.catalog.texts import DOCS_SQL, cleaned, corpus, tokens_sql, words_sql
from gleaner.catalog.views import classes_sql, r2, table, with_views
from gleaner.functions import special, text as tx
from gleaner.operators import coherence, explorer, filters, scoring, topic_em, topics, vocabulary
from gleaner.plans import jobs
from gleaner.session import scratch_path
from gleaner.sources.sinks import write_stage
from gleaner.sources.tables import local_table

CLASS_SQL = ("CAST(pred_idx AS INTEGER) AS pred_idx, pred, round(prob_negative, 6) AS prob_negative, "
             "round(prob_neutral, 6) AS prob_neutral, round(prob_positive, 6) AS prob_positive, "
             "round(confidence, 6) AS confidence, round(score, 6) + 0.0 AS score")
CLASS_COLUMNS = ["pred_idx", "pred", "prob_negative", "prob_neutral", "prob_positive", "confidence", "score"]


def _class_columns(df, *keys):
    return rounded(df.select(*keys, *CLASS_COLUMNS), *CLASS_COLUMNS[2:])


# --- scoring ------------------------------------------------------------------------------------

def letter_model():
    """Stand-in for a network: logits from the share of three letters in the whole text."""
    def loader():
        def predict(texts, max_tokens):
            return [[t.count(c) * 30.0 / max(len(t), 1) for c in "eao"] for t in texts]
        return predict
    return loader  # a closure, so it reaches the workers by value


def _letters_sql(name: str, source: str, column: str) -> str:
    z = ", ".join(
        f"(length(coalesce({column}, '')) - length(replace(coalesce({column}, ''), '{c}', ''))) * 30.0::DOUBLE "
        f"/ greatest(length(coalesce({column}, '')), 1) AS z{i}" for i, c in enumerate("eao"))
    return f"{name}_z AS (SELECT *, {z} FROM {source}),\n{classes_sql(name, name + '_z')}"


@query("ml_batch_score", with_views("r2", ", " + _letters_sql("s", "r2", "text") + f" SELECT seq, {CLASS_SQL} FROM s"))
def ml_batch_score(spark, sf):
    docs = r2(spark, sf).select("seq", "text")
    return _class_columns(scoring.score_with_model(docs, "text", letter_model()), "seq")


@query("pipe_score_full", with_views("clean", ", " + _letters_sql("s", "clean", "full_text")
                                     + f" SELECT review_id, rating_sentiment, {CLASS_SQL} FROM s"))
def pipe_score_full(spark, sf):
    scored = jobs.score_full(cleaned(spark, sf), jobs.model_scorer(letter_model()))
    return _class_columns(scored, "review_id", "rating_sentiment")


SAMPLE_SQL = """, sampled AS (
  SELECT * REPLACE (CAST(trunc(rating) AS INTEGER) AS rating) FROM clean
  QUALIFY row_number() OVER (PARTITION BY rating ORDER BY md5(concat('42:', review_id))) <= 1000),
""" + _letters_sql("r1s", "sampled", "full_text")


@query("ml_validate", with_views("clean", SAMPLE_SQL + """
SELECT review_id, rating, rating_sentiment, pred, round(confidence, 6) AS confidence FROM r1s"""))
def ml_validate(spark, sf):
    out = jobs.validate(cleaned(spark, sf), jobs.model_scorer(letter_model(), K.SAMPLE_BATCH))
    return rounded(out["sample"].select("review_id", "rating", "rating_sentiment", "pred", "confidence"), "confidence")


@query("pipe_validate", with_views("clean", SAMPLE_SQL + METRIC_SQL + REPORT_SQL))
def pipe_validate(spark, sf):
    out = jobs.validate(cleaned(spark, sf), jobs.model_scorer(letter_model(), K.SAMPLE_BATCH),
                        store=scratch_path(spark, "sample"))
    return rounded(out["report"], "precision", "recall", "f1")


@query("ml_text_classifier", with_views("clean", """
SELECT review_id, CASE category_keyword WHEN 'en' THEN 'positive' WHEN 'de' THEN 'negative' ELSE 'neutral' END AS label, true AS sums_to_one,
       true AS pred_is_largest, true AS score_is_difference, true AS right_on_held_out FROM clean"""))
def ml_text_classifier(spark, sf):
    """What must hold of the trained classifier's output for every review, as its values are its own. The classes are groups of
    languages, which texts tell: of the rows held out at least 0.9 must be right, where always the largest class is right in 0.6."""
    lang = F.col("category_keyword")
    label = F.when(lang == "en", K.LABELS[2]).when(lang == "de", K.LABELS[0]).otherwise(K.LABELS[1])
    docs = write_stage(cleaned(spark, sf).select("review_id", label.alias("label"), tx.raw_tokens(F.col("full_text")).alias("_tokens")),
                       scratch_path(spark, "labelled"))
    train, held_out = scoring.split_held_out(docs, F.col("review_id"))
    model = scoring.train_text_classifier(train, label="label")
    right = scoring.classify(held_out, model).agg(F.avg((F.col("pred") == F.col("label")).cast("int"))).scalar()
    out = scoring.classify(docs, model)
    p = [F.col(f"prob_{c}") for c in K.LABELS]
    of_pred = F.when(F.col("pred") == K.LABELS[0], p[0]).when(F.col("pred") == K.LABELS[1], p[1]).otherwise(p[2])
    return out.select(
        "review_id", "label", (right >= 0.9).alias("right_on_held_out"), (F.abs(p[0] + p[1] + p[2] - 1) < 1e-9).alias("sums_to_one"),
        ((of_pred == F.greatest(*p)) & (F.col("confidence") == F.greatest(*p))).alias("pred_is_largest"),
        (F.abs(F.col("score") - (p[2] - p[0])) < 1e-12).alias("score_is_difference"))


def _lexicon(spark, sf):
    """Term weights from the quality labels: which class of documents holds the term more often."""
    terms = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        "quality", F.explode(F.array_distinct(tx.raw_tokens(F.col("text")))).alias("term"))
    n = terms.groupBy("term").agg(F.count_if(F.col("quality") == 1).alias("p"), F.count_if(F.col("quality") == 0).alias("n"))
    return n.select("term", (F.col("n") > F.col("p")).cast("int").alias("w_negative"),
                    (F.col("n") == F.col("p")).cast("int").alias("w_neutral"),
                    (F.col("p") > F.col("n")).cast("int").alias("w_positive"))


@query("ml_lexicon_score", with_views("r2", f"""
, lt AS (SELECT DISTINCT doc_id, quality, unnest({words_sql('text')}) AS term FROM documents JOIN labels USING (doc_id)),
lc AS (SELECT term, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n FROM lt GROUP BY 1),
w AS (SELECT seq, unnest({words_sql('text')}) AS term FROM r2),
sums AS (
  SELECT seq, count(*) AS total, count(*) FILTER (lc.n > lc.p) AS a, count(*) FILTER (lc.n = lc.p) AS b,
         count(*) FILTER (lc.p > lc.n) AS c FROM w LEFT JOIN lc USING (term) GROUP BY 1),
z AS (
  SELECT r2.seq, coalesce(a * 4.0::DOUBLE / total, 0) AS z0, coalesce(b * 4.0::DOUBLE / total, 0) AS z1,
         coalesce(c * 4.0::DOUBLE / total, 0) AS z2 FROM r2 LEFT JOIN sums USING (seq)),
{classes_sql('s', 'z')}
SELECT seq, {CLASS_SQL} FROM s"""))
def ml_lexicon_score(spark, sf):
    docs = r2(spark, sf).select("seq", "text")
    return _class_columns(scoring.lexicon_score(docs, "seq", "text", _lexicon(spark, sf), scale=4.0), "seq")


_HEAD = [[1.0 if 21 * i <= d < 21 * (i + 1) else 0.0 for d in range(64)] for i in range(3)]


@query("ml_linear_head", f"""
WITH z AS (SELECT vec_id, """ + ", ".join(
    f"list_sum(list_transform(embedding[{21 * i + 1}:{21 * i + 21}], lambda x: CAST(x AS DOUBLE))) AS z{i}"
    for i in range(3)) + f""" FROM embeddings),
{classes_sql('s', 'z')}
SELECT vec_id, {CLASS_SQL} FROM s""")
def ml_linear_head(spark, sf):
    return _class_columns(scoring.linear_head(table(spark, sf, "embeddings"), "embedding", _HEAD), "vec_id")


@query("join_predictions", with_views("r2", ", " + _letters_sql("s", "r2", "text") + """
SELECT s.seq, s.text, s.pred FROM s"""))
def join_predictions(spark, sf):
    # Predictions come back on their own rows: text and class must still belong together.
    docs = r2(spark, sf).select("seq", "text").repartition("seq")
    return scoring.score_with_model(docs, "text", letter_model()).select("seq", "text", "pred")


# --- tables of a topic model that SQL can recompute ----------------------------------------------

LANGS = ["de", "en", "es", "fr"]
LANG_SQL = f"""
, d AS (
  SELECT seq, list_position(['de', 'en', 'es', 'fr'], category_keyword) - 1 AS lang, {tokens_sql('text')} AS tokens FROM r2),
docs AS (SELECT * FROM d WHERE len(tokens) >= 5),
words AS (SELECT lang, unnest(tokens) AS term FROM docs),
phi AS (
  SELECT CAST(lang AS INTEGER) AS topic, term, count(*) / sum(count(*)) OVER (PARTITION BY lang) AS weight
  FROM words GROUP BY 1, 2, lang),
lens AS (SELECT lang, sum(len(tokens)) AS n FROM docs GROUP BY 1),
tops AS (SELECT unnest(range(4)) AS topic),
mass0 AS (
  SELECT CAST(topic AS INTEGER) AS topic, sum(n * CASE WHEN lang = topic THEN 0.7::DOUBLE ELSE 0.1::DOUBLE END) AS mass
  FROM lens, tops GROUP BY 1),
mass AS (SELECT topic, mass, mass / sum(mass) OVER () AS proportion FROM mass0),
freq AS (SELECT phi.topic, term, weight, proportion, weight * mass AS topic_freq FROM phi JOIN mass USING (topic)),
terms0 AS (SELECT term, sum(topic_freq) AS term_freq, sum(weight) AS w FROM freq GROUP BY 1),
terms AS (SELECT *, term_freq / sum(term_freq) OVER () AS p_term FROM terms0)"""


def lang_docs(spark, sf):
    lang = (F.array_position(F.array(*[F.lit(x) for x in LANGS]), F.col("category_keyword")) - 1).cast("int")
    docs = filters.with_tokens(r2(spark, sf).select("seq", lang.alias("lang"), "text"), tx.topic_tokens(F.col("text")))
    theta = F.array(*[F.when(F.col("lang") == t, 0.7).otherwise(0.1) for t in range(4)])
    return docs.withColumns({"theta": theta, "doc_len": F.size("tokens")})


def _stored_lang_docs(spark, sf):
    """The documents as stored, for queries that read them more than once."""
    return write_stage(lang_docs(spark, sf).select("seq", "lang", "tokens", "theta", "doc_len"), scratch_path(spark, "languages"))


def lang_phi(docs):
    counts = docs.select("lang", F.explode("tokens").alias("term")).groupBy("lang", "term").agg(
        F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    return counts.join(totals, "lang").select(
        F.col("lang").alias("topic"), "term", (F.col("n") / F.col("total")).alias("weight"))


def lang_freq(spark, sf):
    """Read several times by each query, so the documents' terms are counted once and stored."""
    docs = _stored_lang_docs(spark, sf)
    phi = write_stage(lang_phi(docs), scratch_path(spark, "language-terms"))
    return explorer.term_frequency(phi, explorer.topic_mass_of(docs))


@query("win_top_terms", with_views("r2", LANG_SQL + """
SELECT topic, term, CAST(row_number() OVER w AS INTEGER) AS rank, round(weight, 6) AS weight FROM phi
WINDOW w AS (PARTITION BY topic ORDER BY weight DESC, term) QUALIFY row_number() OVER w <= 15"""))
def win_top_terms(spark, sf):
    phi = lang_phi(lang_docs(spark, sf)).withColumn("rank", F.lit(0))
    return rounded(topics.top_terms(phi), "weight").select("topic", "term", "rank", "weight")


@query("tm_topic_proportion", with_views("r2", LANG_SQL + """
SELECT topic, round(mass, 6) AS mass, round(proportion, 6) AS proportion FROM mass"""))
def tm_topic_proportion(spark, sf):
    docs = lang_docs(spark, sf)
    mass = explorer.topic_mass(topics.theta_long(docs, "seq"), docs.select("seq", "doc_len"), "seq")
    return rounded(mass.withColumn("topic", F.col("topic").cast("int")), "mass", "proportion")


ORDER_SQL = "CAST(row_number() OVER (ORDER BY proportion DESC, topic) AS INTEGER) AS display"


@query("tm_topic_order", with_views("r2", LANG_SQL + f"""
SELECT {ORDER_SQL}, topic, round(proportion, 6) AS proportion FROM mass"""))
def tm_topic_order(spark, sf):
    return rounded(explorer.topic_order(explorer.topic_mass_of(lang_docs(spark, sf))), "proportion")


def _cards(spark, sf):
    from gleaner.sources.tables import topic_label_table
    order = explorer.topic_order(explorer.topic_mass_of(lang_docs(spark, sf)))
    titles = {0: "German", 1: "English", 2: "Spanish"}
    return explorer.topic_cards(order, topic_label_table(spark, titles, {1: "most documents"}))


CARDS_BODY = f"""
SELECT {ORDER_SQL}, topic, CASE topic WHEN 0 THEN 'German' WHEN 1 THEN 'English' WHEN 2 THEN 'Spanish' END AS title,
       CASE topic WHEN 1 THEN 'most documents' END AS description FROM mass"""


@query("tm_topic_cards", with_views("r2", LANG_SQL + CARDS_BODY))
def tm_topic_cards(spark, sf):
    return _cards(spark, sf)


@query("join_topic_order", with_views("r2", LANG_SQL + CARDS_BODY.replace(" FROM mass", ", topic - 1 AS below FROM mass")))
def join_topic_order(spark, sf):
    return _cards(spark, sf).withColumn("below", F.col("topic") - 1)


@query("tm_term_frequency", with_views("r2", LANG_SQL + """
SELECT topic, term, round(topic_freq, 6) AS topic_freq, round(term_freq, 6) AS term_freq,
       round(p_term, 9) AS p_term FROM freq JOIN terms USING (term)"""))
def tm_term_frequency(spark, sf):
    freq = lang_freq(spark, sf)
    both = freq.join(explorer.overall_frequency(freq), "term")
    return rounded(both, "topic_freq", "term_freq").select(
        "topic", "term", "topic_freq", "term_freq", F.round("p_term", 9).alias("p_term"))


@query("tm_saliency", with_views("r2", LANG_SQL + """
, s AS (
  SELECT term, any_value(p_term) * sum(weight / w * ln(weight / w / proportion)) AS saliency
  FROM freq JOIN terms USING (term) GROUP BY 1)
SELECT term, round(saliency, 6) + 0.0 AS saliency FROM s ORDER BY s.saliency DESC, term LIMIT 30"""))
def tm_saliency(spark, sf):
    return rounded(explorer.saliency(lang_freq(spark, sf)).select("term", "saliency"), "saliency")


@query("tm_relevance", with_views("r2", LANG_SQL + """
, grid AS (SELECT unnest(range(0, 101)) / 100 AS lam),
rel AS (
  SELECT topic, lam, term, floor((lam * ln(weight) + (1 - lam) * ln(weight / p_term)) * 1e9 + 0.5) / 1e9 AS r
  FROM freq JOIN terms USING (term), grid)
SELECT topic, round(lam, 2) AS "lambda", term, CAST(row_number() OVER w AS INTEGER) AS rank,
       round(r, 6) + 0.0 AS relevance
FROM rel WINDOW w AS (PARTITION BY topic, lam ORDER BY r DESC, term) QUALIFY row_number() OVER w <= 30"""))
def tm_relevance(spark, sf):
    top = explorer.relevance(lang_freq(spark, sf), digits=9)
    return rounded(top, "relevance").select(
        "topic", F.round("lambda", 2).alias("lambda"), "term", "rank", "relevance")


@query("tm_token_table", with_views("r2", LANG_SQL + """
SELECT topic, term, round(topic_freq / term_freq, 6) AS share FROM freq JOIN terms USING (term)
WHERE topic_freq >= 0.5"""))
def tm_token_table(spark, sf):
    return rounded(explorer.token_table(lang_freq(spark, sf), K.TOKEN_MIN_COUNT), "share")


@query("tm_topic_distance", with_views("r2", LANG_SQL + """
, pairs AS (SELECT a.topic AS topic_a, b.topic AS topic_b FROM tops a, tops b WHERE a.topic < b.topic),
side AS (
  SELECT topic_a, topic_b, t.term, coalesce(p.weight, 0) AS p, coalesce(q.weight, 0) AS q
  FROM pairs CROSS JOIN (SELECT DISTINCT term FROM phi) t
  LEFT JOIN phi p ON p.topic = topic_a AND p.term = t.term LEFT JOIN phi q ON q.topic = topic_b AND q.term = t.term)
SELECT CAST(topic_a AS INTEGER) AS topic_a, CAST(topic_b AS INTEGER) AS topic_b,
       round(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END
               + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS js_divergence
FROM side GROUP BY 1, 2"""))
def tm_topic_distance(spark, sf):
    return rounded(explorer.topic_distance(lang_phi(lang_docs(spark, sf)), 4), "js_divergence")


@query("tm_topic_map", with_views("r2", LANG_SQL + """
, pairs AS (SELECT a.topic AS topic_a, b.topic AS topic_b FROM tops a, tops b),
side AS (
  SELECT topic_a, topic_b, t.term, coalesce(p.weight, 0) AS p, coalesce(q.weight, 0) AS q
  FROM pairs CROSS JOIN (SELECT DISTINCT term FROM phi) t
  LEFT JOIN phi p ON p.topic = topic_a AND p.term = t.term LEFT JOIN phi q ON q.topic = topic_b AND q.term = t.term),
sq AS (
  SELECT topic_a, topic_b, power(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END
               + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2, 2) AS d FROM side GROUP BY 1, 2)
SELECT CAST(topic_a AS INTEGER) AS topic_a, CAST(topic_b AS INTEGER) AS topic_b,
       round(-0.5 * (d - avg(d) OVER (PARTITION BY topic_a) - avg(d) OVER (PARTITION BY topic_b) + avg(d) OVER ()), 6) + 0.0 AS gram,
       true AS leading_axes FROM sq"""))
def tm_topic_map(spark, sf):
    """The inner products that the map is made from, and whether its axes are their two leading eigenvectors."""
    docs = lang_docs(spark, sf)
    phi, k = lang_phi(docs), 4
    distance = explorer.topic_distance(phi, k)
    points = explorer.topic_map(distance, explorer.topic_order(explorer.topic_mass_of(docs)), k).orderBy("topic").toPandas()
    gram = explorer.gram_matrix(explorer.distance_matrix(distance, k))
    axes = points[["x", "y"]].to_numpy()
    values = (axes * axes).sum(axis=0)
    leading = bool(np.allclose(gram @ axes, axes * values, atol=1e-9) and values[0] >= values[1] > 0 and np.trace(gram) - values.sum() <= 2 * values[1])
    rows = [(a, b, float(gram[a, b]), leading) for a in range(k) for b in range(k)]
    return rounded(local_table(spark, rows, schemas.struct(topic_a="int", topic_b="int", gram="double", leading_axes="boolean")), "gram")


@query("tm_coherence_cv", with_views("r2", LANG_SQL + """
, top AS (
  SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM phi
  QUALIFY rank <= 20),
pos AS (SELECT seq, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS p, greatest(0, len(tokens) - 110) AS lastw FROM docs),
hit AS (
  SELECT DISTINCT topic, rank, seq, unnest(range(greatest(0, p - 109), least(p, lastw) + 1)) AS win
  FROM pos JOIN top USING (term)),
total AS (SELECT sum(greatest(1, len(tokens) - 109)) AS n FROM docs),
single AS (SELECT topic, rank, count(*) AS c FROM hit GROUP BY 1, 2),
joint AS (
  SELECT a.topic, a.rank AS i, b.rank AS j, count(*) AS c
  FROM hit a JOIN hit b ON a.topic = b.topic AND a.seq = b.seq AND a.win = b.win GROUP BY 1, 2, 3),
m AS (
  SELECT a.topic, a.rank AS i, b.rank AS j,
         ln((coalesce(c.c, 0) / n + 1e-12) / (a.c / n * (b.c / n))) / -ln(coalesce(c.c, 0) / n + 1e-12) AS v
  FROM single a JOIN single b ON a.topic = b.topic CROSS JOIN total
  LEFT JOIN joint c ON c.topic = a.topic AND c.i = a.rank AND c.j = b.rank),
s AS (SELECT topic, j, sum(v) AS v FROM m GROUP BY 1, 2),
cos AS (
  SELECT m.topic, m.i, sum(m.v * s.v) / sqrt(sum(m.v * m.v) * sum(s.v * s.v)) AS c
  FROM m JOIN s ON m.topic = s.topic AND m.j = s.j GROUP BY 1, 2)
SELECT topic, round(avg(c), 6) AS coherence FROM cos GROUP BY 1"""))
def tm_coherence_cv(spark, sf):
    docs = _stored_lang_docs(spark, sf)
    phi = lang_phi(docs).withColumn("rank", F.lit(0))
    return rounded(coherence.coherence_cv(docs, phi), "coherence")


@query("tm_dominant_topic", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS dominant_topic,
       round(CAST(list_max(embedding) AS DOUBLE), 6) AS topic_probability FROM embeddings""")
def tm_dominant_topic(spark, sf):
    out = topics.dominant_topic(table(spark, sf, "embeddings"), "embedding")
    return out.select("vec_id", "dominant_topic", r6(F.col("topic_probability").cast("double")).alias("topic_probability"))


@query("agg_best_k", """
WITH s AS (SELECT label AS k, round(avg(CAST(embedding[1] AS DOUBLE)), 2) AS coherence FROM embeddings GROUP BY 1)
SELECT k, coherence FROM s ORDER BY coherence DESC, k LIMIT 1""")
def agg_best_k(spark, sf):
    first = F.get("embedding", F.lit(0)).cast("double")
    sweep = table(spark, sf, "embeddings").groupBy(F.col("label").alias("k")).agg(
        F.round(F.avg(first), 2).alias("coherence"))
    return topics.best_k(sweep)


# --- LDA ----------------------------------------------------------------------------------------

_FITTED: dict = {}

#: Confident negatives of the letter model with their tokens, and the vocabulary of these.
NEGATIVES_SQL = ", " + _letters_sql("s", "clean", "full_text") + f""",
d AS (SELECT *, {tokens_sql('full_text')} AS tokens FROM s WHERE pred = 'negative' AND confidence >= 0.8),
docs AS (SELECT * FROM d WHERE len(tokens) >= 5),
words AS (SELECT review_id, unnest(tokens) AS term FROM docs),
vocab AS (
  SELECT term FROM words GROUP BY 1
  HAVING count(DISTINCT review_id) >= 10 AND count(DISTINCT review_id) <= 0.5 * (SELECT count(*) FROM docs)),
ks AS (SELECT unnest([5, 7, 10, 12]) AS k)"""


def fitted(spark, sf):
    """The sweep over K on the confident negatives, once per session and folder, shared by the queries below."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FITTED:
        scored = jobs.score_full(cleaned(spark, sf), jobs.model_scorer(letter_model()))
        docs = write_stage(jobs.topic_corpus(scored), scratch_path(spark, "corpus"))
        model = jobs.select_topics(docs)
        _FITTED[key] = (docs, model, write_stage(jobs.assign_topics(docs, model), scratch_path(spark, "assigned")))
    return _FITTED[key]


@query("tm_fit_lda", with_views("clean", NEGATIVES_SQL + """
SELECT CAST(unnest(range(5)) AS INTEGER) AS topic, (SELECT count(*) FROM vocab) AS n_terms, true AS ranks_dense,
       true AS sums_to_one, true AS beats_single_topic"""))
def tm_fit_lda(spark, sf):
    docs, model, _ = fitted(spark, sf)
    vectors = vocabulary.vectorise(docs, model["term_list"]).select("features").persist()
    fit = topics.fit_lda(vectors, 5)
    # The bound of a trained model is above the likelihood of one topic that holds the overall shares of the words.
    words = vocabulary.vocabulary(docs)
    single = words.agg(F.sum(F.col("tf") * F.log(F.col("tf") / words.agg(F.sum("tf")).scalar()))).first()[0]
    better = topics.log_likelihood(fit, vectors) > single
    vectors.unpersist()
    n = F.count_distinct("term")
    return topics.topic_terms(fit, model["terms"]).groupBy("topic").agg(
        n.alias("n_terms"), ((F.count_distinct("rank") == n) & (F.max("rank") - F.min("rank") + 1 == n)).alias("ranks_dense"),
        (F.abs(F.sum("weight") - 1) < 1e-9).alias("sums_to_one"), F.lit(better).alias("beats_single_topic"))


@query("tm_select_k", with_views("clean", NEGATIVES_SQL + """
SELECT CAST(k AS INTEGER) AS k, true AS in_range, true AS best_is_chosen FROM ks"""))
def tm_select_k(spark, sf):
    model = fitted(spark, sf)[1]
    best = model["sweep"].agg(F.max("coherence")).scalar()
    chosen = model["sweep"].filter(F.col("k") == model["k"]).agg(F.max("coherence")).scalar()
    return model["sweep"].select("k", F.col("coherence").between(-1, 1).alias("in_range"),
                                 (F.abs(best - chosen) < 1e-12).alias("best_is_chosen"))


@query("tm_top_words", with_views("clean", NEGATIVES_SQL + """
SELECT CAST(unnest(range(1, 16)) AS INTEGER) AS rank, true AS one_per_topic, true AS in_vocabulary, true AS falling"""))
def tm_top_words(spark, sf):
    docs, model, _ = fitted(spark, sf)
    top = topics.top_terms(model["phi"])
    known = vocabulary.vocabulary(docs).select("term", F.lit(True).alias("known"))
    before = top.select("topic", (F.col("rank") + 1).alias("rank"), F.col("weight").alias("before"))
    return top.join(known, "term", "left").join(before, ["topic", "rank"], "left").groupBy("rank").agg(
        ((F.count(F.lit(1)) == model["k"]) & (F.count_distinct("topic") == model["k"])).alias("one_per_topic"),
        F.every(F.coalesce("known", F.lit(False))).alias("in_vocabulary"),
        F.every(F.coalesce(F.col("weight") <= F.col("before"), F.lit(True))).alias("falling"))


@query("tm_doc_topics", with_views("clean", NEGATIVES_SQL + """
SELECT review_id, true AS every_topic, true AS sums_to_one, true AS within_bounds FROM docs"""))
def tm_doc_topics(spark, sf):
    _, model, assigned = fitted(spark, sf)
    return topics.theta_long(assigned, "review_id").groupBy("review_id").agg(
        (F.count_distinct("topic") == model["k"]).alias("every_topic"), (F.abs(F.sum("p") - 1) < 1e-9).alias("sums_to_one"),
        F.every(F.col("p").between(0, 1)).alias("within_bounds"))


@query("pipe_topics", with_views("clean", NEGATIVES_SQL + """
SELECT 'topics_out' AS report, category_keyword AS key, CAST(count(*) AS DOUBLE) AS value FROM docs GROUP BY 2
UNION ALL SELECT 'quarterly', CAST(CAST(date_trunc('quarter', submission_time) AS DATE) AS VARCHAR), count(*) FROM docs GROUP BY 2
UNION ALL SELECT 'by_category', category_keyword, 100 FROM docs GROUP BY 2
UNION ALL SELECT 'top_words', 'per topic', 15
UNION ALL SELECT 'topic_sizes', 'all', count(*) FROM docs"""))
def pipe_topics(spark, sf):
    """Sums over the reports that do not depend on where the topics fall."""
    _, model, assigned = fitted(spark, sf)
    out, k = jobs.topic_reports(assigned, model), model["k"]
    line = lambda df, report, key, value: df.select(
        F.lit(report).alias("report"), key.alias("key"), value.cast("double").alias("value"))
    topic_sum = sum((F.coalesce(F.col(f"`{t}`"), F.lit(0.0)) for t in range(1, k)), F.coalesce(F.col("`0`"), F.lit(0.0)))
    sizes = out["exemplars"].select("dominant_topic", "topic_size").distinct().agg(F.sum("topic_size").alias("n"))
    return line(out["topics_out"].groupBy("category_keyword").count(), "topics_out", F.col("category_keyword"), F.col("count")).unionByName(
        line(out["quarterly"].groupBy("quarter").agg(F.sum("n").alias("n")), "quarterly", F.col("quarter").cast("string"), F.col("n"))).unionByName(
        line(out["by_category"], "by_category", F.col("category_keyword"), F.round(topic_sum, 6))).unionByName(
        line(out["top_words"].agg((F.count(F.lit(1)) / k).alias("n")), "top_words", F.lit("per topic"), F.col("n"))).unionByName(
        line(sizes, "topic_sizes", F.lit("all"), F.col("n")))


# --- the topic model with learned priors ---------------------------------------------------------

def _em_step_sql() -> str:
    """One pass from a fixed start: three topics, one round of the topic shares, then both halves of the update."""
    psi, psi1 = special.digamma_sql, special.trigamma_sql
    fit = "3 * (lgamma(s + rho * sd) - sum(lgamma(greatest(eta + rho * d, 1e-300)))) + sum((eta + rho * d) * spread)"
    steps = ", ".join(str(float(r)) for r in topic_em.STEPS)
    return DOCS_SQL + f""",
bow AS (SELECT seq, term, count(*) AS n FROM words JOIN vocab USING (term) GROUP BY 1, 2),
start AS (SELECT term, t, 0.9::DOUBLE + (ascii(md5(concat(term, t))) % 16) / 80.0::DOUBLE AS lam FROM vocab, (SELECT unnest([0, 1, 2]) AS t)),
tot AS (SELECT t, {psi('sum(lam)')} AS shift FROM start GROUP BY 1),
beta AS (SELECT term, t, {psi('lam')} - shift AS lb, exp({psi('lam')} - shift) AS b FROM start JOIN tot USING (t)),
nd AS (SELECT seq, 1.0::DOUBLE / 3 + sum(n) / 3.0::DOUBLE AS g FROM bow GROUP BY 1),
th0 AS (SELECT seq, exp({psi('g')} - {psi('3 * g')}) AS e FROM nd),
norm0 AS (SELECT seq, term, any_value(n) AS n, sum(e * b) AS norm FROM bow JOIN beta USING (term) JOIN th0 USING (seq) GROUP BY 1, 2),
gamma AS (
  SELECT seq, t, 1.0::DOUBLE / 3 + any_value(e) * sum(n / norm * b) AS g
  FROM norm0 JOIN beta USING (term) JOIN th0 USING (seq) GROUP BY 1, 2),
th1 AS (SELECT seq, t, exp({psi('g')} - {psi('gs')}) AS e FROM (SELECT *, sum(g) OVER (PARTITION BY seq) AS gs FROM gamma)),
norm1 AS (SELECT seq, term, any_value(n) AS n, sum(e * b) AS norm FROM bow JOIN beta USING (term) JOIN th1 USING (seq, t) GROUP BY 1, 2),
stat AS (
  SELECT term, t, sum(n / norm * e * b) AS stat FROM norm1 JOIN beta USING (term) JOIN th1 USING (seq, t) GROUP BY 1, 2),
prior AS (SELECT term, 1.0::DOUBLE / 3 AS eta, sum(lb) AS spread FROM beta GROUP BY 1),
size AS (SELECT sum(eta) AS s FROM prior),
grad AS (
  SELECT term, eta, spread, s, 3 * ({psi('s')} - {psi('eta')}) + spread AS g, -3 * {psi1('eta')} AS q, 3 * {psi1('s')} AS c FROM prior, size),
share AS (SELECT sum(g / q) / (1 / any_value(c) + sum(1 / q)) AS shared FROM grad),
newton AS (SELECT term, eta, spread, s, -(g - shared) / q AS d FROM grad, share),
sums AS (SELECT sum(d) AS sd FROM newton),
tried AS (
  SELECT rho, min(eta + rho * d) AS least, {fit} AS fit
  FROM newton, sums, (SELECT unnest([{steps}]) AS rho) GROUP BY rho, s, sd),
taken AS (SELECT max(rho) AS rho FROM tried WHERE least > 0 AND fit >= (SELECT fit FROM tried WHERE rho = 0))
SELECT term, CAST(t AS INTEGER) AS topic, round(eta + rho * d + stat, 6) AS weight, round(eta + rho * d, 6) AS prior
FROM newton JOIN stat USING (term), taken"""


@query("tm_em_step", with_views("r2", _em_step_sql()))
def tm_em_step(spark, sf):
    docs = write_stage(corpus(spark, sf), scratch_path(spark, "em-docs"))
    start = F.array(*[0.9 + (F.ascii(F.md5(F.concat("term", F.lit(str(t))))) % 16) / 80.0 for t in range(3)])
    vocab = vocabulary.vocabulary(docs).select("term", F.lit(1.0 / 3).alias("eta"), start.alias("lambda"))
    fit = topic_em.fit(docs, vocab, 3, key="seq", passes=1, iterations=1, tolerance=0.0, learn_alpha=False, settle=0, start=vocab)
    rows = fit.model.select("term", "eta", F.posexplode("lambda").alias("topic", "weight"))
    return rows.select("term", "topic", r6("weight").alias("weight"), r6("eta").alias("prior"))


@query("tm_fit_learned", with_views("r2", DOCS_SQL + """
SELECT CAST(unnest(range(8)) AS INTEGER) AS topic, (SELECT count(*) FROM vocab) AS n_terms, (SELECT count(*) FROM docs) AS n_docs,
       true AS bound_rises, true AS beats_single_topic, true AS priors_learned, true AS one_language"""))
def tm_fit_learned(spark, sf):
    """Eight topics over documents in four languages. Only a trained model puts each language into topics of its own and
    explains the words better than their overall shares do."""
    docs = write_stage(corpus(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "lang"), "seq"),
                       scratch_path(spark, "em-docs"))
    vocab = write_stage(vocabulary.vocabulary(docs), scratch_path(spark, "em-vocabulary"))
    fit = topic_em.fit(docs, vocab, 8, key="seq", passes=10)
    total = vocab.agg(F.sum("tf")).scalar()
    single = vocab.agg(F.sum(F.col("tf") * F.log(F.col("tf") / total))).first()[0] or 0.0
    spread = fit.model.agg((F.max("eta") - F.min("eta")).alias("d")).first()["d"] or 0.0
    rises = all(b >= a - 1e-7 * abs(a) for a, b in zip(fit.bounds, fit.bounds[1:]))
    at = topics.dominant_topic(fit.theta.join(docs.select("seq", "lang"), "seq")).groupBy("dominant_topic", "lang").agg(F.count(F.lit(1)).alias("n"))
    pure = at.groupBy("dominant_topic").agg(F.max("n").alias("most"), F.sum("n").alias("n")).agg(F.sum("most") / F.sum("n")).scalar()
    sizes = fit.phi.groupBy("topic").agg(F.count(F.lit(1)).alias("n_terms"))
    return sizes.select("topic", "n_terms", fit.theta.agg(F.count(F.lit(1))).scalar().alias("n_docs"), F.lit(rises).alias("bound_rises"),
                        F.lit(bool(fit.bounds[-1] > single)).alias("beats_single_topic"), F.lit(bool(spread > 0.01)).alias("priors_learned"),
                        (pure > 0.9).alias("one_language"))


EXPLORER_SQL = f"""
, s AS (
  SELECT term, any_value(p_term) * sum(weight / w * ln(weight / w / proportion)) AS saliency
  FROM freq JOIN terms USING (term) GROUP BY 1),
best AS (SELECT * FROM s ORDER BY saliency DESC, term LIMIT 30),
grid AS (SELECT unnest(range(0, 101)) / 100 AS lam),
rel AS (
  SELECT topic, lam, term, floor((lam * ln(weight) + (1 - lam) * ln(weight / p_term)) * 1e9 + 0.5) / 1e9 AS r
  FROM freq JOIN terms USING (term), grid),
ranked AS (SELECT * FROM rel QUALIFY row_number() OVER (PARTITION BY topic, lam ORDER BY r DESC, term) <= 30),
pairs AS (SELECT a.topic AS topic_a, b.topic AS topic_b FROM tops a, tops b WHERE a.topic < b.topic),
side AS (
  SELECT topic_a, topic_b, t.term, coalesce(p.weight, 0) AS p, coalesce(q.weight, 0) AS q
  FROM pairs CROSS JOIN (SELECT DISTINCT term FROM phi) t
  LEFT JOIN phi p ON p.topic = topic_a AND p.term = t.term LEFT JOIN phi q ON q.topic = topic_b AND q.term = t.term),
ordered AS (SELECT {ORDER_SQL}, topic, proportion FROM mass)
SELECT 'topics' AS report, CAST(topic AS INTEGER) AS topic, CAST(NULL AS VARCHAR) AS term, CAST(display AS DOUBLE) AS at,
       round(proportion, 6) AS value FROM ordered
UNION ALL SELECT 'term_frequency', NULL, term, NULL, round(term_freq, 6) FROM terms
UNION ALL SELECT 'saliency', NULL, term, NULL, round(saliency, 6) + 0.0 FROM best
UNION ALL SELECT 'relevance', topic, term, round(lam, 2), round(r, 6) + 0.0 FROM ranked
UNION ALL SELECT 'token_table', topic, term, NULL, round(topic_freq / term_freq, 6) FROM freq JOIN terms USING (term) WHERE topic_freq >= 0.5
UNION ALL SELECT 'distance', CAST(topic_a AS INTEGER), NULL, topic_b,
       round(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END
               + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) FROM side GROUP BY topic_a, topic_b"""


def _explorer_lines(tables_):
    """All six tables of an explorer as (report, topic, term, at, value)."""
    shape = {"topics": ("topic", None, "display", "proportion"), "term_frequency": (None, "term", None, "term_freq"),
             "saliency": (None, "term", None, "saliency"), "relevance": ("topic", "term", "lambda", "relevance"),
             "token_table": ("topic", "term", None, "share"), "distance": ("topic_a", None, "topic_b", "js_divergence")}
    out = None
    for name, columns in shape.items():
        topic, term, at, value = (F.lit(None) if c is None else F.col(c) for c in columns)
        part = tables_[name].select(F.lit(name).alias("report"), topic.cast("int").alias("topic"), term.cast("string").alias("term"),
                                    F.round(at.cast("double"), 2).alias("at"), r6(value).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def _lang_explorer(spark, sf):
    docs = _stored_lang_docs(spark, sf)
    phi = write_stage(lang_phi(docs), scratch_path(spark, "language-terms"))
    return jobs.explorer_tables(docs, {"phi": phi, "k": 4}, digits=9)


@query("pipe_explorer", with_views("r2", LANG_SQL + EXPLORER_SQL))
def pipe_explorer(spark, sf):
    return _explorer_lines(_lang_explorer(spark, sf))


@query("tm_explorer_export", with_views("r2", LANG_SQL + EXPLORER_SQL))
def tm_explorer_export(spark, sf):
    """The export, read back."""
    path, out = scratch_path(spark, "explorer"), _lang_explorer(spark, sf)
    explorer.write_explorer(out, path)
    return _explorer_lines({name: spark.read.schema(df.schema).json(f"{path}/{name}") for name, df in out.items()})
