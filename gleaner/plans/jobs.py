"""The stages of a review study, from landed responses to topic and event tables.

Stages that feed several results take a ``store`` path: the intermediate table is written once as
Parquet and read back, which survives lost executors and keeps plans short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from gleaner import constants as K, schemas
from gleaner.functions import dates, scores, text as tx
from gleaner.operators import (aggregates, coherence, explorer, filters, joins, metrics, ranking, sampling,
                               scoring, temporal, topics, vocabulary)
from gleaner.sources import requests, responses, sinks, tables
from gleaner.sources.csv_files import INGEST_ORDER


def discover(search_responses: DataFrame, order: list | None = None) -> dict[str, DataFrame]:
    """Search responses -> products with reviews, and the per-keyword summary.

    A product found twice keeps its first hit by keyword order, page and position.
    """
    order = order or [F.col(c) for c in ("kw_pos", "page", "position")]
    keep = [c for c in ("kw_pos", "page") if c in search_responses.columns]
    hits = responses.flatten_search(search_responses, keep)
    products = filters.min_reviews(ranking.keep_first(hits, ["product_uid"], order), 1)
    products = products.select(*schemas.PRODUCTS.fieldNames())
    return {"products": products, "summary": aggregates.product_summary(products),
            "totals": aggregates.total_reviews(products)}


def harvest(products: DataFrame, done: DataFrame, max_reviews: int = K.MAX_REVIEWS_PER_PRODUCT,
            min_reviews: int = K.MIN_REVIEWS_PER_PRODUCT,
            request_size: int = K.REVIEW_REQUEST_SIZE) -> DataFrame:
    """Requests still to be made: enough reviews, not harvested yet, paged up to the cap."""
    todo = joins.not_yet_harvested(filters.min_reviews(products, min_reviews), done)
    return requests.harvest_plan(todo, max_reviews, request_size)


def clean(raw: DataFrame, order: list | None = None, start: str = K.WINDOW_START,
          end: str = K.WINDOW_END) -> DataFrame:
    """Raw reviews -> clean reviews: one scan, one shuffle (the duplicate check).

    Blank texts, unreadable dates and rows outside the window go first, so an early copy outside
    the window does not hide a later one inside it.
    """
    order = order or [F.col(c) for c in INGEST_ORDER if c in raw.columns]
    df = filters.nonblank_text(raw)
    if dict(raw.dtypes)["submission_time"] == "string":
        df = df.withColumn("submission_time", dates.parse_timestamp(F.col("submission_time")))
    df = filters.time_window(filters.drop_null(df, ["submission_time"]), start=start, end=end)
    df = ranking.keep_first(df, ["review_id"], order)
    df = df.withColumns({"text": tx.normalise_whitespace(F.col("text")),
                         "title": tx.normalise_whitespace(F.col("title"))})
    ts = F.col("submission_time")
    df = df.withColumns({
        "full_text": tx.full_text(F.col("title"), F.col("text")),
        "text_length_chars": tx.char_length(F.col("text")),
        "text_length_words": tx.word_count(F.col("text")),
        "is_short": tx.is_short(tx.char_length(F.col("text"))),
        "date": dates.day(ts), "year_month": dates.month_label(ts), "year": dates.year(ts),
        "rating_sentiment": scores.rating_sentiment(F.col("rating"))})
    return df.drop(*INGEST_ORDER)


def clean_reports(cleaned: DataFrame) -> dict[str, DataFrame]:
    """Summary and the data of the five overview figures; pass the clean table as written to disk."""
    return {
        "summary": aggregates.summary(cleaned),
        "rating_share": aggregates.value_shares(cleaned, "rating"),
        "sentiment_share": aggregates.value_shares(cleaned, "rating_sentiment"),
        "per_year": aggregates.value_counts(cleaned, "year"),
        "per_month": aggregates.monthly_volume(cleaned),
        "per_category": aggregates.value_counts(cleaned, "category_keyword"),
        "length_histogram": aggregates.histogram(
            aggregates.quantile_clip(cleaned, "text_length_words"), "text_length_words"),
        "category_rating": aggregates.category_rating(cleaned),
    }


Scorer = Callable[[DataFrame], DataFrame]


def model_scorer(loader, batch_size: int = K.SCORE_BATCH, max_tokens: int = K.MAX_MODEL_TOKENS,
                 text: str = "full_text") -> Scorer:
    return lambda df: scoring.score_with_model(df, text, loader, batch_size, max_tokens)


def validate(cleaned: DataFrame, scorer: Scorer, key: Column | None = None,
             per_star: int = K.SAMPLES_PER_STAR, store: str | None = None) -> dict[str, DataFrame]:
    """Score a stratified sample and compare with the star ratings."""
    key = F.col("review_id") if key is None else key
    usable = filters.drop_null(cleaned, ["rating", "full_text", "rating_sentiment"])
    usable = usable.withColumn("rating", scores.to_int(F.col("rating")))
    sample = scorer(sampling.stratified_sample(usable, key, per_star))
    if store:
        sample = sinks.write_stage(sample, store)
    counts = metrics.label_counts(sample)
    return {
        "sample": sample, "rating_counts": aggregates.value_counts(sample, "rating"),
        "accuracy": metrics.accuracy(counts), "f1": metrics.f1_scores(counts),
        "report": metrics.class_report(counts), "confusion": metrics.confusion(counts),
        "rating_by_pred": aggregates.crosstab_pct(sample, "rating", "pred", K.LABELS),
        "monthly": temporal.monthly_truth(sample),
    }


def score_full(cleaned: DataFrame, scorer: Scorer) -> DataFrame:
    """Score every review that has text. No shuffle."""
    return scorer(filters.drop_null(cleaned, ["full_text"]))


def topic_corpus(scored: DataFrame, stopwords: list[str] | None = None, lexicon: DataFrame | None = None,
                 key: str = "review_id", threshold: float = K.CONFIDENCE_THRESHOLD,
                 min_tokens: int = K.MIN_TOKENS) -> DataFrame:
    """Confident negatives with their tokens, short documents left out."""
    negatives = filters.confident_negative(scored, threshold)
    words = K.stopword_set() if stopwords is None else stopwords
    if lexicon is None:
        return filters.with_tokens(negatives, tx.topic_tokens(F.col("full_text"), words), min_tokens)
    plain = negatives.select(key, tx.topic_tokens(F.col("full_text"), words, lemmatise=False).alias("tokens"))
    lemmas = vocabulary.lemmatize_with_lexicon(plain, lexicon, key).withColumnRenamed("tokens", "_lemmas")
    docs = filters.with_tokens(negatives.join(lemmas, key), tx.drop_short_and_stop(F.col("_lemmas"), words), min_tokens)
    return docs.drop("_lemmas")


def select_topics(docs: DataFrame, k_values=K.K_VALUES, min_df: int = K.VOCAB_MIN_DF,
                  passes: int = K.LDA_PASSES, key: str = "review_id", max_terms: int | None = None) -> dict:
    """Fit every K on one persisted corpus, score each by c_v and keep the best.

    The vocabulary list is fetched for the vectoriser, and the driver holds a weight for each of its
    terms and topics; ``max_terms`` keeps the most frequent ones where these are too many.
    """
    spark = docs.sparkSession
    terms = [r["term"] for r in vocabulary.vocabulary(docs, min_df=min_df, max_terms=max_terms).select("term").collect()]
    term_table = tables.term_table(spark, terms)
    corpus = vocabulary.vectorise(docs, terms).select(key, "tokens", "features").persist()
    try:
        fits = {}
        for k in k_values:
            model = topics.fit_lda(corpus, k, passes=passes)
            phi = topics.topic_terms(model, term_table)
            mean = coherence.coherence_cv(corpus, phi).agg(F.avg("coherence")).first()[0]
            fits[k] = (model, phi, mean)
    finally:
        corpus.unpersist()
    sweep = tables.local_table(spark, [(k, f[2]) for k, f in fits.items()], schemas.struct(k="int", coherence="double"))
    chosen = topics.best_k(sweep).first()["k"]
    return {"sweep": sweep, "k": chosen, "model": fits[chosen][0], "phi": fits[chosen][1],
            "terms": term_table, "term_list": terms}


def assign_topics(docs: DataFrame, fitted: dict) -> DataFrame:
    """Adds theta, dominant topic, its probability and the number of vocabulary words."""
    vectors = vocabulary.vectorise(docs, fitted["term_list"])
    return topics.dominant_topic(topics.doc_topics(fitted["model"], vectors)).withColumn(
        "doc_len", F.aggregate(F.unwrap_udt("features")["values"], F.lit(0.0), lambda a, x: a + x)).drop("features")


EXEMPLAR_COLUMNS = ["dominant_topic", "topic_size", "rank", "topic_probability", "review_id", "category_keyword",
                    "rating", "snippet"]


def topic_reports(assigned: DataFrame, fitted: dict, titles: dict[int, str] | None = None,
                  tie_break: list | None = None) -> dict[str, DataFrame]:
    """Output table, top words, trends, categories and exemplars."""
    k = fitted["k"]
    return {
        "topics_out": sinks.project_existing(assigned, schemas.TOPICS_OUT),
        "top_words": topics.top_terms(fitted["phi"]).withColumn(
            "topic_name", scores.topic_name(F.col("topic"), titles or {}, default=True)),
        "quarterly": temporal.topic_quarter_pct(assigned, k),
        "by_category": aggregates.crosstab_pct(assigned, "category_keyword", "dominant_topic", list(range(k))),
        "exemplars": sinks.project_existing(
            ranking.topic_exemplars(assigned, tie_break or [F.col("review_id")]), EXEMPLAR_COLUMNS),
    }


def temporal_reports(scored: DataFrame, events: DataFrame, docs: DataFrame | None = None,
                     quarters: list[str] | None = None, topics_: int | None = None,
                     titles: dict[int, str] | None = None) -> dict[str, DataFrame]:
    """Monthly sentiment, events in range, event impact, category trend, topic volume.

    ``quarters`` and the number of topics are read from the tables unless given.
    """
    monthly = temporal.monthly_sentiment(scored)
    cells = temporal.category_quarter(scored)
    out = {
        "monthly": monthly, "events": filters.events_in_range(events, monthly),
        "event_impact": temporal.event_impact(scored, events), "category_quarter": cells,
        "category_order": temporal.pivot_threshold(cells),
    }
    if quarters is None:
        quarters = sorted(r["quarter"] for r in cells.select("quarter").distinct().collect())
    out["category_wide"] = temporal.category_quarter_wide(cells, quarters)
    if docs is not None:
        if topics_ is None:
            topics_ = (docs.agg(F.max("dominant_topic")).first()[0] or 0) + 1
        out["topic_month"] = temporal.topic_month(docs, int(topics_), titles)
    return out


def explorer_tables(assigned: DataFrame, fitted: dict, labels: DataFrame | None = None,
                    digits: int | None = None) -> dict[str, DataFrame]:
    """Everything a topic explorer shows, from the model fitted before (no second training). ``digits``
    rounds relevance before ranking."""
    mass = explorer.topic_mass_of(assigned)
    order = explorer.topic_order(mass)
    freq = explorer.term_frequency(fitted["phi"], mass)
    out = {
        "topics": order, "term_frequency": explorer.overall_frequency(freq),
        "saliency": explorer.saliency(freq), "relevance": explorer.relevance(freq, digits=digits),
        "token_table": explorer.token_table(freq, K.TOKEN_MIN_COUNT),
        "distance": explorer.topic_distance(fitted["phi"], fitted["k"]),
    }
    if labels is not None:
        out["cards"] = explorer.topic_cards(order, labels)
    return out
