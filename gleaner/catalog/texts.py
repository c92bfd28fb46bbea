"""Queries over the text stand-in reviews (R2) and the pages table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.catalog.registry import query, rounded
from gleaner.catalog.views import r2, table, with_views
from gleaner.functions import text as tx
from gleaner.operators import aggregates, filters, vocabulary
from gleaner.plans import jobs
from gleaner.session import scratch_path
from gleaner.sources import responses
from gleaner.sources.sinks import write_stage


def order():
    return [F.col("seq")]


# --- cleaning -----------------------------------------------------------------------------------

@query("flt_drop_null", with_views("r2", "SELECT seq, text, title FROM r2 WHERE text IS NOT NULL AND title IS NOT NULL"))
def flt_drop_null(spark, sf):
    return filters.drop_null(r2(spark, sf), ["text", "title"]).select("seq", "text", "title")


@query("flt_nonblank_text", with_views("r2", r"""
SELECT seq, text FROM r2 WHERE text IS NOT NULL AND trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''"""))
def flt_nonblank_text(spark, sf):
    return filters.nonblank_text(r2(spark, sf)).select("seq", "text")


@query("flt_time_window", with_views("r2", """
SELECT seq, submission_time FROM r2
WHERE submission_time >= TIMESTAMP '2023-01-01' AND submission_time <= TIMESTAMP '2026-04-23'"""))
def flt_time_window(spark, sf):
    return filters.time_window(r2(spark, sf)).select("seq", "submission_time")


@query("prj_audit_counts", with_views("r2", r"""
, f AS (
  SELECT review_id, coalesce(trim(regexp_replace(text, '\s+', ' ', 'g')) <> '', false) AS a,
         submission_time >= TIMESTAMP '2023-01-01' AND submission_time <= TIMESTAMP '2026-04-23' AS w FROM r2),
c AS (
  SELECT count(*) AS n0, count(*) FILTER (a) AS n1, count(*) FILTER (a) AS n2, count(*) FILTER (a AND w) AS n3,
         count(DISTINCT review_id) FILTER (a AND w) AS n4 FROM f)
SELECT 0 AS step_no, 'raw' AS step, n0 AS kept, CAST(0 AS BIGINT) AS removed FROM c
UNION ALL SELECT 1, 'text present', n1, n0 - n1 FROM c UNION ALL SELECT 2, 'date valid', n2, n1 - n2 FROM c
UNION ALL SELECT 3, 'in window', n3, n2 - n3 FROM c UNION ALL SELECT 4, 'unique id', n4, n3 - n4 FROM c"""))
def prj_audit_counts(spark, sf):
    return filters.cleaning_audit(r2(spark, sf))


@query("fn_normalise_ws", with_views("r2", r"""
SELECT seq, trim(regexp_replace(title, '\s+', ' ', 'g')) AS title,
       trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM r2"""))
def fn_normalise_ws(spark, sf):
    return r2(spark, sf).select("seq", *[tx.normalise_whitespace(F.col(c)).alias(c) for c in ("title", "text")])


@query("fn_full_text", with_views("r2", r"""
SELECT seq, trim(regexp_replace(concat(coalesce(title, ''), '. ', coalesce(text, '')), '\s+', ' ', 'g')) AS full_text
FROM r2"""))
def fn_full_text(spark, sf):
    return r2(spark, sf).select("seq", tx.full_text(F.col("title"), F.col("text")).alias("full_text"))


@query("fn_char_len", with_views("r2", "SELECT seq, CAST(length(text) AS INTEGER) AS chars FROM r2"))
def fn_char_len(spark, sf):
    return r2(spark, sf).select("seq", tx.char_length(F.col("text")).alias("chars"))


@query("fn_word_count", with_views("r2", r"""
SELECT seq, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS words FROM r2"""))
def fn_word_count(spark, sf):
    return r2(spark, sf).select("seq", tx.word_count(F.col("text")).alias("words"))


@query("fn_is_short", with_views("r2", "SELECT seq, length(text) < 20 AS is_short FROM r2"))
def fn_is_short(spark, sf):
    return r2(spark, sf).select("seq", tx.is_short(tx.char_length(F.col("text"))).alias("is_short"))


@query("fn_snippet", with_views("r2", """
SELECT seq, substr(text, 1, 180) || '...' AS always, substr(text, 1, 120) AS plain,
       CASE WHEN length(text) > 80 THEN concat(substr(text, 1, 80), '...') ELSE text END AS cut FROM r2"""))
def fn_snippet(spark, sf):
    text = F.col("text")
    return r2(spark, sf).select("seq", tx.snippet(text, 180).alias("always"),
                                tx.snippet(text, 120, "never").alias("plain"),
                                tx.snippet(text, 80, "when_cut").alias("cut"))


CLEAN_COLUMNS = ["review_id", "product_id", "category_keyword", "rating", "title", "text", "full_text",
                 "text_length_chars", "text_length_words", "is_short", "date", "year_month", "year",
                 "rating_sentiment"]


def cleaned(spark, sf):
    return jobs.clean(r2(spark, sf), order())


@query("pipe_clean", with_views("clean", f"SELECT {', '.join(CLEAN_COLUMNS)} FROM clean"))
def pipe_clean(spark, sf):
    return cleaned(spark, sf).select(*CLEAN_COLUMNS)


@query("pipe_clean_summary", with_views("clean", """
SELECT count(*) AS reviews, count(DISTINCT product_id) AS products,
       count(DISTINCT category_keyword) AS categories, CAST(min(submission_time) AS DATE) AS first_date,
       CAST(max(submission_time) AS DATE) AS last_date, round(avg(rating), 6) AS mean_rating,
       CAST(trunc(median(text_length_words)) AS INTEGER) AS median_words FROM clean"""))
def pipe_clean_summary(spark, sf):
    return rounded(jobs.clean_reports(cleaned(spark, sf))["summary"], "mean_rating")


WORDS_SQL = r"""
, w AS (SELECT seq, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS words
        FROM r2 WHERE text IS NOT NULL)"""


@query("agg_quantile_clip", with_views("r2", WORDS_SQL + """
SELECT seq, words FROM w WHERE words <= (SELECT quantile_cont(words, 0.99) FROM w)"""))
def agg_quantile_clip(spark, sf):
    return aggregates.quantile_clip(_words(spark, sf), "words", 0.99)


@query("agg_histogram", with_views("r2", WORDS_SQL + """
, k AS (SELECT words FROM w WHERE words <= (SELECT quantile_cont(words, 0.99) FROM w)),
m AS (SELECT min(words)::DOUBLE AS lo, (max(words) - min(words))::DOUBLE / 50 AS width FROM k),
b AS (SELECT CAST(least(floor((words - lo) / width), 49) AS INTEGER) AS bin, lo, width FROM k, m)
SELECT g.bin, round(m.lo + g.bin * m.width, 6) AS bin_left, round(m.lo + (g.bin + 1) * m.width, 6) AS bin_right, count(b.bin) AS n
FROM (SELECT CAST(unnest(range(50)) AS INTEGER) AS bin) g CROSS JOIN m LEFT JOIN b ON g.bin = b.bin GROUP BY g.bin, m.lo, m.width"""))
def agg_histogram(spark, sf):
    clipped = aggregates.quantile_clip(_words(spark, sf), "words", 0.99)
    return rounded(aggregates.histogram(clipped, "words"), "bin_left", "bin_right")


def _words(spark, sf):
    df = r2(spark, sf).select("seq", tx.word_count(F.col("text")).alias("words"))
    return df.filter(F.col("words").isNotNull())


# --- tokens -------------------------------------------------------------------------------------

@query("fn_lower", with_views("r2", "SELECT seq, lower(text) AS text FROM r2"))
def fn_lower(spark, sf):
    return r2(spark, sf).select("seq", F.lower("text").alias("text"))


@query("fn_strip_urls", r"""
SELECT page_id, regexp_replace(url, 'http\S+|www\.\S+', ' ', 'g') AS url,
       regexp_replace(html, 'http\S+|www\.\S+', ' ', 'g') AS html FROM pages""")
def fn_strip_urls(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", *[tx.strip_urls(F.col(c)).alias(c) for c in ("url", "html")])


@query("fn_alpha_only", with_views("r2", r"""
SELECT seq, regexp_replace(lower(text), '[^a-z\s]', ' ', 'g') AS text FROM r2"""))
def fn_alpha_only(spark, sf):
    return r2(spark, sf).select("seq", tx.alpha_only(F.lower("text")).alias("text"))


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_LOWER = r"regexp_replace(lower({0}), 'http\S+|www\.\S+', ' ', 'g')"
_SPLITS = [("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na")]


def words_sql(column: str) -> str:
    """All words of a text; the two-part words are split one by one."""
    out = _LOWER.format(column)
    for a, b in _SPLITS:
        out = rf"regexp_replace({out}, '\b{a}{b}\b', '{a} {b}', 'g')"
    return f"regexp_extract_all({out}, '[a-z]+')"


STOP_SQL = _quoted(K.stopword_set())


def lemma_sql(t: str) -> str:
    irregular = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in K.IRREGULAR_NOUNS.items())
    return f"""CASE WHEN {t} IN ({_quoted(K.IRREGULAR_NOUNS)}) THEN CASE {t} {irregular} END
      WHEN regexp_matches({t}, '[a-z][a-z]ies$') THEN concat(left({t}, length({t}) - 3), 'y')
      WHEN regexp_matches({t}, '(ss|x|z|ch|sh)es$') THEN left({t}, length({t}) - 2)
      WHEN regexp_matches({t}, '[a-z][a-z][^sui]s$') THEN left({t}, length({t}) - 1) ELSE {t} END"""


def kept_sql(tokens: str) -> str:
    return f"list_filter({tokens}, lambda t: length(t) > 2 AND t NOT IN ({STOP_SQL}))"


def tokens_sql(column: str) -> str:
    lemmas = f"list_transform({kept_sql(words_sql(column))}, lambda t: {lemma_sql('t')})"
    return f"coalesce({kept_sql(lemmas)}, [])"


@query("fn_tokenize", with_views("r2", f"""
SELECT seq, array_to_string(coalesce({words_sql('text')}, []), ' ') AS words FROM r2"""))
def fn_tokenize(spark, sf):
    return r2(spark, sf).select("seq", F.concat_ws(" ", tx.raw_tokens(F.col("text"))).alias("words"))


@query("fn_drop_short_stop", with_views("r2", f"""
SELECT seq, array_to_string(coalesce({kept_sql(words_sql('text'))}, []), ' ') AS words FROM r2"""))
def fn_drop_short_stop(spark, sf):
    kept = tx.drop_short_and_stop(tx.raw_tokens(F.col("text")), K.stopword_set())
    return r2(spark, sf).select("seq", F.concat_ws(" ", kept).alias("words"))


@query("fn_lemmatize", with_views("r2", f"""
SELECT seq, array_to_string(coalesce(list_transform({words_sql('text')}, lambda t: {lemma_sql('t')}), []), ' ') AS words
FROM r2"""))
def fn_lemmatize(spark, sf):
    return r2(spark, sf).select("seq", F.concat_ws(" ", tx.lemmatize(tx.raw_tokens(F.col("text")))).alias("words"))


@query("set_stopword_union", with_views("r2", f"""
, t AS (SELECT unnest({words_sql('text')}) AS word FROM r2)
SELECT word, count(*) AS n FROM t WHERE word IN ({STOP_SQL}) GROUP BY 1"""))
def set_stopword_union(spark, sf):
    from gleaner.sources.tables import stopword_table
    counts = r2(spark, sf).select(F.explode(tx.raw_tokens(F.col("text"))).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"))
    return counts.join(stopword_table(spark), "word").select("word", "n")


@query("tm_preprocess", with_views("r2", f"""
SELECT seq, CAST(len({tokens_sql('text')}) AS INTEGER) AS n_tokens, array_to_string({tokens_sql('text')}, ' ') AS tokens
FROM r2"""))
def tm_preprocess(spark, sf):
    docs = _docs(spark, sf)
    return docs.select("seq", F.size("tokens").alias("n_tokens"), F.concat_ws(" ", "tokens").alias("tokens"))


def _docs(spark, sf):
    return r2(spark, sf).select("seq", tx.topic_tokens(F.col("text")).alias("tokens"))


@query("flt_min_tokens", with_views("r2", f"""
, d AS (SELECT seq, {tokens_sql('text')} AS tokens FROM r2)
SELECT seq, CAST(len(tokens) AS INTEGER) AS n_tokens FROM d WHERE len(tokens) >= 5"""))
def flt_min_tokens(spark, sf):
    return filters.min_tokens(_docs(spark, sf)).select("seq", F.size("tokens").alias("n_tokens"))


DOCS_SQL = f""", d AS (SELECT seq, {tokens_sql('text')} AS tokens FROM r2),
docs AS (SELECT * FROM d WHERE len(tokens) >= 5),
words AS (SELECT seq, unnest(tokens) AS term FROM docs),
vocab AS (
  SELECT term, count(DISTINCT seq) AS df, count(*) AS tf FROM words GROUP BY 1
  HAVING count(DISTINCT seq) >= 10 AND count(DISTINCT seq) <= 0.5 * (SELECT count(*) FROM docs)
)"""


def corpus(spark, sf):
    return filters.with_tokens(r2(spark, sf).select("seq", "text"), tx.topic_tokens(F.col("text"))).drop("text")


@query("agg_doc_freq", with_views("r2", DOCS_SQL + " SELECT term, df, tf FROM vocab"))
def agg_doc_freq(spark, sf):
    return vocabulary.vocabulary(corpus(spark, sf))


@query("agg_bow", with_views("r2", DOCS_SQL + """
SELECT seq, term, count(*) AS n FROM words WHERE term IN (SELECT term FROM vocab) GROUP BY 1, 2"""))
def agg_bow(spark, sf):
    docs = write_stage(corpus(spark, sf), scratch_path(spark, "corpus"))  # read for the vocabulary and for the bags
    return vocabulary.bag_of_words(docs, vocabulary.vocabulary(docs), "seq")


@query("agg_corpus_sizes", with_views("r2", DOCS_SQL + """
SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM vocab) AS terms"""))
def agg_corpus_sizes(spark, sf):
    docs = corpus(spark, sf)
    return vocabulary.corpus_sizes(docs, vocabulary.vocabulary(docs))


def _lexicon_sql() -> str:
    rows = ["SELECT term, term AS word, 0 AS rule FROM terms"]
    for i, (suffix, tail) in enumerate(K.NOUN_SUFFIX_RULES, start=1):
        rows.append(f"SELECT term, concat(left(term, length(term) - {len(suffix)}), '{tail}'), {i} FROM terms "
                    f"WHERE ends_with(term, '{suffix}')")
    return f"""
, d AS (SELECT seq, coalesce({kept_sql(words_sql('text'))}, []) AS tokens FROM r2),
terms AS (SELECT DISTINCT unnest(tokens) AS term FROM d),
tried AS ({' UNION ALL '.join(rows)}),
lemmas AS (
  SELECT term, word AS lemma FROM tried WHERE word IN (SELECT term FROM terms)
  QUALIFY row_number() OVER (PARTITION BY term ORDER BY length(word), rule) = 1),
placed AS (
  SELECT d.seq, i.pos, d.tokens[i.pos] AS term FROM d, LATERAL (SELECT unnest(range(1, len(d.tokens) + 1)) AS pos) i)
SELECT seq, coalesce(string_agg(lemma, ' ' ORDER BY pos), '') AS words
FROM d LEFT JOIN (SELECT p.seq, p.pos, l.lemma FROM placed p JOIN lemmas l USING (term)) x USING (seq) GROUP BY 1"""


@query("fn_lemmatize_lexicon", with_views("r2", _lexicon_sql()))
def fn_lemmatize_lexicon(spark, sf):
    # The corpus vocabulary is the lexicon: a plural is reduced when its singular also occurs.
    kept = tx.drop_short_and_stop(tx.raw_tokens(F.col("text")), K.stopword_set())
    # Read for the lexicon, for the distinct words and for the texts.
    docs = write_stage(r2(spark, sf).select("seq", kept.alias("tokens")), scratch_path(spark, "tokens"))
    lexicon = docs.select(F.explode("tokens").alias("word")).distinct()
    return vocabulary.lemmatize_with_lexicon(docs, lexicon, "seq").select(
        "seq", F.concat_ws(" ", "tokens").alias("words"))


@query("lim_head", "SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 3")
def lim_head(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return responses.first_rows(d, [F.desc("n_chars"), F.col("doc_id")], 3)
