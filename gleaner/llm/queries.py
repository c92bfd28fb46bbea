"""The registered queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.llm import (
    audit, decontamination, extraction, language, mixing, neighbours, packing, quality, runs, sharding, simhash,
    surrogates, toxicity)
from gleaner.llm.common import table
from gleaner.llm.registry import query

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP2 = rf"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM items WHERE len(w) > 0)),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM docs, lengths WHERE len(w) >= n)),
hits AS (SELECT r, p, n, item_id FROM grams JOIN windows USING (n, phrase)),
covered AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS q FROM hits) GROUP BY r),
matched AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
, needs AS (
  SELECT row_number() OVER () AS i, item_id, len(list_distinct(w)) AS n, greatest(40, 2 * len(w)) AS span, list_distinct(w) AS d
  FROM (SELECT DISTINCT item_id, w FROM items WHERE len(w) > 0)),
item_words AS (SELECT i, unnest(d) AS word FROM needs),
places AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs),
held AS (SELECT DISTINCT r, word FROM places),
pairs AS (
  SELECT r, i FROM held JOIN item_words USING (word) GROUP BY r, i
  HAVING count(*) >= (SELECT ceil(0.8 * n - 1e-9) FROM needs WHERE needs.i = item_words.i)),
close_by AS (
  SELECT r, i, span, n, word, p FROM pairs JOIN needs USING (i) JOIN item_words USING (i) JOIN places USING (r, word)),
stretches AS (
  SELECT a.r, a.i, a.p, a.n, count(DISTINCT b.word) AS found FROM close_by a
  JOIN close_by b ON a.r = b.r AND a.i = b.i AND b.p >= a.p AND b.p < a.p + a.span GROUP BY a.r, a.i, a.p, a.n),
near_items AS (
  SELECT r, count(DISTINCT item_id) AS n_near_items FROM stretches JOIN needs USING (i) WHERE found >= ceil(0.8 * stretches.n - 1e-9) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM docs LEFT JOIN covered USING (r) LEFT JOIN matched USING (r) LEFT JOIN near_items USING (r)"""


@query("op1_neighbours")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


@query("op2_decontamination", _OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents", "doc_id", "text"),
                                          table(spark, sf_dir, "benchmark", "item_id", "text"), near=True)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
                        F.size("near_ids").cast("bigint").alias("n_near_items"))


@query("op3_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", "taken", "source")


@query("op4_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    found = extraction.extract(pages, extraction.fit(pages))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))


@query("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents", "doc_id", "text"), 40).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op6_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(table(spark, sf_dir, "documents", "doc_id", "text", "lang")).select(
        "doc_id", "held_out", "lang_pred", "score", "languages")


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(table(spark, sf_dir, "documents", "doc_id", "text"),
                               table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")))


@query("op8_surrogates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(table(spark, sf_dir, "documents", "doc_id", "text"), key="gleaner")


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents", "doc_id", "text"),
                                table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")))


def _with_repeats(text: Column, doc_id: Column) -> Column:
    """The op11 contract's texts: of each tenth id (by checksum) the words from some place on repeat a phrase."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        phrase = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(phrase, F.lit(1), (n - a).cast("int"))), " ")

    # The one-element array holds the words, so that they are split once.
    words = F.array(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    made = F.get(F.transform(words, lambda w: F.when(F.size(w) > 0, repeated(w))), F.lit(0))
    return F.when(h % 10 == 0, F.coalesce(made, text)).otherwise(text)


@query("op11_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = runs.find(docs.select("doc_id", _with_repeats(F.col("text"), F.col("doc_id")).alias("text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = runs.strongest(F.col("runs"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


_OP12 = r"""
WITH labelled AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN coalesce(min(t.doc_id) OVER (PARTITION BY text) < t.doc_id, false) THEN 'E' ELSE '' END AS fails
  FROM texts t LEFT JOIN labelled l ON t.doc_id = l.doc_id),
counts AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS b
  FROM orders, (SELECT unnest(generate_series(1, 5)) AS step)),
judged AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails = f AS alone, contains(fails, f) AS here,
         fails <> translate(fails, b, '') AS earlier
  FROM counts, steps),
summed AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN NOT here AND NOT earlier THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN here AND NOT earlier THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN here AND earlier THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN here AND NOT earlier THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN here AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed"""


@query("op12_audit", _OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents", "doc_id", "text", "lang"),
                       table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


@query("op13_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenised(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    own = pieces.select("doc_id", "piece", "start", "length", "row", F.crc32("ids").alias("ids_crc32"))
    return packing.placed(own, ["doc_id", "piece", "start", "length", "ids_crc32"])
