"""Queries over the numeric stand-in reviews (R1, R1S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import constants as K, schemas
from gleaner.catalog.registry import query, r6, rounded
from gleaner.catalog.texts import words_sql
from gleaner.catalog.views import events, hits, order_columns, r1, r1s, table, with_views
from gleaner.functions import dates, scores
from gleaner.functions.text import raw_tokens
from gleaner.operators import aggregates, filters, joins, metrics, ranking, sampling, selection, temporal
from gleaner.session import scratch_path
from gleaner.sources import requests, sinks
from gleaner.sources.tables import keyword_table, label_table, local_table


# --- scans, sinks, projections ------------------------------------------------------------------

@query("src_pruned_scan", with_views("r1", "SELECT product_id FROM r1"))
def src_pruned_scan(spark, sf):
    return r1(spark, sf).select("product_id")


@query("src_page_slice", with_views("r1", """
SELECT product_id, review_id, submission_time, l_orderkey, l_linenumber, position FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY submission_time DESC, l_orderkey,
    l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
    l_linestatus) AS INTEGER) AS position FROM r1) WHERE position > 8 AND position <= 16"""))
def src_page_slice(spark, sf):
    order = [F.desc("submission_time"), *order_columns()]
    return requests.page_slice(r1(spark, sf), order, 8, 8).select(
        "product_id", "review_id", "submission_time", "l_orderkey", "l_linenumber", "position")


@query("snk_project_existing", with_views("r1", """
SELECT review_id, product_id, product_name, category_keyword, rating, submission_time, dominant_topic
FROM r1"""))
def snk_project_existing(spark, sf):
    return sinks.project_existing(r1(spark, sf, rating=True, product=True), schemas.TOPICS_OUT)


@query("prj_cast_int", with_views("r1", """
SELECT l_orderkey, l_linenumber, CAST(trunc(rating) AS INTEGER) AS rating,
       CAST(trunc(l_quantity / 8) AS INTEGER) AS eighths FROM r1"""))
def prj_cast_int(spark, sf):
    return r1(spark, sf, rating=True).select(
        "l_orderkey", "l_linenumber", scores.to_int(F.col("rating")).alias("rating"),
        scores.to_int(F.col("l_quantity") / 8).alias("eighths"))


@query("flt_confident_negative", with_views("r1s", """
SELECT l_orderkey, l_linenumber, l_partkey, pred, round(confidence, 6) AS confidence FROM r1s
WHERE pred = 'negative' AND confidence >= 0.8"""))
def flt_confident_negative(spark, sf):
    return filters.confident_negative(r1s(spark, sf)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "pred", r6("confidence").alias("confidence"))


@query("flt_min_group", with_views("r1", """
SELECT CAST(date_trunc('month', submission_time) AS DATE) AS year_month, count(rating) AS n FROM r1
GROUP BY 1 HAVING count(rating) >= 600"""))
def flt_min_group(spark, sf):
    month = dates.month_start(F.col("submission_time")).alias("year_month")
    return (r1(spark, sf, rating=True).groupBy(month).agg(F.count("rating").alias("n"))
            .filter(F.col("n") >= 600))


# --- row functions ------------------------------------------------------------------------------

@query("fn_parse_ts", with_views("r1", """
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_linenumber <> 7 THEN submission_time END AS parsed FROM r1"""))
def fn_parse_ts(spark, sf):
    # Line 7 carries text that is no date: it must turn into null.
    df = r1(spark, sf)
    iso = F.when(F.col("l_linenumber") != 7, F.concat(
        F.date_format("submission_time", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))).otherwise("not a date")
    utc = F.to_utc_timestamp(dates.parse_timestamp(iso), F.current_timezone()).cast("timestamp_ntz")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", utc.alias("parsed"))


@query("fn_date_parts", with_views("r1", """
SELECT l_orderkey, l_linenumber, CAST(submission_time AS DATE) AS date,
       strftime(submission_time, '%Y-%m') AS year_month, CAST(year(submission_time) AS INTEGER) AS year
FROM r1"""))
def fn_date_parts(spark, sf):
    ts = F.col("submission_time")
    return r1(spark, sf).select("l_orderkey", "l_linenumber", dates.day(ts).alias("date"),
                                dates.month_label(ts).alias("year_month"), dates.year(ts).alias("year"))


@query("fn_month_start", with_views("r1", """
SELECT l_orderkey, l_linenumber, CAST(date_trunc('month', submission_time) AS DATE) AS month FROM r1"""))
def fn_month_start(spark, sf):
    return r1(spark, sf).select("l_orderkey", "l_linenumber",
                                dates.month_start(F.col("submission_time")).alias("month"))


@query("fn_quarter", with_views("r1", """
SELECT l_orderkey, l_linenumber, concat(year(submission_time), 'Q', quarter(submission_time)) AS quarter,
       CAST(date_trunc('quarter', submission_time) AS DATE) AS quarter_start FROM r1"""))
def fn_quarter(spark, sf):
    ts = F.col("submission_time")
    return r1(spark, sf).select("l_orderkey", "l_linenumber", dates.quarter_label(ts).alias("quarter"),
                                dates.quarter_start(ts).alias("quarter_start"))


@query("fn_rating_sentiment", with_views("r1s", """
SELECT l_orderkey, l_linenumber, rating, rating_sentiment FROM r1s"""))
def fn_rating_sentiment(spark, sf):
    return r1(spark, sf, rating=True).select(
        "l_orderkey", "l_linenumber", "rating", scores.rating_sentiment(F.col("rating")).alias("rating_sentiment"))


@query("fn_label_score", with_views("r1s", """
SELECT l_orderkey, l_linenumber, pred, CAST(label_score AS INTEGER) AS label_score,
       CAST(CASE rating_sentiment WHEN 'negative' THEN -1 WHEN 'neutral' THEN 0 WHEN 'positive' THEN 1 END
            AS INTEGER) AS truth_score FROM r1s"""))
def fn_label_score(spark, sf):
    return r1s(spark, sf, rating=True).select(
        "l_orderkey", "l_linenumber", "pred", scores.label_score(F.col("pred")).alias("label_score"),
        scores.label_score(F.col("rating_sentiment")).alias("truth_score"))


@query("fn_softmax", with_views("r1s", """
SELECT l_orderkey, l_linenumber, l_partkey, round(prob_negative, 6) AS prob_negative,
       round(prob_neutral, 6) AS prob_neutral, round(prob_positive, 6) AS prob_positive FROM r1s"""))
def fn_softmax(spark, sf):
    p = scores.softmax(F.array(F.col("l_discount") * 60, F.col("l_tax") * 75, F.col("l_quantity") / 8))
    return r1(spark, sf).withColumn("p", p).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        *[r6(F.get("p", F.lit(i))).alias(f"prob_{c}") for i, c in enumerate(K.LABELS)])


@query("fn_argmax_label", with_views("r1s", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(pred_idx AS INTEGER) AS pred_idx, pred FROM r1s"""))
def fn_argmax_label(spark, sf):
    idx = scores.argmax(F.array(F.col("l_discount") * 60, F.col("l_tax") * 75, F.col("l_quantity") / 8))
    return r1(spark, sf).withColumn("pred_idx", idx).select(
        "l_orderkey", "l_linenumber", "l_partkey", "pred_idx", scores.label_of(F.col("pred_idx")).alias("pred"))


@query("fn_confidence", with_views("r1s", """
SELECT l_orderkey, l_linenumber, l_partkey, round(confidence, 6) AS confidence FROM r1s"""))
def fn_confidence(spark, sf):
    return r1s(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", r6("confidence").alias("confidence"))


@query("fn_signed_score", with_views("r1s", """
SELECT l_orderkey, l_linenumber, l_partkey, round(score, 6) + 0.0 AS score FROM r1s"""))
def fn_signed_score(spark, sf):
    return r1s(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", r6("score").alias("score"))


@query("fn_replace_literal", with_views("r1", """
SELECT product_id, replace(product_id, '-P', '') AS product_uid,
       concat(replace(product_id, '-P', ''), '-P') AS back FROM r1"""))
def fn_replace_literal(spark, sf):
    uid = scores.replace_literal(F.col("product_id"), "-P")
    return r1(spark, sf).select("product_id", uid.alias("product_uid"), F.concat(uid, F.lit("-P")).alias("back"))


@query("fn_format_pct", with_views("r1", """
SELECT rating, count(*) AS n, printf('%.1f%%', count(*) * 100.0::DOUBLE / (SELECT count(rating) FROM r1)) AS share_text
FROM r1 WHERE rating IS NOT NULL GROUP BY 1"""))
def fn_format_pct(spark, sf):
    return aggregates.value_shares(r1(spark, sf, rating=True), "rating").select("rating", "n", "share_text")


@query("fn_null_default", with_views("r1", """
SELECT l_orderkey, l_linenumber, coalesce(rating, 0.0::DOUBLE) AS rating FROM r1"""))
def fn_null_default(spark, sf):
    return r1(spark, sf, rating=True).select(
        "l_orderkey", "l_linenumber", scores.null_default(F.col("rating"), 0.0).alias("rating"))


# --- joins --------------------------------------------------------------------------------------

@query("join_resume", with_views("p r1", """
SELECT product_uid, category_keyword, review_count FROM p WHERE NOT EXISTS (
  SELECT 1 FROM r1 WHERE submission_time < TIMESTAMP '1995-04-01'
    AND replace(product_id, '-P', '') = CAST(product_uid AS VARCHAR))"""))
def join_resume(spark, sf):
    done = r1(spark, sf).filter(F.col("submission_time") < F.lit("1995-04-01").cast("timestamp_ntz"))
    return joins.not_yet_harvested(hits(spark, sf), done).select(
        "product_uid", "category_keyword", "review_count")


@query("flt_not_in_set", with_views("p r1", """
SELECT product_uid, category_keyword FROM p WHERE CAST(product_uid AS VARCHAR) NOT IN (
  SELECT replace(product_id, '-P', '') FROM r1 WHERE l_quantity >= 49)"""))
def flt_not_in_set(spark, sf):
    done = r1(spark, sf).filter(F.col("l_quantity") >= 49)
    return joins.not_yet_harvested(hits(spark, sf), done).select("product_uid", "category_keyword")


@query("join_product_reviews", with_views("p r1", """
SELECT r1.review_id, r1.product_id, p.category_keyword, r1.l_orderkey, r1.l_linenumber
FROM r1 JOIN p ON r1.product_id = concat(p.product_uid, '-P')"""))
def join_product_reviews(spark, sf):
    return joins.attach_keyword(r1(spark, sf), hits(spark, sf)).select(
        "review_id", "product_id", "category_keyword", "l_orderkey", "l_linenumber")


#: Names of some topics; the others get the default.
TOPIC_NAMES = {0: "Quality", 1: "Recipe", 2: "Taste"}


@query("join_label_lookup", with_views("r1s", """
SELECT l_orderkey, l_linenumber, l_partkey, pred, CAST(label_score AS INTEGER) AS label_score,
       CASE dominant_topic WHEN 0 THEN 'Quality' WHEN 1 THEN 'Recipe'
         WHEN 2 THEN 'Taste' END AS known_name,
       CASE dominant_topic WHEN 0 THEN 'Quality' WHEN 1 THEN 'Recipe'
         WHEN 2 THEN 'Taste' ELSE concat('Topic ', dominant_topic) END AS shown_name FROM r1s"""))
def join_label_lookup(spark, sf):
    names = TOPIC_NAMES
    topic = F.col("dominant_topic")
    return r1s(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", scores.label_of(F.col("pred_idx")).alias("pred"),
        scores.label_score(F.col("pred")).alias("label_score"),
        scores.topic_name(topic, names).alias("known_name"),
        scores.topic_name(topic, names, default=True).alias("shown_name"))


@query("join_scalar", with_views("r1", """
SELECT l_orderkey, l_linenumber, rating, rating > (SELECT avg(rating) FROM r1) AS above FROM r1"""))
def join_scalar(spark, sf):
    df = r1(spark, sf, rating=True)
    return joins.above_scalar(df, "rating", df.agg(F.avg("rating"))).select(
        "l_orderkey", "l_linenumber", "rating", "above")


# --- aggregates ---------------------------------------------------------------------------------

@query("agg_summary", with_views("r1", """
SELECT count(*) AS reviews, count(DISTINCT product_id) AS products,
       count(DISTINCT category_keyword) AS categories, CAST(min(submission_time) AS DATE) AS first_date,
       CAST(max(submission_time) AS DATE) AS last_date, round(avg(rating), 6) AS mean_rating,
       CAST(trunc(median(l_quantity)) AS INTEGER) AS median_words FROM r1"""))
def agg_summary(spark, sf):
    df = r1(spark, sf, rating=True, product=True)
    return rounded(aggregates.summary(df, words="l_quantity"), "mean_rating")


@query("agg_value_counts", with_views("r1", """
SELECT 'rating' AS field, CAST(CAST(rating AS INTEGER) AS VARCHAR) AS value, count(*) AS n FROM r1
WHERE rating IS NOT NULL GROUP BY 2
UNION ALL SELECT 'category', category_keyword, count(*) FROM r1 GROUP BY 2
UNION ALL SELECT 'year', CAST(year(submission_time) AS VARCHAR), count(*) FROM r1 GROUP BY 2"""))
def agg_value_counts(spark, sf):
    df = r1(spark, sf, rating=True, product=True)
    values = {"rating": F.col("rating").cast("int").cast("string"), "category": F.col("category_keyword"),
              "year": F.year("submission_time").cast("string")}
    counted = [aggregates.value_counts(df.select(v.alias("value")), "value").select(F.lit(k).alias("field"), "value", "n")
               for k, v in values.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("agg_value_share", with_views("r1s", """
SELECT rating_sentiment, count(*) AS n,
       round(count(*) / (SELECT count(rating_sentiment) FROM r1s), 6) AS share,
       printf('%.1f%%', count(*) * 100.0::DOUBLE / (SELECT count(rating_sentiment) FROM r1s)) AS share_text
FROM r1s WHERE rating_sentiment IS NOT NULL GROUP BY 1"""))
def agg_value_share(spark, sf):
    df = r1(spark, sf, rating=True).withColumn("rating_sentiment", scores.rating_sentiment(F.col("rating")))
    return rounded(aggregates.value_shares(df, "rating_sentiment"), "share")


@query("agg_monthly_volume", with_views("r1", """
SELECT strftime(submission_time, '%Y-%m') AS year_month, count(*) AS n,
       CAST(min(date_trunc('month', submission_time)) AS DATE) AS month_date FROM r1 GROUP BY 1"""))
def agg_monthly_volume(spark, sf):
    return aggregates.monthly_volume(r1(spark, sf).withColumn(
        "year_month", dates.month_label(F.col("submission_time"))))


@query("agg_category_rating", with_views("r1", """
SELECT category_keyword, round(avg(rating), 6) AS mean_rating, count(rating) AS n,
       CASE WHEN avg(rating) < 4 THEN 'low' WHEN avg(rating) < 4.5 THEN 'medium' ELSE 'high' END AS tier,
       round((SELECT avg(rating) FROM r1), 6) AS overall_mean FROM r1 GROUP BY 1"""))
def agg_category_rating(spark, sf):
    return rounded(aggregates.category_rating(r1(spark, sf, rating=True, product=True)),
                   "mean_rating", "overall_mean")


@query("agg_monthly_truth", with_views("r1s", """
SELECT CAST(date_trunc('month', submission_time) AS DATE) AS year_month,
       round(avg(label_score), 6) AS pred_mean,
       round(avg(CASE rating_sentiment WHEN 'negative' THEN -1 WHEN 'neutral' THEN 0
                 WHEN 'positive' THEN 1 END), 6) AS truth_mean, count(pred) AS n
FROM r1s GROUP BY 1 HAVING count(pred) >= 20"""))
def agg_monthly_truth(spark, sf):
    return rounded(temporal.monthly_truth(r1s(spark, sf, rating=True)), "pred_mean", "truth_mean")


MONTHLY_SQL = with_views("r1s", """
SELECT CAST(date_trunc('month', submission_time) AS DATE) AS year_month,
       round(avg(label_score), 6) AS mean_sentiment,
       round(count(*) FILTER (pred = 'negative') * 100.0::DOUBLE / count(*), 6) AS pct_negative,
       count(pred) AS review_count, round(avg(rating), 6) AS mean_rating
FROM r1s GROUP BY 1 HAVING count(pred) >= 100""")


@query("agg_monthly_sentiment", MONTHLY_SQL)
def agg_monthly_sentiment(spark, sf):
    return rounded(temporal.monthly_sentiment(r1s(spark, sf, rating=True)),
                   "mean_sentiment", "pct_negative", "mean_rating")


@query("agg_pct_where", with_views("r1s", """
SELECT category_keyword,
       round(sum(CASE WHEN rating_sentiment = 'negative' THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*), 6)
         AS pct_negative FROM r1s GROUP BY 1"""))
def agg_pct_where(spark, sf):
    df = r1(spark, sf, rating=True, product=True)
    negative = scores.rating_sentiment(F.col("rating")) == "negative"
    return df.groupBy("category_keyword").agg(r6(aggregates.pct_where(negative)).alias("pct_negative"))


TOPIC_NAMES_SQL = """CASE dominant_topic WHEN 0 THEN 'Quality' WHEN 1 THEN 'Recipe' WHEN 2 THEN 'Taste'
  ELSE concat('Topic ', dominant_topic) END"""


@query("agg_topic_month", with_views("r1s", f"""
, named AS (SELECT CAST(date_trunc('month', submission_time) AS DATE) AS year_month,
                   {TOPIC_NAMES_SQL} AS topic_name FROM r1s WHERE pred = 'negative' AND confidence >= 0.8),
months AS (SELECT DISTINCT year_month FROM named), names AS (SELECT DISTINCT topic_name FROM named)
SELECT m.year_month, t.topic_name, count(n.topic_name) AS n FROM months m CROSS JOIN names t
LEFT JOIN named n ON n.year_month = m.year_month AND n.topic_name = t.topic_name GROUP BY 1, 2"""))
def agg_topic_month(spark, sf):
    return temporal.topic_month(filters.confident_negative(r1s(spark, sf)), 5, TOPIC_NAMES)


@query("agg_topic_quarter_pct", with_views("r1", """
, q AS (SELECT CAST(date_trunc('quarter', submission_time) AS DATE) AS quarter, dominant_topic FROM r1),
quarters AS (SELECT quarter, count(*) AS total FROM q GROUP BY 1), topics AS (SELECT DISTINCT dominant_topic FROM q)
SELECT s.quarter, t.dominant_topic, count(q.dominant_topic) AS n,
       round(count(q.dominant_topic) * 100.0::DOUBLE / any_value(s.total), 6) AS pct
FROM quarters s CROSS JOIN topics t
LEFT JOIN q ON q.quarter = s.quarter AND q.dominant_topic = t.dominant_topic GROUP BY 1, 2"""))
def agg_topic_quarter_pct(spark, sf):
    return rounded(temporal.topic_quarter_pct(r1(spark, sf), 7), "pct")


@query("agg_crosstab_pct", with_views("r1s", """
SELECT rating, round(count(*) FILTER (pred = 'negative') * 100.0::DOUBLE / count(*), 6) AS negative,
       round(count(*) FILTER (pred = 'neutral') * 100.0::DOUBLE / count(*), 6) AS neutral,
       round(count(*) FILTER (pred = 'positive') * 100.0::DOUBLE / count(*), 6) AS positive
FROM r1s WHERE rating IS NOT NULL GROUP BY 1"""))
def agg_crosstab_pct(spark, sf):
    return rounded(aggregates.crosstab_pct(r1s(spark, sf, rating=True), "rating", "pred", K.LABELS), *K.LABELS)


@query("agg_crosstab_topic", with_views("r1", """
SELECT category_keyword, """ + ", ".join(
    f'round(count(*) FILTER (dominant_topic = {t}) * 100.0::DOUBLE / count(*), 6) AS "t{t}"'
    for t in range(5)) + " FROM r1 GROUP BY 1"))
def agg_crosstab_topic(spark, sf):
    ct = aggregates.crosstab_pct(r1(spark, sf, product=True), "category_keyword", "dominant_topic", list(range(5)))
    return ct.select("category_keyword", *[r6(F.col(f"`{t}`")).alias(f"t{t}") for t in range(5)])


CELLS_SQL = """, cells AS (
  SELECT category_keyword, concat(year(submission_time), 'Q', quarter(submission_time)) AS quarter,
         avg(label_score) AS mean_sentiment FROM r1s GROUP BY 1, 2)"""


@query("agg_category_quarter", with_views("r1s", CELLS_SQL + """
SELECT category_keyword, quarter, round(mean_sentiment, 6) AS mean_sentiment FROM cells"""))
def agg_category_quarter(spark, sf):
    return rounded(temporal.category_quarter(r1s(spark, sf, product=True)), "mean_sentiment")


QUARTERS = [f"{y}Q{q}" for y in range(1995, 2002) for q in (1, 2, 3, 4)]


@query("agg_category_quarter_wide", with_views("r1s", CELLS_SQL + """
SELECT category_keyword, """ + ", ".join(
    f"""round(max(mean_sentiment) FILTER (quarter = '{q}'), 6) AS "{q}" """ for q in QUARTERS)
    + "FROM cells GROUP BY 1"))
def agg_category_quarter_wide(spark, sf):
    wide = temporal.category_quarter_wide(temporal.category_quarter(r1s(spark, sf, product=True)), QUARTERS)
    return rounded(wide, *QUARTERS)


@query("agg_pivot_thresh", with_views("r1s", """
, cells AS (
  SELECT product_id AS category_keyword, concat(year(submission_time), 'Q', quarter(submission_time)) AS quarter,
         avg(label_score) AS mean_sentiment FROM r1s GROUP BY 1, 2)
SELECT category_keyword, count(*) AS n_quarters, round(avg(mean_sentiment), 6) + 0.0 AS mean_of_cells FROM cells
GROUP BY 1 HAVING count(*) >= 0.6 * (SELECT count(DISTINCT quarter) FROM cells)"""))
def agg_pivot_thresh(spark, sf):
    # Products stand for categories: most leave some quarters empty, so the threshold binds.
    df = r1s(spark, sf).withColumn("category_keyword", F.col("product_id"))
    return rounded(temporal.pivot_threshold(temporal.category_quarter(df)), "mean_of_cells")


# --- metrics ------------------------------------------------------------------------------------

METRIC_SQL = """, counts AS (
  SELECT rating_sentiment AS truth, pred, count(*) AS n FROM r1s WHERE rating_sentiment IS NOT NULL GROUP BY 1, 2),
labels AS (SELECT truth AS label FROM counts UNION SELECT pred FROM counts),
sums AS (
  SELECT label, (SELECT coalesce(sum(n), 0) FROM counts WHERE truth = label) AS support,
         (SELECT coalesce(sum(n), 0) FROM counts WHERE pred = label) AS predicted,
         (SELECT coalesce(sum(n), 0) FROM counts WHERE truth = label AND pred = label) AS hit FROM labels),
classes AS (
  SELECT label, CASE WHEN predicted = 0 THEN 0 ELSE hit / predicted END AS precision,
         CASE WHEN support = 0 THEN 0 ELSE hit / support END AS recall,
         CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hit / (support + predicted) END AS f1,
         support FROM sums)"""


def _counts(spark, sf):
    return metrics.label_counts(r1s(spark, sf, rating=True))


@query("agg_confusion", with_views("r1s", METRIC_SQL + """
, grid AS (SELECT a.label AS truth, b.label AS pred FROM labels a CROSS JOIN labels b)
SELECT g.truth, g.pred, CAST(coalesce(n, 0) AS BIGINT) AS n,
       round(coalesce(n, 0) * 100.0::DOUBLE / support, 6) AS row_pct
FROM grid g JOIN sums ON g.truth = label LEFT JOIN counts c ON g.truth = c.truth AND g.pred = c.pred"""))
def agg_confusion(spark, sf):
    return rounded(metrics.confusion(_counts(spark, sf)), "row_pct")


@query("agg_accuracy", with_views("r1s", METRIC_SQL + """
SELECT round(sum(n) FILTER (truth = pred) / sum(n), 6) AS accuracy FROM counts"""))
def agg_accuracy(spark, sf):
    return rounded(metrics.accuracy(_counts(spark, sf)), "accuracy")


@query("agg_f1", with_views("r1s", METRIC_SQL + """
SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM classes"""))
def agg_f1(spark, sf):
    return rounded(metrics.f1_scores(_counts(spark, sf)), "macro_f1", "weighted_f1")


REPORT_SQL = """
, acc AS (SELECT sum(n) FILTER (truth = pred) / sum(n) AS a, sum(n) AS s FROM counts),
report AS (
  SELECT label, precision, recall, f1, support FROM classes
  UNION ALL SELECT 'accuracy', a, a, a, s FROM acc
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM classes
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
    sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM classes)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM report"""


@query("agg_class_report", with_views("r1s", METRIC_SQL + REPORT_SQL))
def agg_class_report(spark, sf):
    return rounded(metrics.class_report(_counts(spark, sf)), "precision", "recall", "f1")


@query("agg_confidence", with_views("r1s", """
SELECT round(avg(confidence), 6) AS mean_confidence,
       count(*) FILTER (pred = 'negative' AND confidence > 0.8) AS confident_negatives FROM r1s"""))
def agg_confidence(spark, sf):
    return rounded(metrics.confidence_summary(r1s(spark, sf)), "mean_confidence")


# --- windows, sorts, sets -----------------------------------------------------------------------

@query("win_dedup_first", with_views("r1", """
SELECT review_id, product_id, submission_time, l_orderkey, l_linenumber FROM r1
QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) = 1"""))
def win_dedup_first(spark, sf):
    return ranking.keep_first(r1(spark, sf), ["review_id"], order_columns()).select(
        "review_id", "product_id", "submission_time", "l_orderkey", "l_linenumber")


@query("win_recent_cap", with_views("r1", """
, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY submission_time DESC, l_orderkey,
    l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
    l_linestatus) AS rn, count(*) OVER (PARTITION BY product_id) AS review_count FROM r1)
SELECT product_id, review_id, submission_time, l_orderkey, l_linenumber FROM ranked
WHERE review_count >= 20 AND rn <= least(20, review_count)"""))
def win_recent_cap(spark, sf):
    order = [F.desc("submission_time"), *order_columns()]
    return ranking.recent_cap(r1(spark, sf), order, cap=20, min_reviews=20).select(
        "product_id", "review_id", "submission_time", "l_orderkey", "l_linenumber")


@query("win_stratified_sample", with_views("r1", """
, keyed AS (
  SELECT *, md5(concat('42:', l_orderkey, '/', l_linenumber, '/', l_partkey, '/', l_suppkey)) AS h FROM r1
  WHERE rating IS NOT NULL)
SELECT rating, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM keyed
QUALIFY row_number() OVER (PARTITION BY rating ORDER BY h, l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) <= 1000"""))
def win_stratified_sample(spark, sf):
    key = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return sampling.stratified_sample(r1(spark, sf, rating=True), key, tie_break=order_columns()).select(
        "rating", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("win_sample_sketch", with_views("r1", """
, keyed AS (
  SELECT *, md5(concat('42:', l_orderkey, '/', l_linenumber, '/', l_partkey, '/', l_suppkey)) AS h FROM r1
  WHERE rating IS NOT NULL)
SELECT rating, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM keyed
QUALIFY row_number() OVER (PARTITION BY rating ORDER BY h, l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) <= 1000"""))
def win_sample_sketch(spark, sf):
    """The same sample from the stored sketches of three drops."""
    key, store = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), scratch_path(spark, "sketch")
    rows = r1(spark, sf, rating=True)
    for batch in range(3):
        sampling.add_to_sketch(rows.filter(F.col("l_suppkey") % 3 == batch), store, batch, key, tie_break=order_columns())
    return sampling.read_sketch(spark, store, tie_break=order_columns()).select(
        "rating", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("agg_exact_quantiles", """
SELECT unnest([0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0])::DOUBLE AS share,
       round(unnest(quantile_cont(l_extendedprice, [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0])), 6) AS value FROM lineitem""")
def agg_exact_quantiles(spark, sf):
    found = selection.exact_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0])
    return rounded(local_table(spark, list(found.items()), schemas.struct(share="double", value="double")), "value")


@query("win_topic_exemplars", with_views("r1s", """
SELECT dominant_topic, CAST(rank AS INTEGER) AS rank, l_orderkey, l_linenumber,
       round(topic_probability, 6) AS topic_probability, topic_size FROM (
  SELECT *, count(*) OVER (PARTITION BY dominant_topic) AS topic_size,
         row_number() OVER (PARTITION BY dominant_topic ORDER BY round(topic_probability, 9) DESC, l_orderkey,
           l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
           l_returnflag, l_linestatus, l_shipdate) AS rank FROM r1s) WHERE rank <= 3"""))
def win_topic_exemplars(spark, sf):
    df = r1s(spark, sf).withColumn("topic_probability", F.round("topic_probability", 9))
    return rounded(ranking.topic_exemplars(df, order_columns(), text=None), "topic_probability").select(
        "dominant_topic", "rank", "l_orderkey", "l_linenumber", "topic_probability", "topic_size")


@query("srt_order_by", with_views("r1", """
SELECT category_keyword, count(*) AS n FROM r1 GROUP BY 1 ORDER BY n DESC, category_keyword"""))
def srt_order_by(spark, sf):
    return aggregates.value_counts(r1(spark, sf, product=True), "category_keyword").orderBy(
        F.desc("n"), "category_keyword")


@query("set_distinct", with_views("r1", """
SELECT 'product' AS field, product_id AS value FROM r1 GROUP BY 2
UNION ALL SELECT 'rating', CAST(CAST(rating AS INTEGER) AS VARCHAR) FROM r1 WHERE rating IS NOT NULL GROUP BY 2"""))
def set_distinct(spark, sf):
    products = r1(spark, sf).select(F.lit("product").alias("field"), F.col("product_id").alias("value"))
    stars = r1(spark, sf, rating=True).filter(F.col("rating").isNotNull()).select(
        F.lit("rating").alias("field"), F.col("rating").cast("int").cast("string").alias("value"))
    return products.distinct().unionByName(stars.distinct())


_KEYWORD_SQL = ", ".join(f"({i}, '{w}')" for i, w in enumerate(K.CATEGORY_KEYWORDS))


@query("src_const_tables", with_views("r1s ev", f"""
, kw(pos, word) AS (VALUES {_KEYWORD_SQL}),
seen AS (SELECT doc_id, unnest(list_distinct({words_sql('text')})) AS word FROM documents)
SELECT 'label' AS kind, pred AS name, pred_idx AS place, CAST(any_value(label_score) AS INTEGER) AS score, count(*) AS n FROM r1s GROUP BY 2, 3
UNION ALL SELECT 'keyword', kw.word, pos, NULL, count(doc_id) FROM kw LEFT JOIN seen USING (word) GROUP BY 2, 3
UNION ALL SELECT 'event', event_label, NULL, NULL, count(review_id) FROM ev LEFT JOIN r1 ON CAST(submission_time AS DATE) = event_date GROUP BY 2"""))
def src_const_tables(spark, sf):
    """Each constant table joined with rows that use it: classes, documents with a keyword, reviews on the day of an event."""
    counts = r1s(spark, sf).groupBy("pred_idx").agg(F.count(F.lit(1)).alias("n"))
    labels = label_table(spark).join(counts, "pred_idx").select(
        F.lit("label").alias("kind"), F.col("label").alias("name"), F.col("pred_idx").alias("place"), F.col("label_score").alias("score"), "n")
    words = table(spark, sf, "documents").select(F.explode(F.array_distinct(raw_tokens(F.col("text")))).alias("category_keyword"))
    seen = words.join(keyword_table(spark), "category_keyword").groupBy("category_keyword").agg(F.count(F.lit(1)).alias("n"))
    keywords = keyword_table(spark).join(seen, "category_keyword", "left").select(
        F.lit("keyword"), "category_keyword", "kw_pos", F.lit(None).cast("int"), F.coalesce("n", F.lit(0).cast("bigint")))
    days = r1(spark, sf).groupBy(F.to_date("submission_time").alias("event_date")).agg(F.count(F.lit(1)).alias("n"))
    dated = events(spark).join(days, "event_date", "left").select(
        F.lit("event"), "event_label", F.lit(None).cast("int"), F.lit(None).cast("int"), F.coalesce("n", F.lit(0).cast("bigint")))
    return labels.union(keywords).union(dated)
