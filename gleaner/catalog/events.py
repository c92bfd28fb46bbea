"""Event-window queries: the event list against the numeric stand-in reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalog.registry import query, rounded
from gleaner.catalog.views import events, r1, r1s, with_views
from gleaner.operators import filters, joins, temporal

IMPACT_SQL = """
, sides AS (
  SELECT event_date, event_label, pred, label_score, submission_time < event_date AS before
  FROM r1s JOIN ev ON submission_time >= event_date - INTERVAL 30 DAY
                  AND submission_time < event_date + INTERVAL 30 DAY),
sums AS (
  SELECT event_date, event_label, count(*) FILTER (before) AS n_before, count(*) FILTER (NOT before) AS n_after,
         avg(label_score) FILTER (before) AS b, avg(label_score) FILTER (NOT before) AS a,
         count(*) FILTER (before AND pred = 'negative') AS nb, count(*) FILTER (NOT before AND pred = 'negative') AS na
  FROM sides GROUP BY 1, 2)
SELECT event_date, event_label, n_before, n_after, round(b, 6) AS mean_sent_before, round(a, 6) AS mean_sent_after,
       round(a - b, 6) + 0.0 AS delta, round(nb * 100.0::DOUBLE / n_before, 6) AS pct_negative_before,
       round(na * 100.0::DOUBLE / n_after, 6) AS pct_negative_after
FROM sums WHERE n_before >= 30 AND n_after >= 30"""
IMPACT_DOUBLES = ["mean_sent_before", "mean_sent_after", "delta", "pct_negative_before", "pct_negative_after"]


@query("agg_event_impact", with_views("r1s ev", IMPACT_SQL))
def agg_event_impact(spark, sf):
    return rounded(temporal.event_impact(r1s(spark, sf), events(spark)), *IMPACT_DOUBLES)


@query("join_event_window", with_views("r1 ev", """
SELECT event_date, event_label, l_orderkey, l_linenumber, l_partkey, submission_time,
       CASE WHEN submission_time < event_date THEN 'before' ELSE 'after' END AS side
FROM r1 JOIN ev ON submission_time >= event_date - INTERVAL 30 DAY
               AND submission_time < event_date + INTERVAL 30 DAY"""))
def join_event_window(spark, sf):
    return joins.event_window(r1(spark, sf), events(spark)).select(
        "event_date", "event_label", "l_orderkey", "l_linenumber", "l_partkey", "submission_time", "side")


@query("fn_date_offset", with_views("r1 ev", """
SELECT event_label, CAST(event_date - INTERVAL 30 DAY AS DATE) AS first_day,
       CAST(event_date + INTERVAL 29 DAY AS DATE) AS last_day, count(review_id) AS n
FROM ev LEFT JOIN r1 ON submission_time >= event_date - INTERVAL 30 DAY
                    AND submission_time < event_date + INTERVAL 30 DAY GROUP BY 1, 2, 3"""))
def fn_date_offset(spark, sf):
    spans = joins.event_days(events(spark)).groupBy("event_label").agg(
        F.min("_day").alias("first_day"), F.max("_day").alias("last_day"))
    counts = joins.event_window(r1(spark, sf), events(spark)).groupBy("event_label").agg(
        F.count(F.lit(1)).alias("n"))
    return spans.join(counts, "event_label", "left").select(
        "event_label", "first_day", "last_day", F.coalesce("n", F.lit(0)).alias("n"))


@query("flt_events_in_range", with_views("r1s ev", """
, monthly AS (SELECT CAST(date_trunc('month', submission_time) AS DATE) AS m FROM r1s
              GROUP BY 1 HAVING count(pred) >= 100)
SELECT event_date, event_label FROM ev
WHERE event_date >= (SELECT min(m) FROM monthly) AND event_date <= (SELECT max(m) FROM monthly)"""))
def flt_events_in_range(spark, sf):
    monthly = temporal.monthly_sentiment(r1s(spark, sf, rating=True))
    return filters.events_in_range(events(spark), monthly)


@query("pipe_temporal", with_views("r1s ev", IMPACT_SQL.replace("\nSELECT event_date, event_label, n_before", """
, monthly AS (
  SELECT CAST(date_trunc('month', submission_time) AS DATE) AS d, avg(label_score) AS mean,
         count(*) FILTER (pred = 'negative') * 100.0::DOUBLE / count(*) AS pct, count(pred) AS n
  FROM r1s GROUP BY 1 HAVING count(pred) >= 100),
impact AS (
SELECT event_date, event_label, n_before""") + """)
SELECT 'monthly' AS report, CAST(d AS VARCHAR) AS name, n, round(mean, 6) AS mean_sentiment,
       round(pct, 6) AS pct_negative FROM monthly
UNION ALL SELECT 'event before', event_label, n_before, mean_sent_before, pct_negative_before FROM impact
UNION ALL SELECT 'event after', event_label, n_after, mean_sent_after, pct_negative_after FROM impact"""))
def pipe_temporal(spark, sf):
    from gleaner.plans.jobs import temporal_reports
    out = temporal_reports(r1s(spark, sf, rating=True, product=True), events(spark))
    monthly = out["monthly"].select(
        F.lit("monthly").alias("report"), F.col("year_month").cast("string").alias("name"),
        F.col("review_count").alias("n"), "mean_sentiment", "pct_negative")
    impact = out["event_impact"].select(F.inline(F.array(*[
        F.struct(F.lit(f"event {s}").alias("report"), F.col("event_label").alias("name"),
                 F.col(f"n_{s}").alias("n"), F.col(f"mean_sent_{s}").alias("mean_sentiment"),
                 F.col(f"pct_negative_{s}").alias("pct_negative")) for s in ("before", "after")])))
    return rounded(monthly.unionByName(impact), "mean_sentiment", "pct_negative")
