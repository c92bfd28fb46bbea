import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions import scores
from gleaner.operators import aggregates, filters, joins, metrics, ranking, sampling, temporal
from gleaner.sources import requests, tables


# --- ranking and sampling -----------------------------------------------------------------------

def test_keep_first_collapses_null_ids(spark, rows):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 5), (None, 4), ("b", 3)], "id string, seq int")
    first = ranking.keep_first(df, ["id"], [F.col("seq")])
    assert rows(first) == sorted([("a", 1), (None, 4), ("b", 3)], key=repr)
    assert rows(ranking.keep_first(first, ["id"], [F.col("seq")])) == rows(first)


def test_top_n_limits_rows_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = ranking.top_n_per_group(df, ["k"], [F.desc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # once before the exchange, once after


def test_recent_cap(spark, rows):
    df = spark.createDataFrame([("p", i) for i in range(5)] + [("q", 1)], "product_id string, t int")
    assert rows(ranking.recent_cap(df, [F.desc("t")], cap=2, min_reviews=2)) == [("p", 3), ("p", 4)]
    counts = spark.createDataFrame([("p", 1), ("q", 9)], "product_id string, review_count int")
    got = ranking.recent_cap(df, [F.desc("t")], cap=2, min_reviews=1, counts=counts)
    assert rows(got) == [("p", 4), ("q", 1)]


def test_exemplars_keep_order_on_ties(spark, rows):
    df = spark.createDataFrame([(0, 0.5, 1, "x" * 200), (0, 0.9, 2, "b"), (0, 0.5, 3, "c"), (0, 0.5, 4, "d"), (1, 0.1, 5, "e")],
                               "dominant_topic int, topic_probability double, seq int, full_text string")
    got = ranking.topic_exemplars(df, [F.col("seq")])
    assert rows(got, "dominant_topic", "rank", "seq", "topic_size") == [
        (0, 1, 2, 4), (0, 2, 1, 4), (0, 3, 3, 4), (1, 1, 5, 1)]
    assert got.filter("seq = 1").first()["snippet"] == "x" * 180 + "..."


@pytest.mark.parametrize("n", [1, 7, 50, 1000])
def test_stratified_sample_is_exact(spark, n):
    random.seed(3)
    data = [(random.choice([1.0, 2.0, 2.0, 2.0, None]), f"r{i}") for i in range(300)]
    df = spark.createDataFrame(data, "rating double, id string")
    got = {}
    for r in sampling.stratified_sample(df, F.col("id"), n, shuffle=True).collect():
        got.setdefault(r["rating"], set()).add(r["id"])
    for stars in (1.0, 2.0):
        ids = sorted((i for s, i in data if s == stars), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
        assert got[stars] == set(ids[:n])
    assert None not in got


def test_sample_with_one_dominant_key(spark):
    # One id holds a third of the rows: ties are broken by the given order, sizes stay exact.
    df = spark.range(300).select(F.lit(5.0).alias("rating"), "id", F.when(F.col("id") < 100, 0).otherwise(F.col("id")).alias("k"))
    got = sampling.stratified_sample(df, F.col("k"), 150, tie_break=[F.col("id")])
    assert got.count() == 150 and got.select("id").distinct().count() == 150


# --- filters ------------------------------------------------------------------------------------

def test_cleaning_audit_counts_null_ids_once(spark):
    t = dt.datetime(2024, 1, 1)
    data = [("a", "x", t), ("a", "y", t), (None, "z", t), (None, "w", t), ("b", " ", t), ("c", None, t), ("d", "x", None),
            ("e", "x", dt.datetime(2020, 1, 1))]
    df = spark.createDataFrame(data, "review_id string, text string, submission_time timestamp_ntz")
    got = [tuple(r) for r in filters.cleaning_audit(df).orderBy("step_no").select("kept", "removed").collect()]
    assert got == [(8, 0), (6, 2), (5, 1), (4, 1), (2, 2)]


def test_min_tokens_boundary_and_single_evaluation(spark):
    df = spark.createDataFrame([("a b c d",), ("a b c d e",), (None,)], "t string")
    out = filters.with_tokens(df, F.split("t", " "))
    assert [r["t"] for r in out.collect()] == ["a b c d e"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert filters.min_tokens(df.select("t", F.split("t", " ").alias("tokens"))).count() == 1


def test_events_in_range_includes_both_ends(spark, rows):
    monthly = spark.createDataFrame([(dt.date(2023, 3, 1),), (dt.date(2023, 6, 1),)], "year_month date")
    days = ["2023-02-28", "2023-03-01", "2023-04-11", "2023-06-01", "2023-06-02"]
    events = tables.event_table(spark, [(d, d, "macro", "") for d in days])
    assert rows(filters.events_in_range(events, monthly), "event_label") == [(d,) for d in days[1:4]]


# --- joins --------------------------------------------------------------------------------------

def test_resume_matches_suffix(spark, rows):
    products = spark.createDataFrame([(1, "k"), (2, "k"), (3, "k")], "product_uid bigint, category_keyword string")
    reviews = spark.createDataFrame([("1-P",), ("1-P",), ("-P3-P",), (None,)], "product_id string")
    assert rows(joins.not_yet_harvested(products, reviews), "product_uid") == [(2,)]
    assert rows(joins.attach_keyword(reviews, products)) == [("1-P", "k"), ("1-P", "k")]


def test_event_window_rows_can_meet_two_events(spark, rows):
    events = tables.event_table(spark, [("2023-03-31", "a", "", ""), ("2023-04-11", "b", "", "")])
    times = [dt.datetime(2023, 3, 1), dt.datetime(2023, 2, 28, 23), dt.datetime(2023, 4, 10, 12), dt.datetime(2023, 4, 30)]
    df = spark.createDataFrame([(t,) for t in times], "submission_time timestamp_ntz")
    got = rows(joins.event_window(df, events), "submission_time", "event_label", "side")
    assert got == sorted([(times[0], "a", "before"), (times[2], "a", "after"), (times[2], "b", "before"),
                          (times[3], "b", "after")], key=repr)


# --- request plans ------------------------------------------------------------------------------

def test_search_and_harvest_plans(spark, rows):
    kw = tables.keyword_table(spark, ["own range"])
    assert requests.search_plan(kw).count() == 50
    products = spark.createDataFrame([("a", 230), ("b", 100), ("c", 0), ("d", 1)], "product_uid string, review_count int")
    got = rows(requests.harvest_plan(products, max_reviews=150), "product_uid", "offset", "limit")
    assert got == [("a", 0, 100), ("a", 100, 50), ("b", 0, 100), ("d", 0, 1)]


def test_pages_stop_at_the_first_short_one(spark, rows):
    pages = spark.createDataFrame([("x", 1, 60), ("x", 2, 59), ("x", 3, 60), ("y", 1, 60), ("y", 2, 60)],
                                  "category_keyword string, page int, n int")
    got = rows(requests.keep_until_short_page(pages), "category_keyword", "page")
    assert got == [("x", 1), ("x", 2), ("y", 1), ("y", 2)]


def test_page_slice(spark, rows):
    df = spark.createDataFrame([("p", i) for i in range(10)], "product_id string, t int")
    assert rows(requests.page_slice(df, [F.desc("t")], 3, 2), "t", "position") == [(5, 5), (6, 4)]


# --- aggregates ---------------------------------------------------------------------------------

def test_shares_ignore_nulls_but_percent_where_does_not(spark, rows):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    assert rows(aggregates.value_shares(df, "v"), "v", "n", "share_text") == [("a", 2, "66.7%"), ("b", 1, "33.3%")]
    assert df.agg(aggregates.pct_where(F.col("v") == "a")).first()[0] == 50.0


def test_quantile_and_histogram(spark, rows):
    values = list(range(0, 101)) + [5000]
    df = spark.createDataFrame([(v,) for v in values], "w int")
    q = aggregates.exact_quantile(df, "w", 0.99).first()[0]
    assert q == pytest.approx(99.99)
    kept = aggregates.quantile_clip(df, "w", 0.5)
    assert kept.count() == 51  # the quantile itself stays
    bins = rows(aggregates.histogram(df.filter("w <= 100"), "w", 50).orderBy("bin"), "bin", "n")
    same = spark.createDataFrame([(7,), (7,), (None,)], "w int")
    one = [tuple(r) for r in aggregates.histogram(same, "w").orderBy("bin").collect()]
    assert [r for r in one if r[3]] == [(25, 7.0, 7.02, 2)] and [r[0] for r in one] == list(range(50))
    assert aggregates.histogram(same.filter("w IS NULL"), "w").collect() == []
    assert bins[-1] == (9, 2) and dict(bins)[49] == 3 and sum(n for _, n in bins) == 101


def test_category_rating_tiers(spark, rows):
    df = spark.createDataFrame([("a", 3.0), ("a", None), ("b", 4.0), ("c", 4.5), (None, 1.0)], "category_keyword string, rating double")
    got = [tuple(r) for r in aggregates.category_rating(df).select("category_keyword", "n", "tier", "overall_mean").collect()]
    assert got == [("a", 1, "low", 3.125), ("b", 1, "medium", 3.125), ("c", 1, "high", 3.125)]


def test_crosstab_rows_sum_to_100(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "y"), (None, "x"), (1, None)], "a int, b string")
    ct = aggregates.crosstab_pct(df, "a", "b", ["x", "y", "z"]).orderBy("a").collect()
    assert [tuple(r) for r in ct] == [(1, pytest.approx(100 / 3), pytest.approx(200 / 3), 0.0), (2, 0.0, 100.0, 0.0)]


# --- metrics ------------------------------------------------------------------------------------

def brute(pairs):
    labels = sorted({x for p in pairs for x in p})
    out = {}
    for c in labels:
        tp = sum(t == c == p for t, p in pairs)
        sup, pred = sum(t == c for t, _ in pairs), sum(p == c for _, p in pairs)
        out[c] = (tp / pred if pred else 0.0, tp / sup if sup else 0.0, 2 * tp / (sup + pred) if sup + pred else 0.0, sup)
    return out


@pytest.mark.parametrize("pairs", [
    [("negative", "negative"), ("negative", "positive"), ("neutral", "positive"), ("positive", "positive")],
    [("negative", "positive"), ("positive", "negative")],
    [("positive", "positive")] * 3,
    [("negative", "neutral"), ("negative", "negative")],
])
def test_metrics_against_brute_force(spark, pairs):
    df = spark.createDataFrame(pairs + [(None, "negative")], "rating_sentiment string, pred string")
    counts = metrics.label_counts(df)
    want = brute(pairs)
    got = {r["label"]: tuple(r)[1:] for r in metrics.per_class(counts).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    acc = sum(t == p for t, p in pairs) / len(pairs)
    assert metrics.accuracy(counts).first()[0] == pytest.approx(acc)
    macro, weighted = metrics.f1_scores(counts).first()
    assert macro == pytest.approx(sum(v[2] for v in want.values()) / len(want))
    assert weighted == pytest.approx(sum(v[2] * v[3] for v in want.values()) / len(pairs))
    cells = metrics.confusion(counts).collect()
    assert len(cells) == 9 and sum(r["n"] for r in cells) == len(pairs)
    report = {r["label"]: tuple(r)[1:] for r in metrics.class_report(counts).collect()}
    assert report["accuracy"][0] == pytest.approx(acc) and report["macro avg"][2] == pytest.approx(macro)
    assert report["weighted avg"][2] == pytest.approx(weighted) and report["macro avg"][3] == len(pairs)


# --- temporal -----------------------------------------------------------------------------------

def scored(spark, data):
    return spark.createDataFrame(data, "submission_time timestamp_ntz, pred string, rating double")


def test_monthly_sentiment_boundary_and_denominators(spark):
    jan, feb = dt.datetime(2024, 1, 5), dt.datetime(2024, 2, 5)
    data = [(jan, "negative", 1.0)] * 50 + [(jan, "positive", None)] * 50 + [(jan, None, 5.0)] * 100 + [(feb, "neutral", 3.0)] * 99
    got = temporal.monthly_sentiment(scored(spark, data)).collect()
    assert [tuple(r) for r in got] == [(dt.date(2024, 1, 1), 0.0, 25.0, 100, pytest.approx(550 / 150))]


def test_monthly_truth_needs_twenty(spark, rows):
    data = [(dt.datetime(2024, 1, 5), "positive", 1.0)] * 20 + [(dt.datetime(2024, 2, 5), "positive", 1.0)] * 19
    df = scored(spark, data).withColumn("rating_sentiment", scores.rating_sentiment(F.col("rating")))
    assert rows(temporal.monthly_truth(df)) == [(dt.date(2024, 1, 1), 1.0, -1.0, 20)]


@pytest.mark.parametrize("before,kept", [(30, True), (29, False)])
def test_event_impact_needs_thirty_on_both_sides(spark, before, kept):
    event = dt.datetime(2024, 3, 16)
    data = ([(event - dt.timedelta(days=30), "negative", None)] * (before - 5) + [(event - dt.timedelta(seconds=1), None, None)] * 5
            + [(event, "positive", None)] * 29 + [(event + dt.timedelta(days=29, hours=23), "negative", None)]
            + [(event + dt.timedelta(days=30), "negative", None)] * 50)
    got = temporal.event_impact(scored(spark, data), tables.event_table(spark, [("2024-03-16", "e", "", "")])).collect()
    if not kept:
        assert got == []
        return
    r = got[0]
    assert (r.n_before, r.n_after, r.mean_sent_before) == (30, 30, -1.0)
    assert r.mean_sent_after == pytest.approx(28 / 30) and r.delta == pytest.approx(28 / 30 + 1)
    assert r.pct_negative_before == pytest.approx(2500 / 30) and r.pct_negative_after == pytest.approx(100 / 30)


def test_topic_tables_fill_zeros_and_name_the_unnamed(spark, rows):
    jan, apr = dt.datetime(2024, 1, 5), dt.datetime(2024, 4, 5)
    df = spark.createDataFrame([(jan, 0), (jan, 0), (apr, 1), (apr, 9)], "submission_time timestamp_ntz, dominant_topic int")
    got = rows(temporal.topic_month(df, 10, {0: "A", 1: "B", 2: "never"}), "year_month", "topic_name", "n")
    assert got == sorted([(jan.date().replace(day=1), "A", 2), (jan.date().replace(day=1), "B", 0),
                          (apr.date().replace(day=1), "A", 0), (apr.date().replace(day=1), "B", 1),
                          (jan.date().replace(day=1), "Topic 9", 0), (apr.date().replace(day=1), "Topic 9", 1)], key=repr)
    pct = rows(temporal.topic_quarter_pct(df, 10), "quarter", "dominant_topic", "n", "pct")
    assert pct == sorted([(dt.date(2024, 1, 1), t, n, n * 50.0) for t, n in ((0, 2), (1, 0), (9, 0))]
                         + [(dt.date(2024, 4, 1), t, n, n * 50.0) for t, n in ((0, 0), (1, 1), (9, 1))], key=repr)


def test_pivot_threshold(spark):
    cells = [("two", q, 0.0) for q in range(2)] + [("three", q, 0.5) for q in range(3)] + [("five", q, -0.5) for q in range(5)]
    df = spark.createDataFrame(cells, "category_keyword string, quarter int, mean_sentiment double")
    got = [tuple(r) for r in temporal.pivot_threshold(df).collect()]
    assert got == [("five", 5, -0.5), ("three", 3, 0.5)]  # 3 of 5 is exactly 0.6


def test_event_windows_are_pushed_to_the_scan(spark, tmp_path):
    days = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), "negative", float(i % 5)) for i in range(365)]
    path = str(tmp_path / "scored")
    spark.createDataFrame(days, "submission_time timestamp_ntz, pred string, rating double").write.parquet(path)
    events = tables.event_table(spark, [("2024-03-16", "e", "", ""), ("2024-04-01", "f", "", ""), ("2024-10-01", "g", "", "")])
    df = spark.read.parquet(path)
    near = joins.in_any_window(df, events)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(submission_time,2024-02-15" in plan and "LessThan(submission_time,2024-05-01" in plan
    assert near.count() == (dt.date(2024, 5, 1) - dt.date(2024, 2, 15)).days + 60
    assert temporal.event_impact(df, events, min_reviews=30).count() == 3
    assert joins.in_any_window(df, events.limit(0)).count() == 0


def test_many_event_dates_are_joined_not_listed(spark, rows, monkeypatch):
    """Ten thousand dates: no literal of the filter names one, and the rows are those of the short list's path."""
    first = dt.date(2000, 1, 1)
    events = tables.event_table(spark, [((first + dt.timedelta(days=3 * i)).isoformat(), f"e{i}", "", "") for i in range(10_000)])
    df = spark.createDataFrame([(dt.datetime(1999, 12, 1), 1), (dt.datetime(1999, 12, 2, 5), 2), (dt.datetime(2050, 1, 1), 3), (dt.datetime(2090, 1, 1), 4), (None, 5)],
                               "submission_time timestamp, n int")
    near = joins.in_any_window(df, events)
    assert "LeftSemi" in near._jdf.queryExecution().optimizedPlan().toString() and rows(near, "n") == [(2,), (3,)]
    few = events.filter("event_label IN ('e0', 'e6000')")
    listed = rows(joins.in_any_window(df, few), "n")
    monkeypatch.setattr(joins, "MOST_DATES", 1)
    assert rows(joins.in_any_window(df, few), "n") == listed
