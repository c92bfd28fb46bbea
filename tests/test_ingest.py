import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.operators import ranking
from gleaner.plans import jobs
from gleaner.session import scratch_path, shared_dir
from gleaner.sources import csv_files, responses, scan, sinks
from gleaner.streaming import incremental


def write_lines(path, records):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, f"part-{len(os.listdir(path))}.json"), "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in records)


SEARCH = [
    {"category_keyword": "milk", "page": 1, "controls": {"total_record_count": 3}, "products": [
        {"product_uid": "1", "name": "A", "brand": "b", "product_type": "t", "retail_price": {"price": 1.5},
         "reviews": {"total": 7, "average_rating": 4.5}},
        {"product_uid": "2", "name": "B", "reviews": None, "retail_price": None},
        {"product_uid": "3", "name": "C", "reviews": {"total": None}}]},
    {"category_keyword": "tea", "page": 1, "products": []},
    {"category_keyword": "tea", "page": 2, "products": [
        {"product_uid": "1", "name": "A again", "reviews": {"total": 9}},
        {"product_uid": "4", "name": "D", "reviews": {"total": 2}}]},
]

REVIEWS = [
    {"category_keyword": "milk", "page": 1, "TotalResults": 2, "Results": [
        {"Id": "r1", "ProductId": "1-P", "OriginalProductName": "A", "Rating": 5, "Title": "t", "ReviewText": "fine\nmilk",
         "SecondaryRatings": {"Quality": {"Value": 4}, "Value": {"Value": 3}}, "SubmissionTime": "2024-01-01T00:00:00Z",
         "UserNickname": "nick", "UserLocation": "here", "IsRecommended": True, "Helpfulness": 0.5, "IsSyndicated": False},
        {"Id": "r2", "ProductId": "1-P", "SecondaryRatings": {"Quality": {"Value": 2}}}]},
    {"category_keyword": "tea", "page": 1, "Results": [{"Id": "r3", "SecondaryRatings": None}]},
    {"category_keyword": "tea", "page": 2, "Results": []},
]


@pytest.fixture
def search(spark):
    path = scratch_path(spark, "search")
    write_lines(path, SEARCH)
    return responses.read_search_json(spark, path)


@pytest.fixture
def review_pages(spark):
    path = scratch_path(spark, "reviews")
    write_lines(path, REVIEWS)
    return responses.read_review_json(spark, path)


def test_flatten_search_is_null_safe(search, rows):
    got = rows(responses.flatten_search(search, ["page"]), "product_uid", "category_keyword", "price", "review_count", "position")
    assert got == sorted([("1", "milk", 1.5, 7.0, 0), ("2", "milk", None, 0.0, 1), ("3", "milk", None, 0.0, 2),
                          ("1", "tea", None, 9.0, 0), ("4", "tea", None, 2.0, 1)], key=repr)


def test_totals_have_defaults(search, review_pages, rows):
    assert rows(responses.search_total(search), "page", "total") == [(1, "3"), (1, "?"), (2, "?")]
    assert rows(responses.review_total(review_pages), "total") == [(0,), (0,), (2,)]


def test_discover_keeps_first_hit(search, rows):
    pos = F.when(F.col("category_keyword") == "milk", 0).otherwise(1)
    out = jobs.discover(search.withColumn("kw_pos", pos))
    assert out["products"].columns == schemas.PRODUCTS.fieldNames()
    assert rows(out["products"], "product_uid", "name", "review_count") == [("1", "A", 7.0), ("4", "D", 2.0)]
    assert [tuple(r) for r in out["summary"].collect()] == [("milk", 1, 7.0), ("tea", 1, 2.0)]
    assert tuple(out["totals"].first()) == (2, 9)


def test_flatten_reviews(review_pages, rows):
    flat = responses.flatten_reviews(review_pages)
    assert not set(schemas.PERSONAL_COLUMNS) & set(flat.columns)
    assert responses.flatten_reviews(review_pages, keep_personal=True).columns == schemas.REVIEWS_RAW.fieldNames()
    got = rows(flat, "review_id", "category_keyword", "rating", "rating_quality", "rating_value")
    assert got == [("r1", "milk", 5.0, 4.0, 3.0), ("r2", "milk", None, 2.0, None), ("r3", "tea", None, None, None)]


def test_json_profile_cuts_long_values(spark, rows):
    df = spark.createDataFrame([(1, json.dumps({"a": "x" * 81, "b": 5, "c": None}))], "id int, j string")
    assert rows(responses.json_profile(df, "j", ["id"])) == sorted(
        [(1, "a", "x" * 80 + "..."), (1, "b", "5"), (1, "c", None)], key=repr)
    assert responses.first_rows(spark.range(9), [F.desc("id")]).count() == 3


RAW = [
    # review_id, rating, title, text, submission_time
    ("a", 1.0, None, "good \"quoted\"\nline  two", "2023-01-01T00:00:00.000+00:00"),
    ("a", 5.0, "later copy", "second", "2023-05-01T00:00:00Z"),
    ("b", 2.5, "t\t t", "x" * 19, "2026-04-23T00:00:00Z"),
    ("c", 3.0, "t", "x" * 20, "2026-04-23T00:00:01Z"),
    ("d", 3.0, "t", "None", "2024-01-01T00:00:00Z"),
    ("e", 3.0, "t", "none", "2024-01-01T00:00:00Z"),
    ("f", 3.0, "t", " ", "2024-01-01T00:00:00Z"),
    ("g", 4.0, "t", "ok", "no date"),
    ("h", None, "t", "20 characters of it!", "2024-01-01T00:00:00Z"),
    (None, 4.0, "t", "null id one", "2024-01-01T00:00:00Z"),
    (None, 4.0, "t", "null id two", "2024-01-02T00:00:00Z"),
    ("i", 3.0, "old", "outside the window", "2020-01-01T00:00:00Z"),
    ("i", 3.0, "new", "inside the window", "2024-01-01T00:00:00Z"),
]


@pytest.fixture
def raw_csv(spark):
    path = scratch_path(spark, "raw_csv")
    cols = {f.name: f.dataType for f in schemas.REVIEWS_RAW}
    df = spark.createDataFrame(RAW, "review_id string, rating double, title string, text string, submission_time string").coalesce(1)
    df = df.select(*[F.col(c) if c in df.columns else F.lit("x" if c.startswith("user") else None).cast(t).alias(c)
                     for c, t in cols.items()])
    sinks.write_csv(df, path)
    return path


def test_csv_round_trip_and_missing_tokens(spark, raw_csv):
    df = csv_files.read_reviews_csv(spark, raw_csv)
    assert "user_nickname" not in df.columns
    assert "user_nickname" in csv_files.read_reviews_csv(spark, raw_csv, keep_personal=True).columns
    got = {(r.review_id, r.submission_time): (r.rating, r.title, r.text) for r in df.collect()}
    assert len(got) == len(RAW)
    for rid, stars, title, text, when in RAW:
        assert got[rid, when] == (stars, title, None if text == "None" else text)


def test_clean_boundaries_order_and_idempotence(spark, raw_csv, rows):
    raw = csv_files.read_reviews_csv(spark, raw_csv, file_order=True)
    out = jobs.clean(raw)
    got = {r.review_id: r for r in out.collect()}
    assert set(got) == {"a", "b", "e", "h", None, "i"}
    a = got["a"]
    assert (a.text, a.full_text, a.rating, a.rating_sentiment) == ('good "quoted" line two', '. good "quoted" line two', 1.0, "negative")
    assert (a.text_length_words, a.date, a.year_month, a.year) == (4, dt.date(2023, 1, 1), "2023-01", 2023)
    assert got["b"].is_short and got["b"].full_text.startswith("t t. x") and got["b"].rating_sentiment == "negative"
    assert not got["h"].is_short and got["h"].rating_sentiment is None
    assert got[None].text == "null id one" and got["i"].title == "new"
    assert set(schemas.CLEAN_ADDED) <= set(out.columns)
    again = jobs.clean(out.drop(*schemas.CLEAN_ADDED), [F.col("submission_time")])
    assert rows(again.select(*sorted(out.columns))) == rows(out.select(*sorted(out.columns)))


def test_clean_reports(spark, raw_csv):
    out = sinks.write_stage(jobs.clean(csv_files.read_reviews_csv(spark, raw_csv, file_order=True)), scratch_path(spark, "clean"))
    reports = jobs.clean_reports(out.withColumn("category_keyword", F.lit("k")).withColumn("product_id", F.lit("p")))
    s = reports["summary"].first()
    assert (s.reviews, s.products, s.categories, s.first_date) == (6, 1, 1, dt.date(2023, 1, 1))
    assert s.mean_rating == pytest.approx((1 + 2.5 + 3 + 4 + 3) / 5)
    for name, table in reports.items():
        assert table.count() >= 1, name
    assert reports["rating_share"].agg(F.sum("share")).first()[0] == pytest.approx(1.0)


def test_products_csv_coerces_counts(spark, rows):
    path = scratch_path(spark, "products")
    df = spark.createDataFrame([("1", "3"), ("2", "many"), ("3", None)], "product_uid string, review_count string")
    df = df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast("string").alias(f.name) for f in schemas.PRODUCTS])
    sinks.write_csv(df, path)
    assert rows(csv_files.read_products_csv(spark, path), "product_uid", "review_count") == [("1", 3.0), ("2", 0.0), ("3", 0.0)]


def test_append_and_overwrite(spark):
    path, one = scratch_path(spark, "csv"), spark.createDataFrame([(1, "a")], "i int, s string")
    schema = schemas.struct(i="int", s="string")
    for _ in range(2):
        sinks.append_csv(one, path)
    sinks.append_csv(one.limit(0), path)
    assert csv_files.read_csv(spark, path, schema).count() == 2
    sinks.write_csv(one, path)
    assert csv_files.read_csv(spark, path, schema).collect() == one.collect()
    assert sinks.project_existing(one, ["s", "zzz", "i"]).columns == ["s", "i"]


def test_keep_first_uses_file_order(spark):
    path = scratch_path(spark, "ordered")
    for i in range(3):
        spark.createDataFrame([(f"r{j}", i * 10 + j) for j in range(5)], "k string, v int").coalesce(1).write.mode("append").csv(
            f"{path}/day={i}", header=True)
    df = csv_files.read_csv(spark, f"{path}/day=*", schemas.struct(k="string", v="int"), file_order=True)
    got = ranking.keep_first(df, ["k"], [F.col(c) for c in csv_files.INGEST_ORDER])
    assert sorted(r["v"] for r in got.collect()) == [0, 1, 2, 3, 4]


def test_first_append_wins_every_time(spark):
    schema = schemas.struct(k="string", v="int")
    for _ in range(5):
        path = scratch_path(spark, "appends")
        for batch, v in enumerate((10, 20, 30)):
            sinks.append_csv(spark.createDataFrame([("a", v), (f"b{v}", v)], schema), path, batch)
        df = csv_files.read_csv(spark, path, schema, file_order=True)
        got = ranking.keep_first(df, ["k"], [F.col(c) for c in csv_files.INGEST_ORDER])
        assert {r["k"]: r["v"] for r in got.collect()} == {"a": 10, "b10": 10, "b20": 20, "b30": 30}


def test_dedup_keeps_unseen_ids_of_any_date(spark):
    landing, out, check = (scratch_path(spark, n) for n in ("landing", "unique", "progress"))
    schema = spark.createDataFrame([], "review_id string, submission_time timestamp_ntz, v int").schema
    day = lambda y, m, d: dt.datetime(y, m, d)
    drops = [[("a", day(2026, 4, 1), 1), ("b", day(2023, 1, 5), 1), ("b", day(2023, 1, 5), 2)],
             [("c", day(2026, 4, 2), 1), ("d", day(2023, 2, 1), 1), ("e", day(2025, 1, 1), 1), ("a", day(2024, 1, 1), 9)], []]
    for rows in drops:
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        table = incremental.dedup(incremental.file_stream(spark, landing, schema, "parquet"), out, check, [F.col("v")])
    assert sorted((r["review_id"], r["v"]) for r in table.collect()) == [(x, 1) for x in "abcde"]
    with pytest.raises(ValueError):
        incremental.dedup(incremental.file_stream(spark, landing, schema, "parquet"), out, check + "-lost", [F.col("v")])


def test_a_scan_is_dealt_out_only_when_asked(spark):
    path = scratch_path(spark, "small")
    spark.range(10).coalesce(1).write.parquet(path)
    assert scan.read_table(spark, path, 8).rdd.getNumPartitions() == 8
    assert scan.read_table(spark, path).rdd.getNumPartitions() < 8


def test_shared_dir_comes_from_the_session(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_dir(spark) == (configured.rstrip("/") if configured else shared_dir(spark))


# --- incremental --------------------------------------------------------------------------------

def test_incremental_ingest_never_reads_a_file_twice(spark, rows):
    landing, out, check = (scratch_path(spark, n) for n in ("landing", "out", "progress"))
    schema = responses.with_keyword(schemas.REVIEW_RESPONSE)
    counts = []
    for batch in (REVIEWS[:1], REVIEWS[1:], None):
        if batch:
            write_lines(landing, batch)
        table = incremental.ingest(spark, landing, schema, responses.flatten_reviews, out, check)
        counts.append(table.count())
    assert counts == [2, 3, 3]
    batch = responses.flatten_reviews(spark.read.schema(schema).json(landing))
    assert rows(table.select(*batch.columns)) == rows(batch)


def test_stream_dedup_equals_batch(spark, rows):
    landing, out, check = (scratch_path(spark, n) for n in ("landing", "out", "progress"))
    t = dt.datetime(2024, 1, 1)
    for ids in (["a", "b", "a"], ["b", "c"]):
        df = spark.createDataFrame([(i, t) for i in ids], "review_id string, submission_time timestamp_ntz")
        df.write.mode("append").parquet(landing)
        incremental.dedup(incremental.file_stream(spark, landing, df.schema, "parquet"), out, check, [F.col("submission_time")])
    assert rows(spark.read.parquet(out), "review_id") == [("a",), ("b",), ("c",)]


def test_monthly_refresh_equals_batch(spark, rows):
    from gleaner.operators.temporal import monthly_sentiment
    landing, store, check = (scratch_path(spark, n) for n in ("landing", "store", "progress"))
    for day, pred in ((1, "negative"), (20, "positive"), (25, None)):
        data = [(dt.datetime(2024, 1 + i % 2, day), pred, float(i % 5) or None) for i in range(12)]
        df = spark.createDataFrame(data, "submission_time timestamp_ntz, pred string, rating double")
        df.write.mode("append").parquet(landing)
        incremental.refresh_monthly(incremental.file_stream(spark, landing, df.schema, "parquet", 1), store, check)
    want = monthly_sentiment(spark.read.parquet(landing), 5)
    assert rows(incremental.read_monthly(spark, store, 5)) == rows(want) and want.count() == 2
