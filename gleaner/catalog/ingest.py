"""Queries over product hits, landed JSON responses, CSV round trips and incremental runs."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from gleaner import constants as K, schemas
from gleaner.catalog.registry import query, rounded
from gleaner.catalog.reviews import MONTHLY_SQL
from gleaner.catalog.views import ORDER, hits, order_columns, r1, r1s, r2, table, with_views
from gleaner.functions import scores
from gleaner.operators import aggregates, filters, ranking
from gleaner.plans import jobs
from gleaner.session import scratch_path
from gleaner.sources import csv_files, paged, requests, responses, sinks
from gleaner.streaming import incremental

# --- product hits -------------------------------------------------------------------------------

HIT_COLUMNS = "product_uid, category_keyword, price, review_count, kw_pos"


@query("flt_min_reviews", with_views("p", f"SELECT {HIT_COLUMNS} FROM p WHERE review_count >= 5"))
def flt_min_reviews(spark, sf):
    return filters.min_reviews(hits(spark, sf), 5).select(*HIT_COLUMNS.split(", "))


@query("win_dedup_products", with_views("p", f"""
SELECT {HIT_COLUMNS} FROM p QUALIFY row_number() OVER (PARTITION BY product_uid ORDER BY kw_pos) = 1"""))
def win_dedup_products(spark, sf):
    return ranking.keep_first(hits(spark, sf), ["product_uid"], [F.col("kw_pos")]).select(*HIT_COLUMNS.split(", "))


@query("agg_product_summary", with_views("p", """
SELECT category_keyword, count(product_uid) AS product_count, CAST(sum(review_count) AS BIGINT) AS total_reviews
FROM p WHERE review_count > 0 GROUP BY 1"""))
def agg_product_summary(spark, sf):
    return aggregates.product_summary(filters.min_reviews(hits(spark, sf), 1))


@query("agg_total_reviews", with_views("p", """
SELECT count(*) AS products, CAST(sum(review_count) AS BIGINT) AS reviews_available FROM p WHERE review_count > 0"""))
def agg_total_reviews(spark, sf):
    return aggregates.total_reviews(filters.min_reviews(hits(spark, sf), 1))


@query("set_union_all", with_views("p", """
SELECT product_uid, category_keyword, review_count FROM p WHERE kw_pos = 1
UNION ALL SELECT product_uid, category_keyword, review_count FROM p WHERE kw_pos = 2"""))
def set_union_all(spark, sf):
    p = hits(spark, sf).select("product_uid", "category_keyword", "review_count", "kw_pos")
    first, second = (p.filter(F.col("kw_pos") == i).drop("kw_pos") for i in (1, 2))
    return first.unionByName(second)


@query("src_search_plan", with_views("p", """
SELECT category_keyword, CAST(page AS INTEGER) AS page, 60 AS page_size
FROM (SELECT DISTINCT category_keyword FROM p) CROSS JOIN (SELECT unnest(range(1, 3)) AS page)"""))
def src_search_plan(spark, sf):
    return requests.search_plan(hits(spark, sf).select("category_keyword").distinct())


@query("src_search_stop", with_views("p", """
, pages AS (SELECT category_keyword, CAST(product_uid // 60 AS BIGINT) AS page, count(*) AS n FROM p GROUP BY 1, 2),
short AS (SELECT *, min(CASE WHEN n < 8 THEN page END) OVER (PARTITION BY category_keyword) AS first_short FROM pages)
SELECT category_keyword, page, n FROM short WHERE first_short IS NULL OR page <= first_short"""))
def src_search_stop(spark, sf):
    pages = hits(spark, sf).groupBy("category_keyword", F.floor(F.col("product_uid") / 60).alias("page")).agg(
        F.count(F.lit(1)).alias("n"))
    return requests.keep_until_short_page(pages, 8).select("category_keyword", "page", "n")


def plan_sql(source: str, most: int, size: int) -> str:
    return f"""
SELECT product_uid, category_keyword, cap, CAST(o AS INTEGER) AS "offset", least({size}, cap - CAST(o AS INTEGER)) AS "limit"
FROM (SELECT *, unnest(range(0, cap, {size})) AS o FROM (
  SELECT *, CAST(least({most}, review_count) AS INTEGER) AS cap FROM {source}) WHERE cap > 0)"""


PLAN_COLUMNS = ["product_uid", "category_keyword", "cap", "offset", "limit"]


@query("src_harvest_plan", with_views("p", plan_sql("p", 20, 8)))
def src_harvest_plan(spark, sf):
    return requests.harvest_plan(hits(spark, sf), 20, 8).select(*PLAN_COLUMNS)


@query("pipe_harvest", with_views("p r1", """
, todo AS (SELECT * FROM p WHERE review_count >= 5 AND NOT EXISTS (
  SELECT 1 FROM r1 WHERE submission_time < TIMESTAMP '1995-04-01'
    AND replace(product_id, '-P', '') = CAST(product_uid AS VARCHAR)))""" + plan_sql("todo", K.MAX_REVIEWS_PER_PRODUCT, K.REVIEW_REQUEST_SIZE)))
def pipe_harvest(spark, sf):
    done = r1(spark, sf).filter(F.col("submission_time") < F.lit("1995-04-01").cast("timestamp_ntz"))
    return jobs.harvest(hits(spark, sf), done).select(*PLAN_COLUMNS)


# --- landed JSON --------------------------------------------------------------------------------

def search_responses(spark, sf):
    """Search responses as JSON text, one per keyword and page of at most sixty products.

    Hits without reviews lack the reviews object, large parts lack a price.
    """
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("product_uid"), "p_brand", "p_type", "p_size")
    p = hits(spark, sf).join(part, "product_uid")
    product = F.struct(
        F.col("product_uid").cast("string").alias("product_uid"), "name", F.col("p_brand").alias("brand"),
        F.col("p_type").alias("product_type"),
        F.when(F.col("p_size") < 40, F.struct("price")).alias("retail_price"),
        F.when(F.col("review_count") > 0, F.struct(
            F.col("review_count").alias("total"), (F.col("p_size") / 10).alias("average_rating"))).alias("reviews"))
    page = F.floor(F.col("product_uid") / 60).cast("int").alias("page")
    grouped = p.groupBy("kw_pos", "category_keyword", page).agg(
        F.array_sort(F.collect_list(F.struct(F.col("product_uid").alias("at"), product.alias("p")))).alias("l"))
    # At most sixty products each, as product keys are unique.
    body = F.to_json(F.struct(
        F.transform("l", lambda x: x["p"]).alias("products"),
        F.struct(F.when(F.col("kw_pos") == 1, F.size("l")).alias("total_record_count")).alias("controls")))
    return responses.parse_text(grouped, body, schemas.SEARCH_RESPONSE, ["kw_pos", "category_keyword", "page"])


SEARCH_SQL = """
, flat AS (
  SELECT CAST(product_uid AS VARCHAR) AS product_uid, name, category_keyword,
         CASE WHEN p_size < 40 THEN p.price END AS price, CAST(review_count AS DOUBLE) AS review_count,
         CASE WHEN review_count > 0 THEN p_size / 10 END AS average_rating, p_brand AS brand,
         p_type AS product_type, kw_pos, CAST(product_uid // 60 AS INTEGER) AS page, p.product_uid AS uid
  FROM p JOIN part ON p.product_uid = p_partkey)"""
PRODUCT_FIELDS = ", ".join(schemas.PRODUCTS.fieldNames())


@query("src_search_json", with_views("p", SEARCH_SQL + f"""
SELECT {PRODUCT_FIELDS}, page,
       CAST(row_number() OVER (PARTITION BY kw_pos, category_keyword, page ORDER BY uid) - 1 AS INTEGER) AS position
FROM flat"""))
def src_search_json(spark, sf):
    return responses.flatten_search(search_responses(spark, sf), ["page"])


@query("pipe_discover", with_views("p", SEARCH_SQL + f"""
SELECT {PRODUCT_FIELDS} FROM (
  SELECT * FROM flat QUALIFY row_number() OVER (PARTITION BY product_uid ORDER BY kw_pos, page, uid) = 1)
WHERE review_count > 0"""))
def pipe_discover(spark, sf):
    return jobs.discover(search_responses(spark, sf))["products"]


#: Neighbouring pages of a search that share a folder, so that a request reads one small folder however many pages there are.
FOLDER_PAGES = 50


def land_pages(pages, path):
    """Write search pages (category_keyword, page, body) where ``landed_fetch`` finds them; returns the keywords and pages."""
    folders = {"keyword_md5": F.md5("category_keyword"), "folder": F.floor(F.col("page") / FOLDER_PAGES)}
    return sinks.write_stage(pages.withColumns(folders), path, list(folders)).select("category_keyword", "page")


def landed_fetch(path):
    """A fetch function over landed search pages: the stored body of the asked page, or that of a page without hits."""
    def fetch(request):
        import hashlib

        import pyarrow.dataset as ds
        keyword, page = request["category_keyword"], request["page"]
        if keyword is None:
            return "{}"
        folder = f"{path}/keyword_md5={hashlib.md5(keyword.encode()).hexdigest()}/folder={page // FOLDER_PAGES}"
        try:
            found = ds.dataset(folder, format="parquet")
        except FileNotFoundError:
            return "{}"
        cond = (ds.field("category_keyword") == keyword) & (ds.field("page") == page)
        found = found.to_table(columns=["body"], filter=cond).column(0).to_pylist()
        return found[0] if found else "{}"
    return fetch


@query("src_paged_search", with_views("p", SEARCH_SQL + f"""
, paged AS (SELECT *, row_number() OVER (PARTITION BY category_keyword ORDER BY uid) - 1 AS rn FROM flat WHERE kw_pos = 1)
SELECT {PRODUCT_FIELDS}, CAST(rn // 60 + 1 AS INTEGER) AS page, CAST(rn % 60 AS INTEGER) AS position FROM paged"""))
def src_paged_search(spark, sf):
    """The first search, page by page: each keyword is asked for pages until one is short, out of a plan that goes on."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("product_uid"), "p_brand", "p_type", "p_size")
    p = hits(spark, sf).filter("kw_pos = 1").join(part, "product_uid")
    rank = F.row_number().over(Window.partitionBy("category_keyword").orderBy("product_uid")) - 1
    product = F.struct(
        F.col("product_uid").cast("string").alias("product_uid"), "name", F.col("p_brand").alias("brand"), F.col("p_type").alias("product_type"),
        F.when(F.col("p_size") < 40, F.struct("price")).alias("retail_price"),
        F.when(F.col("review_count") > 0, F.struct(F.col("review_count").alias("total"), (F.col("p_size") / 10).alias("average_rating"))).alias("reviews"))
    pages = p.withColumn("rn", rank).groupBy("category_keyword", (F.floor(F.col("rn") / 60) + 1).cast("int").alias("page")).agg(
        F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("rn", product.alias("p")))), lambda x: x["p"]).alias("products"))).alias("body"))
    path = scratch_path(spark, "landed-search")
    landed = land_pages(pages, path)
    last = landed.agg(F.max("page")).first()[0] or 0
    plan = requests.search_plan(landed.select("category_keyword").distinct(), last + 3)
    asked = sinks.write_stage(paged.search_pages(plan, landed_fetch(path)), scratch_path(spark, "pages"))
    return responses.flatten_search(paged.search_responses(asked), ["page"])


def review_responses(spark, sf):
    """Review responses: per product type, the reviews among one hundred neighbouring rows.

    A response holds at most one hundred reviews whatever the keys of the table look like.
    """
    df = r1(spark, sf, rating=True, product=True, numbered=True)
    # Reviews are built after the shuffle, from the columns that tell them apart.
    columns = ["product_name", "rating", "submission_time", *ORDER[:5], "l_discount", "l_tax", "l_returnflag", "l_linestatus"]

    def review(r):
        secondary = F.when(r["l_returnflag"] != "N", F.struct(
            F.struct(r["l_quantity"].alias("Value")).alias("Quality"),
            F.when(r["l_returnflag"] == "A", F.struct(r["l_tax"].alias("Value"))).alias("Value")))
        return F.struct(
            F.concat_ws("/", *[r[c] for c in ORDER[:4]]).alias("Id"), F.concat(r["l_partkey"].cast("string"), F.lit("-P")).alias("ProductId"),
            r["product_name"].alias("OriginalProductName"), r["rating"].cast("bigint").alias("Rating"),
            secondary.alias("SecondaryRatings"), r["product_name"].alias("Title"),
            F.concat_ws(" ", r["product_name"], F.lit("was"), r["l_linestatus"]).alias("ReviewText"),
            F.date_format(r["submission_time"], "yyyy-MM-dd'T'HH:mm:ss").alias("SubmissionTime"),
            F.lit("someone").alias("UserNickname"), F.lit("somewhere").alias("UserLocation"),
            (r["l_linestatus"] == "O").alias("IsRecommended"), r["l_discount"].alias("Helpfulness"),
            F.when(r["l_linestatus"] == "F", r["l_linestatus"]).alias("CampaignId"),
            (r["l_suppkey"] > 50).alias("IsSyndicated"))

    grouped = df.groupBy("category_keyword", F.floor(F.col("row_no") / 100).alias("chunk")).agg(
        F.collect_list(F.struct(*columns)).alias("_rows"))
    grouped = grouped.select("category_keyword", F.transform("_rows", review).alias("Results"))
    body = F.to_json(F.struct("Results", F.size("Results").alias("TotalResults")))
    return responses.parse_text(grouped, body, schemas.REVIEW_RESPONSE, ["category_keyword"])


REVIEWS_SQL = """
SELECT concat(l_orderkey, '/', l_linenumber, '/', l_partkey, '/', l_suppkey) AS review_id, product_id,
       product_name, category_keyword, rating,
       CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS rating_quality,
       CASE WHEN l_returnflag = 'A' THEN l_tax END AS rating_value, product_name AS title,
       concat(product_name, ' was ', l_linestatus) AS text,
       strftime(submission_time, '%Y-%m-%dT%H:%M:%S') AS submission_time, l_linestatus = 'O' AS is_recommended,
       l_discount AS helpfulness, CASE WHEN l_linestatus = 'F' THEN 'F' END AS campaign_id,
       l_suppkey > 50 AS is_syndicated FROM r1"""


@query("src_review_json", with_views("r1", REVIEWS_SQL))
def src_review_json(spark, sf):
    return responses.flatten_reviews(review_responses(spark, sf))


@query("src_page_totals", with_views("p r1", """
SELECT 'search' AS source, category_keyword, CAST(product_uid // 60 AS INTEGER) AS page,
       CASE WHEN kw_pos = 1 THEN CAST(count(*) AS VARCHAR) ELSE '?' END AS total FROM p GROUP BY kw_pos, 2, 3
UNION ALL
SELECT 'reviews', category_keyword, CAST(l_orderkey // 16 AS INTEGER),
       CASE WHEN count(*) > 5 THEN CAST(count(*) AS VARCHAR) ELSE '0' END FROM r1 GROUP BY 2, 3"""))
def src_page_totals(spark, sf):
    search = responses.search_total(search_responses(spark, sf)).select(
        F.lit("search").alias("source"), "category_keyword", "page", "total")
    # Only the counters of the review responses: one per product type and run of sixteen orders.
    page = F.floor(F.col("l_orderkey") / 16).cast("int").alias("page")
    counters = r1(spark, sf, product=True).groupBy("category_keyword", page).agg(F.count(F.lit(1)).alias("n"))
    body = F.to_json(F.struct(F.when(F.col("n") > 5, F.col("n")).alias("TotalResults")))
    counters = responses.parse_text(counters, body, schemas.REVIEW_RESPONSE, ["category_keyword", "page"])
    reviews = responses.review_total(counters).select(
        F.lit("reviews").alias("source"), "category_keyword", "page", F.col("total").cast("string").alias("total"))
    return search.unionByName(reviews)


@query("src_json_profile", """
SELECT doc_id, field, CASE WHEN length(v) > 80 THEN concat(substr(v, 1, 80), '...') ELSE v END AS display FROM (
  SELECT doc_id, 'doc_id' AS field, CAST(doc_id AS VARCHAR) AS v FROM documents
  UNION ALL SELECT doc_id, 'lang', lang FROM documents UNION ALL SELECT doc_id, 'text', text FROM documents)
UNION ALL SELECT event_id, 'k', CAST(json_extract(props, '$.k') AS VARCHAR) FROM events""")
def src_json_profile(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", "text")).alias("record"))
    events = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("record"))
    return responses.json_profile(docs.unionByName(events), "record", ["doc_id"])


@query("prj_numeric_coerce", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE value END AS value,
       CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events""")
def prj_numeric_coerce(spark, sf):
    # Errors carry text instead of a number; it must count as 0.
    raw = F.when(F.col("event_type") == "error", F.lit("no number")).otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select(
        "event_id", scores.number_or_zero(raw).alias("value"),
        scores.number_or_zero(F.get_json_object("props", "$.k")).alias("k"))


# --- CSV round trips ----------------------------------------------------------------------------

TEXT_FIELDS = ["review_id", "product_id", "category_keyword", "rating", "title", "text", "submission_time"]


_REVIEWS_CSV_SQL = with_views("r2", """
SELECT review_id, product_id, category_keyword, rating, title, text,
       strftime(submission_time, '%Y-%m-%dT%H:%M:%S') AS submission_time FROM r2""")


def _reviews_csv(spark, sf):
    path = scratch_path(spark, "reviews_csv")
    raw = r2(spark, sf).withColumn("submission_time", F.date_format("submission_time", "yyyy-MM-dd'T'HH:mm:ss"))
    fields = [F.col(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name)
              for f in schemas.REVIEWS_RAW]
    sinks.write_csv(raw.select(*fields), path)
    return path


@query("src_reviews_csv", _REVIEWS_CSV_SQL)
def src_reviews_csv(spark, sf):
    return csv_files.read_reviews_csv(spark, _reviews_csv(spark, sf)).select(*TEXT_FIELDS)


@query("src_reviews_csv_split", _REVIEWS_CSV_SQL)
def src_reviews_csv_split(spark, sf):
    """The same files, each read by several tasks."""
    return csv_files.read_reviews_csv(spark, _reviews_csv(spark, sf), split=True).select(*TEXT_FIELDS)


@query("src_products_csv", with_views("p", """
SELECT CAST(product_uid AS VARCHAR) AS product_uid, name, category_keyword, price,
       CASE WHEN review_count > 0 THEN review_count ELSE 0 END::DOUBLE AS review_count FROM p"""))
def src_products_csv(spark, sf):
    path = scratch_path(spark, "products_csv")
    # Products without reviews are written with a text in place of the number.
    p = hits(spark, sf).withColumn("review_count", F.when(
        F.col("review_count") > 0, F.col("review_count").cast("string")).otherwise("unknown"))
    sinks.write_csv(p.select("product_uid", "name", "category_keyword", "price", "review_count",
                             *[F.lit(None).cast("string").alias(c) for c in
                               ("average_rating", "brand", "product_type")]), path)
    return csv_files.read_products_csv(spark, path).select(
        "product_uid", "name", "category_keyword", "price", "review_count")


_HIT_SCHEMA = schemas.struct(product_uid="bigint", name="string", category_keyword="string", price="double",
                             review_count="bigint", kw_pos="int")


@query("snk_csv_overwrite", with_views("p", f"SELECT {HIT_COLUMNS}, name FROM p"))
def snk_csv_overwrite(spark, sf):
    path = scratch_path(spark, "hits_csv")
    p = hits(spark, sf)
    sinks.write_csv(p.filter(F.col("kw_pos") == 2), path)
    sinks.write_csv(p, path)
    return csv_files.read_csv(spark, path, _HIT_SCHEMA)


@query("snk_csv_append", with_views("p", f"SELECT {HIT_COLUMNS}, name FROM p"))
def snk_csv_append(spark, sf):
    path = scratch_path(spark, "hits_csv")
    p = hits(spark, sf)
    for i in (1, 2, 3):
        sinks.append_csv(p.filter(F.col("kw_pos") == i), path)
    return csv_files.read_csv(spark, path, _HIT_SCHEMA)


@query("snk_ordered_append", with_views("r1", f"""
SELECT review_id, l_suppkey % 3 AS part, l_partkey FROM r1
QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY (l_suppkey + 1) % 3, {', '.join(ORDER)}) = 1"""))
def snk_ordered_append(spark, sf):
    """Three numbered appends: of the copies of an id the one appended first stays."""
    path = scratch_path(spark, "ordered_csv")
    rows = r1(spark, sf).select("review_id", (F.col("l_suppkey") % 3).alias("part"), "l_partkey", *order_columns())
    rows = rows.select("review_id", "part", *ORDER)
    for batch, part in enumerate((2, 0, 1)):
        sinks.append_csv(rows.filter(F.col("part") == part), path, batch)
    back = csv_files.read_csv(spark, path, rows.schema, file_order=True)
    order = [F.col(csv_files.BATCH_COLUMN), *order_columns()]
    return ranking.keep_first(back, ["review_id"], order).select("review_id", "part", "l_partkey")


# --- incremental runs ---------------------------------------------------------------------------

def _land_in_two(df, late, path, fmt):
    """The rows land in two drops; work resumes after each, and once more with nothing new. They land compressed."""
    options = {"compression": "gzip" if fmt == "json" else "zstd"}
    for part in (df.filter(~late), df.filter(late)):
        part.write.mode("append").format(fmt).options(**options).save(path)
        yield
    yield


def _landed_responses(spark, sf):
    """Review responses as stored: both drops come from them, so that the joins run once."""
    return sinks.write_stage(review_responses(spark, sf), scratch_path(spark, "responses"), compression="zstd")


def _ingest(spark, sf, fmt):
    landing, out, check = (scratch_path(spark, n) for n in ("landing", "reviews", "progress"))
    schema = responses.with_keyword(schemas.REVIEW_RESPONSE)
    for _ in _land_in_two(_landed_responses(spark, sf), F.col("category_keyword") < "M", landing, fmt):
        incremental.ingest(spark, landing, schema, responses.flatten_reviews, out, check, fmt)
    return spark.read.parquet(out).drop("ingest_batch")


@query("st_incremental_ingest", with_views("r1", REVIEWS_SQL))
def st_incremental_ingest(spark, sf):
    return _ingest(spark, sf, "json")


@query("snk_committed", with_views("r1", REVIEWS_SQL))
def snk_committed(spark, sf):
    """Two batches, and the remains of a third whose writer was killed before its end."""
    landing, out, check = (scratch_path(spark, n) for n in ("landing", "reviews", "progress"))
    schema = responses.with_keyword(schemas.REVIEW_RESPONSE)
    for _ in _land_in_two(_landed_responses(spark, sf), F.col("category_keyword") < "M", landing, "parquet"):
        incremental.ingest(spark, landing, schema, responses.flatten_reviews, out, check, "parquet")
    first = incremental.read_committed(spark, out).filter("ingest_batch = 0").drop("ingest_batch")
    first.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{out}/ingest_batch=99")
    return incremental.read_committed(spark, out).drop("ingest_batch")


@query("snk_incremental", with_views("r1", f"""
SELECT product_id, count(*) AS n FROM ({REVIEWS_SQL}) GROUP BY 1"""))
def snk_incremental(spark, sf):
    return aggregates.value_counts(_ingest(spark, sf, "parquet"), "product_id")


_DEDUP_SQL = with_views("r1", f"""
SELECT review_id, l_suppkey FROM r1
QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY l_suppkey % 2 = 0, {', '.join(ORDER)}) = 1""")


def _dedup(spark, sf, run):
    landing, out, check = (scratch_path(spark, n) for n in ("landing", "unique", "progress"))
    rows = r1(spark, sf)
    # Both drops hold rows of all years.
    for _ in _land_in_two(rows, F.col("l_suppkey") % 2 == 0, landing, "parquet"):
        run(incremental.file_stream(spark, landing, rows.schema, "parquet"), out, check, order_columns())
    return spark.read.parquet(out).select("review_id", "l_suppkey")


@query("st_dedup", _DEDUP_SQL)
def st_dedup(spark, sf):
    return _dedup(spark, sf, incremental.dedup)


@query("st_dedup_indexed", _DEDUP_SQL)
def st_dedup_indexed(spark, sf):
    return _dedup(spark, sf, incremental.dedup_indexed)


@query("st_monthly_refresh", MONTHLY_SQL)
def st_monthly_refresh(spark, sf):
    landing, store, check = (scratch_path(spark, n) for n in ("landing", "partials", "progress"))
    rows = r1s(spark, sf, rating=True).select("pred", "rating", "submission_time", "l_linestatus")
    for _ in _land_in_two(rows, F.col("l_linestatus") == "O", landing, "parquet"):
        incremental.refresh_monthly(incremental.file_stream(spark, landing, rows.schema, "parquet"), store, check)
    return rounded(incremental.read_monthly(spark, store, 100), "mean_sentiment", "pct_negative", "mean_rating")
