"""Stand-in review tables made from the given tables, as DataFrames and as SQL.

R1   numeric reviews      lineitem, orders, part      R2  text reviews   documents
R1S  R1 with logits, classes and probabilities        P   product hits   part, lineitem
EV   events joined with R1 by date
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.operators.scoring import add_class_columns
from gleaner.functions.scores import rating_sentiment
from gleaner.sources.scan import read_table
from gleaner.sources.tables import event_table

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
         "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

EVENT_ROWS = [
    ("1995-01-03", "a"), ("1996-03-31", "b"), ("1996-04-11", "c"), ("1998-08-24", "e"),
    ("2000-03-16", "f"), ("2001-06-30", "g"), ("2030-01-01", "z"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Text tables that come in fewer parts than there are cores are dealt out."""
    texts = name in ("documents", "pages")
    return read_table(spark, f"{sf_dir}/{name}.parquet", spark.sparkContext.defaultParallelism if texts else None)


def r1(spark: SparkSession, sf_dir: str, rating: bool = False, product: bool = False,
       numbered: bool = False) -> DataFrame:
    """Reviews. ``rating`` and ``product`` add the joins that bring these columns; ``numbered``
    adds a row number given at the scan, where it is the same whenever a task is run again."""
    df = table(spark, sf_dir, "lineitem")
    if numbered:
        df = df.withColumn("row_no", F.monotonically_increasing_id())
    if rating:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if product:
        part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
        df = df.join(part, F.col("l_partkey") == F.col("p_partkey"))
    columns = [
        (F.col("l_orderkey") - F.col("l_linenumber")).alias("review_id"),
        F.concat(F.col("l_partkey").cast("string"), F.lit("-P")).alias("product_id"),
        F.col("l_shipdate").alias("submission_time"),
        (F.col("l_suppkey") % 5).cast("int").alias("dominant_topic"), *ORDER]
    if rating:
        stars = F.substring("o_orderpriority", 1, 1).cast("double")
        columns.append(F.when(F.col("l_linenumber") != 7, stars).alias("rating"))
    if numbered:
        columns.append(F.col("row_no"))
    if product:
        columns += [F.col("p_name").alias("product_name"), F.col("p_type").alias("category_keyword")]
    return df.select(*columns)


def order_columns() -> list:
    return [F.col(c) for c in ORDER]


def with_scores(df: DataFrame) -> DataFrame:
    """Logits from discount, tax and quantity, then the class columns."""
    logits = [F.col("l_discount") * 60, F.col("l_tax") * 75, F.col("l_quantity") / 8]
    out = add_class_columns(df.withColumns(dict(zip(["z0", "z1", "z2"], logits))),
                            F.col("z0"), F.col("z1"), F.col("z2"))
    out = out.withColumn("topic_probability", F.col("confidence"))
    if "rating" in df.columns:
        out = out.withColumn("rating_sentiment", rating_sentiment(F.col("rating")))
    return out


def r1s(spark: SparkSession, sf_dir: str, rating: bool = False, product: bool = False) -> DataFrame:
    return with_scores(r1(spark, sf_dir, rating, product))


def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text reviews: copies of a text share an id, one-word texts stand for missing or blank ones."""
    d = table(spark, sf_dir, "documents")
    text = F.when(F.col("n_chars") >= 10, F.col("text")).when(F.col("n_chars") >= 6, "  ")
    return d.select(
        F.md5("text").alias("review_id"), F.col("doc_id").alias("seq"),
        F.col("source").alias("product_id"), F.col("source").alias("product_name"),
        F.col("lang").alias("category_keyword"),
        (F.col("n_chars") % 5 + 1).cast("double").alias("rating"),
        F.when(F.col("lang") != "de", F.concat(F.lit(" "), "source", F.lit("\n"), "lang")).alias("title"),
        text.alias("text"),
        (F.lit(dt.datetime(2022, 12, 1)).cast("timestamp_ntz")
         + F.make_dt_interval((F.col("doc_id") % 1300).cast("int"))).alias("submission_time"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product hits of two searches; advertised reviews are the line items beyond twenty."""
    part = table(spark, sf_dir, "part")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    both = part.withColumn("kw_pos", F.lit(1)).withColumn("category_keyword", F.col("p_type")).unionByName(
        part.filter(F.col("p_size") < 25).withColumn("kw_pos", F.lit(2))
        .withColumn("category_keyword", F.col("p_brand")))
    return both.join(lines, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("p_partkey").alias("product_uid"), F.col("p_name").alias("name"), "category_keyword",
        F.col("p_retailprice").alias("price"),
        F.greatest(F.coalesce("n", F.lit(0)) - 20, F.lit(0)).alias("review_count"), "kw_pos")


def events(spark: SparkSession) -> DataFrame:
    rows = [(d, label, None, None) for d, label in EVENT_ROWS]
    return event_table(spark, rows).select("event_date", "event_label")


# --- the same views in SQL ----------------------------------------------------------------------

_R1 = f"""r1 AS (
  SELECT l_orderkey - l_linenumber AS review_id, concat(l_partkey, '-P') AS product_id,
         p_name AS product_name, p_type AS category_keyword,
         CASE WHEN l_linenumber <> 7 THEN CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) END AS rating,
         l_shipdate AS submission_time, CAST(l_suppkey % 5 AS INTEGER) AS dominant_topic,
         {', '.join(ORDER)}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

_SENT = """CASE WHEN trunc({0}) <= 2 THEN 'negative' WHEN trunc({0}) = 3 THEN 'neutral'
                WHEN {0} IS NOT NULL THEN 'positive' END"""


def classes_sql(name: str, source: str) -> str:
    """CTEs that add class columns to a source with z0, z1, z2."""
    return f"""{name}_e AS (
  SELECT *, greatest(z0, z1, z2) AS zmax FROM {source}),
{name}_p AS (
  SELECT *, CASE WHEN z0 = zmax THEN 0 WHEN z1 = zmax THEN 1 ELSE 2 END AS pred_idx,
         exp(z0 - zmax) AS e0, exp(z1 - zmax) AS e1, exp(z2 - zmax) AS e2 FROM {name}_e),
{name} AS (
  SELECT *, CASE pred_idx WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS pred,
         e0 / (e0 + e1 + e2) AS prob_negative, e1 / (e0 + e1 + e2) AS prob_neutral,
         e2 / (e0 + e1 + e2) AS prob_positive,
         greatest(e0, e1, e2) / (e0 + e1 + e2) AS confidence,
         e2 / (e0 + e1 + e2) - e0 / (e0 + e1 + e2) AS score FROM {name}_p)"""


_R1S = _R1 + f""",
r1z AS (
  SELECT *, l_discount * 60 AS z0, l_tax * 75 AS z1, l_quantity / 8 AS z2,
         {_SENT.format('rating')} AS rating_sentiment FROM r1),
{classes_sql('r1s_all', 'r1z')},
r1s AS (
  SELECT *, confidence AS topic_probability,
         CASE pred WHEN 'negative' THEN -1 WHEN 'neutral' THEN 0 WHEN 'positive' THEN 1 END AS label_score
  FROM r1s_all)"""

_R2 = r"""r2 AS (
  SELECT md5(text) AS review_id, doc_id AS seq, source AS product_id, source AS product_name,
         lang AS category_keyword, CAST(n_chars % 5 + 1 AS DOUBLE) AS rating,
         CASE WHEN lang <> 'de' THEN concat(' ', source, chr(10), lang) END AS title,
         CASE WHEN n_chars >= 10 THEN text WHEN n_chars >= 6 THEN '  ' END AS text,
         TIMESTAMP '2022-12-01' + to_days(CAST(doc_id % 1300 AS INTEGER)) AS submission_time
  FROM documents)"""

_CLEAN = _R2 + r""",
kept AS (
  SELECT * FROM r2 WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''
    AND submission_time >= TIMESTAMP '2023-01-01' AND submission_time <= TIMESTAMP '2026-04-23'
  QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY seq) = 1),
normal AS (
  SELECT * REPLACE (trim(regexp_replace(text, '\s+', ' ', 'g')) AS text,
                    trim(regexp_replace(title, '\s+', ' ', 'g')) AS title) FROM kept),
clean AS (
  SELECT *, trim(regexp_replace(concat(coalesce(title, ''), '. ', text), '\s+', ' ', 'g')) AS full_text,
         CAST(length(text) AS INTEGER) AS text_length_chars,
         CAST(len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS INTEGER) AS text_length_words,
         length(text) < 20 AS is_short, CAST(submission_time AS DATE) AS date,
         strftime(submission_time, '%Y-%m') AS year_month,
         CAST(year(submission_time) AS INTEGER) AS year,
         CASE WHEN trunc(rating) <= 2 THEN 'negative' WHEN trunc(rating) = 3 THEN 'neutral'
              WHEN rating IS NOT NULL THEN 'positive' END AS rating_sentiment FROM normal)"""

_P = """p AS (
  WITH lines AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1),
  both_hits AS (
    SELECT *, 1 AS kw_pos, p_type AS category_keyword FROM part
    UNION ALL SELECT *, 2, p_brand FROM part WHERE p_size < 25)
  SELECT p_partkey AS product_uid, p_name AS name, category_keyword, p_retailprice AS price,
         greatest(coalesce(n, 0) - 20, 0) AS review_count, kw_pos
  FROM both_hits LEFT JOIN lines ON p_partkey = l_partkey)"""

_EV = "ev(event_date, event_label) AS (VALUES " + ", ".join(
    f"(DATE '{d}', '{label}')" for d, label in EVENT_ROWS) + ")"

_VIEWS = {"r1": _R1, "r1s": _R1S, "r2": _R2, "clean": _CLEAN, "p": _P, "ev": _EV}


def with_views(names: str, body: str) -> str:
    """SQL text with the named views (space separated) in front."""
    return "WITH " + ",\n".join(_VIEWS[n] for n in names.split()) + "\n" + body.strip()
