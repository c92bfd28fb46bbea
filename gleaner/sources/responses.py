"""Landed JSON responses of a product search and of a review service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gleaner import schemas
from gleaner.functions.text import snippet


def read_search_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(with_keyword(schemas.SEARCH_RESPONSE)).json(path)


def read_review_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(with_keyword(schemas.REVIEW_RESPONSE)).json(path)


def with_keyword(schema: T.StructType) -> T.StructType:
    """A landed response carries the keyword and page number it was asked with."""
    return T.StructType(schemas.ASKED.fields + schema.fields)


def parse_text(df: DataFrame, json: Column, schema: T.StructType, keep: list[str]) -> DataFrame:
    """Responses that landed as a text column.

    Unpacking a one-element array parses each text once; as a plain column, the filter Spark adds
    for a later explode would be pushed below it and parse every text again.
    """
    return df.select(*keep, F.inline(F.array(F.from_json(json, schema))))


def flatten_search(responses: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per product hit: nested prices and ratings null-safe, no total counts as 0.

    ``keep`` names response columns to carry along (page numbers, say); ``position`` is the
    place of the hit in its response.
    """
    keep = keep or []
    hits = responses.select(*keep, "category_keyword", F.posexplode("products").alias("position", "p"))
    return hits.select(
        F.col("p.product_uid").alias("product_uid"), F.col("p.name").alias("name"),
        "category_keyword", F.col("p.retail_price.price").alias("price"),
        F.coalesce(F.col("p.reviews.total"), F.lit(0)).cast("double").alias("review_count"),
        F.col("p.reviews.average_rating").alias("average_rating"), F.col("p.brand").alias("brand"),
        F.col("p.product_type").alias("product_type"), *keep, "position")


def flatten_reviews(responses: DataFrame, keep_personal: bool = False) -> DataFrame:
    """One row per review, in the column order of the raw review table."""
    r = responses.select("category_keyword", F.explode("Results").alias("r"))
    flat = r.select(
        F.col("r.Id").alias("review_id"), F.col("r.ProductId").alias("product_id"),
        F.col("r.OriginalProductName").alias("product_name"), "category_keyword",
        F.col("r.Rating").cast("double").alias("rating"),
        F.col("r.SecondaryRatings.Quality.Value").alias("rating_quality"),
        F.col("r.SecondaryRatings.Value.Value").alias("rating_value"),
        F.col("r.Title").alias("title"), F.col("r.ReviewText").alias("text"),
        F.col("r.SubmissionTime").alias("submission_time"),
        F.col("r.UserNickname").alias("user_nickname"),
        F.col("r.UserLocation").alias("user_location"),
        F.col("r.IsRecommended").alias("is_recommended"),
        F.col("r.Helpfulness").alias("helpfulness"), F.col("r.CampaignId").alias("campaign_id"),
        F.col("r.IsSyndicated").alias("is_syndicated"))
    return flat if keep_personal else flat.drop(*schemas.PERSONAL_COLUMNS)


def search_total(responses: DataFrame) -> DataFrame:
    """Matches a search reports, '?' when it does not say."""
    return responses.withColumn(
        "total", F.coalesce(F.col("controls.total_record_count").cast("string"), F.lit("?")))


def review_total(responses: DataFrame) -> DataFrame:
    """Reviews a product is said to have, 0 when the response does not say."""
    return responses.withColumn("total", F.coalesce(F.col("TotalResults"), F.lit(0)))


def json_profile(df: DataFrame, json: str, keys: list[str] | None = None,
                 width: int = 80) -> DataFrame:
    """Fields present in each JSON record with their values cut to ``width`` for display."""
    keys = keys or []
    fields = df.select(*keys, F.explode(F.from_json(json, "map<string,string>")).alias("field", "value"))
    return fields.select(*keys, "field", snippet(F.col("value"), width, "when_cut").alias("display"))


def first_rows(df: DataFrame, order: list, n: int = 3) -> DataFrame:
    """Preview of the first ``n`` rows; runs as a distributed top-n."""
    return df.orderBy(*order).limit(n)
