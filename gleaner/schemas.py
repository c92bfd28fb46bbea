"""Declared column contracts of every stage."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(),
          "int": T.IntegerType(), "boolean": T.BooleanType(), "date": T.DateType()}


def struct(**fields) -> T.StructType:
    """A struct from name=type pairs; types are names, structs or arrays."""
    return T.StructType([T.StructField(n, _TYPES[t] if isinstance(t, str) else t) for n, t in fields.items()])


def array(element: T.DataType) -> T.ArrayType:
    return T.ArrayType(element)


PRODUCTS = struct(
    product_uid="string", name="string", category_keyword="string", price="double",
    review_count="double", average_rating="double", brand="string", product_type="string")

REVIEWS_RAW = struct(
    review_id="string", product_id="string", product_name="string", category_keyword="string",
    rating="double", rating_quality="double", rating_value="double", title="string", text="string",
    submission_time="string", user_nickname="string", user_location="string",
    is_recommended="boolean", helpfulness="double", campaign_id="string", is_syndicated="boolean")

PERSONAL_COLUMNS = ["user_nickname", "user_location"]

CLEAN_ADDED = ["full_text", "text_length_chars", "text_length_words", "is_short", "date",
               "year_month", "year", "rating_sentiment"]

SCORE_ADDED = ["pred_idx", "pred", "prob_negative", "prob_neutral", "prob_positive", "confidence",
               "score"]

TOPICS_OUT = ["review_id", "product_id", "product_name", "category_keyword", "rating", "title",
              "text", "full_text", "submission_time", "pred", "confidence", "dominant_topic",
              "topic_probability"]

SEARCH_RESPONSE = struct(
    products=array(struct(
        product_uid="string", name="string", brand="string", product_type="string",
        retail_price=struct(price="double"),
        reviews=struct(total="bigint", average_rating="double"))),
    controls=struct(total_record_count="bigint"))

REVIEW_RESPONSE = struct(
    Results=array(struct(
        Id="string", ProductId="string", OriginalProductName="string", Rating="bigint",
        SecondaryRatings=struct(Quality=struct(Value="double"), Value=struct(Value="double")),
        Title="string", ReviewText="string", SubmissionTime="string", UserNickname="string",
        UserLocation="string", IsRecommended="boolean", Helpfulness="double", CampaignId="string",
        IsSyndicated="boolean")),
    TotalResults="bigint")

# A landed response also says what was asked for.
ASKED = struct(category_keyword="string", page="int")

EVENTS = struct(event_date="date", event_label="string", event_type="string", color="string")
