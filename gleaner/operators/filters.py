"""Row filters and cleaning projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner import constants as K
from gleaner.functions import dates, scores, text as tx


def drop_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def nonblank_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.filter(tx.is_nonblank(F.col(column)))


def time_window(df: DataFrame, column: str = "submission_time", start: str = K.WINDOW_START,
                end: str = K.WINDOW_END) -> DataFrame:
    return df.filter(dates.in_window(F.col(column), start, end))


def min_reviews(products: DataFrame, at_least: int = 1) -> DataFrame:
    return products.filter(F.col("review_count") >= at_least)


def confident_negative(df: DataFrame, threshold: float = K.CONFIDENCE_THRESHOLD,
                       strict: bool = False) -> DataFrame:
    return df.filter(scores.is_confident_negative(F.col("pred"), F.col("confidence"), threshold, strict))


def with_tokens(df: DataFrame, tokens: Column, at_least: int = K.MIN_TOKENS,
                name: str = "tokens") -> DataFrame:
    """Adds a computed token column and drops rows with too few tokens.

    Unpacking a one-element array computes the tokens once per row. As a plain column and filter,
    Spark would push the filter below the column and tokenise every text twice.
    """
    long_enough = F.filter(F.array(tokens), lambda t: F.size(t) >= at_least)
    return df.select("*", F.explode(long_enough).alias(name))


def min_tokens(df: DataFrame, column: str = "tokens", at_least: int = K.MIN_TOKENS) -> DataFrame:
    return df.filter(F.size(column) >= at_least)


def events_in_range(events: DataFrame, monthly: DataFrame, month: str = "year_month") -> DataFrame:
    """Events from the first to the last retained month, both ends included.

    The two bounds are scalar subqueries of the monthly table.
    """
    first = monthly.agg(F.min(month)).scalar()
    last = monthly.agg(F.max(month)).scalar()
    return events.filter((F.col("event_date") >= first) & (F.col("event_date") <= last))


def cleaning_audit(df: DataFrame, start: str = K.WINDOW_START, end: str = K.WINDOW_END,
                   key: str = "review_id", text: str = "text",
                   time: str = "submission_time") -> DataFrame:
    """(step, kept, removed) for every cleaning step, in one pass over three columns."""
    has_text = tx.is_nonblank(F.col(text))
    has_time = has_text & F.col(time).isNotNull()
    inside = has_time & dates.in_window(F.col(time), start, end)
    flags = df.select(
        F.coalesce(has_text, F.lit(False)).alias("a"), F.coalesce(has_time, F.lit(False)).alias("b"),
        F.coalesce(inside, F.lit(False)).alias("c"), F.col(key).alias("k"))
    totals = flags.agg(
        F.count(F.lit(1)).alias("n0"), F.count_if("a").alias("n1"), F.count_if("b").alias("n2"),
        F.count_if("c").alias("n3"), F.countDistinct(F.when(F.col("c"), F.col("k"))).alias("ids"),
        F.max((F.col("c") & F.col("k").isNull()).cast("int")).alias("null_id"))
    totals = totals.withColumn("n4", F.col("ids") + F.coalesce("null_id", F.lit(0)))
    names = ["raw", "text present", "date valid", "in window", "unique id"]
    steps = [
        F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"), F.col(f"n{i}").alias("kept"),
                 (F.col(f"n{max(i - 1, 0)}") - F.col(f"n{i}")).alias("removed"))
        for i, name in enumerate(names)
    ]
    return totals.select(F.inline(F.array(*steps)))
