"""Joins. None carries a broadcast hint: Spark broadcasts a side only below its size threshold,
from file statistics or from the size AQE measured, and otherwise sort-merges with skew splitting.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from gleaner import constants as K
from gleaner.functions.scores import replace_literal


def not_yet_harvested(products: DataFrame, reviews: DataFrame,
                      suffix: str = K.PRODUCT_SUFFIX) -> DataFrame:
    """Products without reviews so far; ids match once the suffix is removed.

    Review ids are made distinct first (combined map-side): the join sees one row per product
    however many reviews it has.
    """
    done = reviews.select(replace_literal(F.col("product_id"), suffix).alias("_done")).distinct()
    return products.join(done, F.col("product_uid").cast("string") == F.col("_done"), "left_anti")


def attach_keyword(reviews: DataFrame, products: DataFrame,
                   suffix: str = K.PRODUCT_SUFFIX) -> DataFrame:
    """Give every review the keyword its product was found under."""
    lookup = products.select(
        F.concat(F.col("product_uid").cast("string"), F.lit(suffix)).alias("product_id"),
        "category_keyword")
    return reviews.drop("category_keyword").join(lookup, "product_id")


#: Event dates that may become literals of a filter.
MOST_DATES = 200


def event_days(events: DataFrame, days: int = K.EVENT_WINDOW_DAYS) -> DataFrame:
    """Each event unrolled to the days of its window: a range join becomes an equality on days."""
    return (events.withColumn("_offset", F.explode(F.sequence(F.lit(-days), F.lit(days - 1))))
            .withColumn("_day", F.date_add("event_date", F.col("_offset")))
            .withColumn("side", F.when(F.col("_offset") < 0, "before").otherwise("after")))


def in_any_window(reviews: DataFrame, events: DataFrame, days: int = K.EVENT_WINDOW_DAYS,
                  time: str = "submission_time") -> DataFrame:
    """Reviews whose day lies in the window of some event, as literal ranges on the time column (and on a
    ``year_month`` column of strings), so that files outside are not read.

    Dates are fetched, windows that overlap become one range. Beyond ``MOST_DATES`` different dates nothing is
    fetched and the filter is a join with the days of all windows.
    """
    day = F.to_date("event_date")
    fetched = events.select(day.alias("d")).filter("d IS NOT NULL").distinct().limit(MOST_DATES + 1).collect()
    if len(fetched) > MOST_DATES:
        near = event_days(events, days).select("_day").distinct()
        return reviews.withColumn("_day", F.to_date(time)).join(near, "_day", "left_semi").select(*reviews.columns)
    dates = sorted(r["d"] for r in fetched)
    ranges: list[list[dt.date]] = []
    for date in dates:
        low, high = date - dt.timedelta(days=days), date + dt.timedelta(days=days)
        if ranges and low <= ranges[-1][1]:
            ranges[-1][1] = high
        else:
            ranges.append([low, high])
    kinds, inside = dict(reviews.dtypes), F.lit(False)
    for low, high in ranges:
        edge = lambda d: F.lit(d.isoformat()).cast(kinds[time])
        here = (F.col(time) >= edge(low)) & (F.col(time) < edge(high))
        if kinds.get("year_month") == "string":
            here = here & F.col("year_month").between(low.strftime("%Y-%m"), high.strftime("%Y-%m"))
        inside = inside | here
    return reviews.filter(inside)


def event_window(reviews: DataFrame, events: DataFrame, days: int = K.EVENT_WINDOW_DAYS,
                 time: str = "submission_time") -> DataFrame:
    """Reviews in [date - days, date + days) of each event; one review can meet several events."""
    windows = event_days(events, days).drop("_offset")
    return (in_any_window(reviews, events, days, time).withColumn("_day", F.to_date(time)).join(windows, "_day").drop("_day"))


def above_scalar(df: DataFrame, column: str, scalar: DataFrame) -> DataFrame:
    """Rows compared with a one-value table through a scalar subquery, not a join."""
    return df.withColumn("above", F.col(column) > scalar.scalar())
