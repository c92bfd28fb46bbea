"""Time expressions. They accept TIMESTAMP and TIMESTAMP_NTZ alike and never depend on the clock."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gleaner import constants as K


def parse_timestamp(c: Column) -> Column:
    """ISO string to timestamp; what cannot be read is null."""
    return F.try_to_timestamp(c)


def in_window(ts: Column, start: str = K.WINDOW_START, end: str = K.WINDOW_END) -> Column:
    """Both ends belong to the window; plain comparisons reach the Parquet scan."""
    return ts.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


def day(ts: Column) -> Column:
    return F.to_date(ts)


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def year(ts: Column) -> Column:
    return F.year(ts)


def month_start(ts: Column) -> Column:
    return F.trunc(ts, "MM")


def quarter_start(ts: Column) -> Column:
    return F.trunc(ts, "QUARTER")


def quarter_label(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))
