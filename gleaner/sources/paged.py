"""Paged sources: a request plan is a table, its rows are asked for in parallel, page after page of one list in order.

The caller supplies ``fetch``, which sends one request and returns the response text; nothing here knows a network. The
plan stays a table (of any size, from ``requests``), so no list of requests is built on the driver, and a list of pages ends
at the page that ``is_last`` names, as a client that pages by hand would stop.

A page that fails is tried again a bounded number of times with growing pauses. If it fails for good, its list ends there,
with a row that holds the error, and the lists of other keys go on; ``open_requests`` gives what is left for another run.
Spark runs a lost task again, so a page may be asked for twice but its row comes once. Write the result before using it
twice.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleaner import schemas
from gleaner.sources.responses import parse_text

Fetch = Callable[[dict], str]
IsLast = Callable[[dict, dict], bool]


def short_search_page(request: dict, response: dict) -> bool:
    """A search ends with the first page that is not full."""
    return len(response.get("products") or []) < request["page_size"]


def all_reviews_read(request: dict, response: dict) -> bool:
    """Reviews of a product end with an empty page or when all that exist have been read."""
    found = len(response.get("Results") or [])
    return not found or request["offset"] + found >= (response.get("TotalResults") or 0)


def fetch_pages(plan: DataFrame, fetch: Fetch, key: list[str], page: str, is_last: IsLast, tasks: int = 8,
                attempts: int = 3, pause: float = 0.0) -> DataFrame:
    """The columns of ``plan`` with response (text, null after a failure), attempts and error, a row per page asked for.

    ``key`` names the columns of a list of pages, ``page`` its order. At most ``tasks`` lists are read at a time,
    each with ``pause`` seconds between requests; a failed request waits as long, then twice as long, and so on.
    """
    rest = [c for c in plan.columns if c not in key and c != page]
    # A list has as many rows as the plan has pages for it.
    lists = plan.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(page, *rest))).alias("_pages")).repartition(tasks)
    schema = T.StructType([*plan.schema.fields, T.StructField("response", T.StringType()), T.StructField("attempts", T.IntegerType()),
                           T.StructField("error", T.StringType())])
    arrow = to_arrow_schema(schema)

    def answer(request: dict) -> tuple[str | None, dict, int, str | None]:
        error, wait = None, pause
        for n in range(1, attempts + 1):
            try:
                text = fetch(request)
                return text, json.loads(text), n, None
            except Exception as e:  # whatever a client raises; the last error is kept in the row
                error = f"{type(e).__name__}: {e}"
                if n < attempts:
                    time.sleep(wait)
                    wait *= 2
        return None, {}, attempts, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                pages = row.pop("_pages")
                for i, asked in enumerate(pages):
                    request = {**row, **asked}
                    text, response, n, error = answer(request)
                    yield pa.RecordBatch.from_pylist([{**request, "response": text, "attempts": n, "error": error}], schema=arrow)
                    if error or is_last(request, response):
                        break
                    if i + 1 < len(pages):
                        time.sleep(pause)

    return lists.mapInArrow(run, schema)


def open_requests(plan: DataFrame, pages: DataFrame, key: list[str], page: str) -> DataFrame:
    """The part of a plan that a run left open: of lists that ended with an error, the failed page and those after it, and
    lists without any answer."""
    failed = pages.groupBy(*key).agg(F.min(F.when(F.col("error").isNotNull(), F.col(page))).alias("_failed"), F.lit(True).alias("_asked"))
    return plan.join(failed, key, "left").filter(F.col("_asked").isNull() | (F.col(page) >= F.col("_failed"))).select(*plan.columns)


def search_pages(plan: DataFrame, fetch: Fetch, **options) -> DataFrame:
    """Pages of a search plan (category_keyword, page, page_size), each keyword up to its first short page."""
    return fetch_pages(plan, fetch, ["category_keyword"], "page", short_search_page, **options)


def review_pages(plan: DataFrame, fetch: Fetch, **options) -> DataFrame:
    """Pages of a harvest plan, each product until its reviews are read or its cap is reached."""
    asked = plan.select("product_uid", "category_keyword", "offset", "limit")
    return fetch_pages(asked, fetch, ["product_uid", "category_keyword"], "offset", all_reviews_read, **options)


def search_responses(pages: DataFrame) -> DataFrame:
    """Answered search pages in the shape of landed ones."""
    return parse_text(pages.filter(F.col("response").isNotNull()), F.col("response"), schemas.SEARCH_RESPONSE, ["category_keyword", "page"])


def review_responses(pages: DataFrame) -> DataFrame:
    """Answered review pages in the shape of landed ones."""
    return parse_text(pages.filter(F.col("response").isNotNull()), F.col("response"), schemas.REVIEW_RESPONSE, ["category_keyword"])

