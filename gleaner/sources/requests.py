"""Which pages to ask for: request plans as tables, for whatever fetches them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleaner import constants as K
from gleaner.operators.ranking import top_n_per_group


def search_plan(keywords: DataFrame, max_pages: int = K.SEARCH_MAX_PAGES,
                page_size: int = K.SEARCH_PAGE_SIZE) -> DataFrame:
    """One row per keyword and page. The page list is exploded in place, no join needed."""
    return (keywords.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(max_pages))))
            .withColumn("page_size", F.lit(page_size)))


def keep_until_short_page(pages: DataFrame, page_size: int = K.SEARCH_PAGE_SIZE,
                          key: str = "category_keyword", page: str = "page",
                          size: str = "n") -> DataFrame:
    """Pages up to and including the first one with fewer than ``page_size`` hits.

    The first short page per keyword is an aggregate (combined map-side), so a keyword with very
    many pages is never gathered in one task.
    """
    first_short = (pages.filter(F.col(size) < page_size)
                   .groupBy(key).agg(F.min(page).alias("_first_short")))
    return (pages.join(first_short, key, "left")
            .filter(F.col("_first_short").isNull() | (F.col(page) <= F.col("_first_short")))
            .drop("_first_short"))


def harvest_plan(products: DataFrame, max_reviews: int = K.MAX_REVIEWS_PER_PRODUCT,
                 request_size: int = K.REVIEW_REQUEST_SIZE) -> DataFrame:
    """(offset, limit) requests per product until min(max_reviews, review_count) is reached."""
    cap = F.least(F.lit(max_reviews), F.col("review_count").cast("int"))
    return (products.withColumn("cap", cap).filter(F.col("cap") > 0)
            .withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("cap") - 1, F.lit(request_size))))
            .withColumn("limit", F.least(F.lit(request_size), F.col("cap") - F.col("offset"))))


def page_slice(reviews: DataFrame, order: list, offset: int, limit: int,
               key: str = "product_id") -> DataFrame:
    """Rows offset .. offset+limit of every product in the given order."""
    ranked = top_n_per_group(reviews, [key], order, offset + limit, rank="_rank")
    return ranked.filter(F.col("_rank") > offset).withColumnRenamed("_rank", "position")
