"""Top rows per group.

``row_number() <= n`` makes Spark insert a group limit on the map side: each task forwards at most
n rows per key, so a key that holds a third of the data never reaches one reducer whole. Spark does
so up to a threshold of its own; it is raised to the n that is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gleaner import constants as K


def top_n_per_group(df: DataFrame, keys: list, order: list, n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of every group in a total order."""
    conf, threshold = df.sparkSession.conf, "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(conf.get(threshold)) < n:
        conf.set(threshold, str(n))
    name = rank or "_rank"
    out = (df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
           .filter(F.col(name) <= n))
    return out if rank else out.drop(name)


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key in the given order; null keys count as equal."""
    return top_n_per_group(df, keys, order, 1)


def recent_cap(reviews: DataFrame, order: list, cap: int = K.MAX_REVIEWS_PER_PRODUCT,
               min_reviews: int = K.MIN_REVIEWS_PER_PRODUCT, key: str = "product_id",
               counts: DataFrame | None = None) -> DataFrame:
    """At most ``cap`` newest reviews of products that have ``min_reviews`` or more.

    ``counts`` (key, review_count) holds the advertised totals; without it they are counted here.
    The ranked rows are limited before they meet the counts, so the join is small.
    """
    if counts is None:
        counts = reviews.groupBy(key).agg(F.count(F.lit(1)).alias("review_count"))
    eligible = counts.filter(F.col("review_count") >= min_reviews).select(key, "review_count")
    newest = top_n_per_group(reviews, [key], order, cap, rank="_rank")
    return (newest.join(eligible, key)
            .filter(F.col("_rank") <= F.col("review_count")).drop("_rank", "review_count"))


def topic_exemplars(docs: DataFrame, tie_break: list, n: int = 3, topic: str = "dominant_topic",
                    weight: str = "topic_probability", text: str | None = "full_text",
                    width: int = 180) -> DataFrame:
    """The ``n`` strongest documents of each topic, with a display snippet and the topic size."""
    sizes = docs.groupBy(topic).agg(F.count(F.lit(1)).alias("topic_size"))
    best = top_n_per_group(docs, [topic], [F.col(weight).desc(), *tie_break], n, rank="rank")
    if text:
        best = best.withColumn("snippet", F.concat(F.substring(text, 1, width), F.lit("...")))
    return best.join(sizes, topic)


def rank_rows(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """1-based rank over a whole table that is already small, such as one row per topic."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
