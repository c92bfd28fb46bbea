"""Descriptive aggregates.

Totals over a whole table are scalar subqueries of the already aggregated rows, never a window
without partitions and never a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.scores import percent_text


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value."""
    return (df.filter(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count(F.lit(1)).alias("n")))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Share of each value among the non-null rows, with its percent text."""
    counts = value_counts(df, column)
    total = counts.agg(F.sum("n")).scalar()
    return (counts.withColumn("share", F.col("n") / total)
            .withColumn("share_text", percent_text(F.col("share"))))


def exact_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """One-value table: exact quantile with linear interpolation.

    Values are counted first, so the final step sees one row per distinct value.
    """
    counts = value_counts(df, column)
    return counts.agg(F.percentile(column, q, F.col("n")).alias("quantile"))


def quantile_clip(df: DataFrame, column: str, q: float = 0.99) -> DataFrame:
    """Rows up to and including the quantile."""
    return df.filter(F.col(column) <= exact_quantile(df, column, q).scalar())


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last one is closed on the right.

    Works on the counts per distinct value. Bins without rows count 0. A single value lies in the
    middle of a range of length 1.
    """
    counts = value_counts(df, column)
    low, high = F.min(column).cast("double"), F.max(column).cast("double")
    low, high = F.when(low == high, low - 0.5).otherwise(low), F.when(low == high, high + 0.5).otherwise(high)
    edges = counts.agg(F.struct(low.alias("low"), ((high - low) / bins).alias("width"))).scalar()
    ranged = counts.withColumn("_edges", edges).select(
        column, "n", F.col("_edges.low").alias("low"), F.col("_edges.width").alias("width"))
    place = F.least(F.floor((F.col(column) - F.col("low")) / F.col("width")), F.lit(bins - 1))
    binned = ranged.select(place.cast("int").alias("bin"), "n", "low", "width")
    grid = counts.agg(low.alias("low"), ((high - low) / bins).alias("width")).filter("low IS NOT NULL").select(
        "low", "width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(binned.groupBy("bin").agg(F.sum("n").alias("n")), "bin", "left").select(
        "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("bin_left"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_right"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def summary(df: DataFrame, words: str = "text_length_words") -> DataFrame:
    """Rows, distinct products and categories, date range, mean rating, median words (cut).

    Rows collapse to one per (product, category) before the distinct counts, so two distinct
    counts do not multiply the input.
    """
    grouped = df.groupBy("product_id", "category_keyword").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("sum_rating"),
        F.count("rating").alias("n_rating"), F.min("submission_time").alias("first"),
        F.max("submission_time").alias("last"))
    totals = grouped.agg(
        F.sum("n").alias("reviews"), F.countDistinct("product_id").alias("products"),
        F.countDistinct("category_keyword").alias("categories"),
        F.to_date(F.min("first")).alias("first_date"), F.to_date(F.max("last")).alias("last_date"),
        (F.sum("sum_rating") / F.sum("n_rating")).alias("mean_rating"))
    if words not in df.columns:
        return totals
    median = exact_quantile(df, words, 0.5).scalar()
    return totals.withColumn("median_words", median.cast("int"))


def product_totals(df: DataFrame) -> DataFrame:
    per_product = df.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    return per_product.agg(F.sum("n").alias("reviews"), F.count("product_id").alias("products"))


def monthly_volume(df: DataFrame, month: Column | str = "year_month") -> DataFrame:
    """Reviews per month, with the month also as a date."""
    out = df.groupBy(month).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("month_date", F.to_date(F.concat(F.col(out.columns[0]), F.lit("-01"))))


def category_rating(df: DataFrame, category: str = "category_keyword") -> DataFrame:
    """Mean rating and count per category with its colour tier and the overall mean."""
    per_category = (df.filter(F.col(category).isNotNull()).groupBy(category)
                    .agg(F.sum("rating").alias("_sum"), F.count("rating").alias("n")))
    all_rows = df.agg(F.avg("rating")).scalar()
    mean = F.col("_sum") / F.col("n")
    return (per_category.withColumn("mean_rating", mean)
            .withColumn("tier", F.when(mean < 4, "low").when(mean < 4.5, "medium").otherwise("high"))
            .withColumn("overall_mean", all_rows).drop("_sum").orderBy("mean_rating", category))


def product_summary(products: DataFrame) -> DataFrame:
    """Products and reviews available per keyword, most reviews first."""
    return (products.groupBy("category_keyword")
            .agg(F.count("product_uid").alias("product_count"),
                 F.sum("review_count").alias("total_reviews"))
            .orderBy(F.desc("total_reviews"), "category_keyword"))


def total_reviews(products: DataFrame) -> DataFrame:
    return products.agg(F.count(F.lit(1)).alias("products"),
                        F.sum("review_count").cast("bigint").alias("reviews_available"))


def pct_where(condition: Column) -> Column:
    """Percent of all rows of the group, nulls included in the denominator."""
    hits = F.count(F.when(condition, F.lit(1)))
    return hits * 100.0 / F.count(F.lit(1))


def count_matrix(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts per row key and listed column value; combinations that never occur are 0.

    One pass of conditional counts; the value list is fixed, so no key product is built.
    """
    kept = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
    cells = [F.count(F.when(F.col(column) == v, F.lit(1))).alias(str(v)) for v in values]
    return kept.groupBy(row).agg(*cells, F.count(F.lit(1)).alias("row_total"))


def matrix_to_long(matrix: DataFrame, row: str, column: str, values: list,
                   value_type: str = "string") -> DataFrame:
    """(row, column, n, row_total) from a count matrix."""
    cells = F.array(*[
        F.struct(F.lit(v).cast(value_type).alias(column), F.col(f"`{v}`").alias("n")) for v in values])
    return matrix.select(row, "row_total", F.inline(cells))


def crosstab_pct(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Row-normalised percentages, one column per listed value."""
    counts = count_matrix(df, row, column, values)
    listed = sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`"))
    return counts.select(row, *[(F.col(f"`{v}`") * 100.0 / listed).alias(str(v)) for v in values])
