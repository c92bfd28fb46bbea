"""Exact stratified sampling by a keyed hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gleaner import constants as K
from gleaner.operators.ranking import top_n_per_group

_PREFIX = 4  # hex digits: 65,536 hash ranges per stratum


def sample_hash(key: Column, seed: int = K.SEED) -> Column:
    """Reproducible pseudo-random order of a row key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def stratified_sample(df: DataFrame, key: Column, n: int = K.SAMPLES_PER_STAR,
                      stratum: str = "rating", seed: int = K.SEED, tie_break: list | None = None,
                      shuffle: bool = False) -> DataFrame:
    """Exactly min(n, size) rows of every non-null stratum, chosen by hash of ``key``.

    A first pass over stratum and key alone counts rows per hash range and finds the range in
    which the n-th smallest hash lies. Only rows up to that range (about n) are then shuffled and
    ranked, so a stratum with a third of all rows costs no more than a small one. ``key`` should
    be unique: equal keys share a hash and are told apart by ``tie_break`` only.
    """
    hashed = df.filter(F.col(stratum).isNotNull()).withColumn("_hash", sample_hash(key, seed))
    hashed = hashed.withColumn("_range", F.substring("_hash", 1, _PREFIX))
    counts = hashed.groupBy(stratum, "_range").agg(F.count(F.lit(1)).alias("_n"))
    running = F.sum("_n").over(Window.partitionBy(stratum).orderBy("_range"))
    # First range whose running count reaches n; the last range when the stratum is smaller.
    cut = (counts.withColumn("_before", running - F.col("_n")).filter(F.col("_before") < n)
           .groupBy(stratum).agg(F.max("_range").alias("_cut")))
    # One map entry per stratum, handed to the scan as a scalar: no join, no shuffle of the rows.
    cuts = cut.agg(F.map_from_entries(F.collect_list(F.struct(stratum, "_cut")))).scalar()
    near = hashed.filter(F.col("_range") <= F.try_element_at(cuts, F.col(stratum)))
    order = [F.col("_hash"), *(tie_break or [])]
    picked = top_n_per_group(near, [stratum], order, n)
    if shuffle:
        picked = picked.orderBy(F.md5(F.concat(F.lit("order:"), F.col("_hash"))))
    return picked.drop("_hash", "_range")


def sample_sketch(df: DataFrame, key: Column, n: int = K.SAMPLES_PER_STAR, stratum: str = "rating", seed: int = K.SEED,
                  tie_break: list | None = None) -> DataFrame:
    """The rows that a sample of ``n`` per stratum could take from ``df``, with their hash: at most ``n`` per stratum.

    Sketches of parts of a table merge to the sketch of the table, so new rows are read once and old ones never again.
    """
    picked = stratified_sample(df, key, n, stratum, seed, tie_break)
    return picked.withColumn("sample_hash", sample_hash(key, seed))


def merge_sketches(sketches: DataFrame, n: int = K.SAMPLES_PER_STAR, stratum: str = "rating", tie_break: list | None = None) -> DataFrame:
    """The sketch of the whole from the rows of all sketches; without ``sample_hash`` it is the sample. ``n`` at most that of each."""
    return top_n_per_group(sketches, [stratum], [F.col("sample_hash"), *(tie_break or [])], n)


def add_to_sketch(df: DataFrame, store: str, batch: int, key: Column, n: int = K.SAMPLES_PER_STAR, stratum: str = "rating",
                  seed: int = K.SEED, tie_break: list | None = None) -> None:
    """Store the sketch of one batch of new rows; a repeated batch replaces its own."""
    sample_sketch(df, key, n, stratum, seed, tie_break).write.mode("overwrite").parquet(f"{store}/batch={batch}")


def read_sketch(spark: SparkSession, store: str, n: int = K.SAMPLES_PER_STAR, stratum: str = "rating", tie_break: list | None = None) -> DataFrame:
    """The sample of all batches: exactly min(n, size) rows of each stratum."""
    return merge_sketches(spark.read.parquet(store), n, stratum, tie_break).drop("sample_hash", "batch")
