"""Small helpers of the training-data operators: tables, stored stages, row keys, sums over partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.session import WIDE_BYTES, WIDE_ROWS, scratch_path, small_batches  # noqa: F401

#: Texts are handled in Python in slices of about this many bytes (a longer text is a slice of its own).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def stage(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """Write a frame to the shared folder and read it back: it is computed once, survives lost
    executors, and the folder goes when the session ends.

    With ``wide`` (rows of some MB) the size of a row group is looked at after each row, not first after a hundred, so that
    neither a writer nor a reader holds hundreds of MB.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**(WIDE_ROWS if wide else {})).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def text_hash(column: str = "text") -> Column:
    """64-bit hash of a text; null for null."""
    return F.when(F.col(column).isNotNull(), F.xxhash64(column))


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def learnable(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether labels of a row may be learned from: the remainder is known and not 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds != 0, F.lit(False))


def same(left: DataFrame, right: DataFrame, *columns: str) -> Column:
    """Null-safe equality of columns of two frames."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive items whose sizes add up to about ``limit``."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def sum_partials(partials: DataFrame, dtype: str) -> np.ndarray | None:
    """Sum of equally long arrays, one binary ``payload`` per partition, by a tree of tasks.
    The length is fixed by the model, not by the data. None when there is no partial."""
    def add(a, b):
        return b if a is None else a if b is None else a + b

    arrays = partials.select("payload").rdd.map(lambda r: np.frombuffer(r[0], dtype=dtype))
    return arrays.treeAggregate(None, add, add, depth=2)
