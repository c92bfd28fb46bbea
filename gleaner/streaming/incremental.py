"""File-driven incremental jobs. The checkpoint remembers finished files, so a rerun adds nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gleaner.functions import dates
from gleaner.functions.scores import label_score
from gleaner.operators.ranking import keep_first
from gleaner.session import path_exists
from gleaner.sources.csv_files import BATCH_COLUMN


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json",
                max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def run_available(stream: DataFrame, out: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Append everything that has landed and stop."""
    (stream.writeStream.format(fmt).outputMode("append").option("path", out)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def _numbered(spark: SparkSession, out: str, checkpoint: str) -> None:
    """Refuse a lost checkpoint: its batch numbers would start anew and meet those of ``out``."""
    if path_exists(spark, out) and not path_exists(spark, checkpoint):
        raise ValueError(f"{out} has batches, but their checkpoint {checkpoint} is gone")


def run_batches(stream: DataFrame, out: str, checkpoint: str,
                prepare: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None) -> None:
    """Append everything that has landed to ``out``, one folder ``ingest_batch=<number>`` per micro-batch, and stop.

    A retried batch replaces its own folder. ``prepare`` gets the batch and the table of all batches
    before it (None for the first), and returns the rows to keep.
    """
    spark = stream.sparkSession
    _numbered(spark, out, checkpoint)

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if prepare:
            earlier = None
            if path_exists(spark, out):
                earlier = batch.sparkSession.read.option("basePath", out).parquet(out).filter(F.col(BATCH_COLUMN) < batch_id)
            rows = prepare(batch, earlier)
        rows.write.mode("overwrite").parquet(f"{out}/{BATCH_COLUMN}={batch_id}", compression="zstd")

    (stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def read_committed(spark: SparkSession, out: str) -> DataFrame:
    """The batches of ``out`` that were written to their end, as Spark's marker in the folder of each says.

    A batch that is being written, or whose writer was killed, is not seen; its retry replaces the folder and sets the
    marker. So a killed and a repeated batch leave the same rows as one clean run.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().toString() for f in files.listStatus(where) if f.isDirectory()]  # one per batch
    done = [n for n in names if path_exists(spark, f"{n}/_SUCCESS")]
    if not done:
        raise ValueError(f"{out} has no finished batch")
    return spark.read.option("basePath", out).parquet(*done)


def ingest(spark: SparkSession, source: str, schema: T.StructType, flatten: Callable[[DataFrame], DataFrame],
           out: str, checkpoint: str, fmt: str = "json", max_files: int | None = None) -> DataFrame:
    """Flatten newly landed responses into the table at ``out`` and return that table; its column
    ``ingest_batch`` tells the order in which rows came in."""
    run_batches(flatten(file_stream(spark, source, schema, fmt, max_files)), out, checkpoint)
    return spark.read.parquet(out)


def first_seen(batch: DataFrame, earlier: DataFrame | None, key: str, order: list) -> DataFrame:
    """First row per key of the batch whose key no earlier batch holds. Of the earlier table only the keys are read."""
    rows = keep_first(batch, [key], order)
    return rows if earlier is None else rows.join(earlier.select(key), key, "left_anti")


def dedup(stream: DataFrame, out: str, checkpoint: str, order: list, key: str = "review_id") -> DataFrame:
    """Append rows with ids not seen before, of whatever date, and return the table of all of them.

    No state is kept: a batch meets the ids already written. Within a batch the first row in ``order`` stays.
    """
    run_batches(stream, out, checkpoint, lambda batch, earlier: first_seen(batch, earlier, key, order))
    return stream.sparkSession.read.parquet(out)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def dedup_indexed(stream: DataFrame, out: str, checkpoint: str, order: list[Column], key: str = "review_id") -> list[dict]:
    """Append rows with ids not seen before, whatever their date, looking up only the ids of the batch.

    The ids of all batches are the state of a streaming aggregate, kept by RocksDB beside the executors and
    checkpointed as changes: a batch reads its own rows and the state of its own ids, however long the history is (``dedup`` reads
    all earlier ids). The state holds the first row of each id. Within a batch the first row in the ascending
    ``order`` stays, of equal ones the smallest in all columns; all rows without an id count as one. Returns the progress of
    each batch.

    A row is new if the first and the last batch that brought its id are the same, so a clock that is set back
    adds no row twice.
    """
    spark = stream.sparkSession
    _numbered(spark, out, checkpoint)
    one = F.struct(F.current_timestamp().alias("at"), *[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*stream.columns).alias("row"))
    first = stream.select(F.col(key).alias("_id"), one.alias("one")).groupBy("_id").agg(F.min("one").alias("one"), F.max("one.at").alias("last"))
    new = first.filter(F.col("one.at") == F.col("last")).select("one.row.*")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{BATCH_COLUMN}={batch_id}")

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        run = (new.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
        run.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return [_progress(p) for p in run.recentProgress if p["stateOperators"]]


def _progress(progress) -> dict:
    """Rows read, ids in the state and ids touched by a batch."""
    state = progress["stateOperators"][0]
    return {"batch": progress["batchId"], "rows": progress["numInputRows"], "ids": state["numRowsTotal"], "touched": state["numRowsUpdated"]}


def refresh_monthly(stream: DataFrame, store: str, checkpoint: str) -> None:
    """Add the partial sums of each micro-batch to ``store``.

    A batch writes its own folder and replaces it when retried, so no sum is counted twice.
    """

    _numbered(stream.sparkSession, store, checkpoint)

    def save(batch: DataFrame, batch_id: int) -> None:
        value = label_score(F.col("pred"))
        (batch.groupBy(dates.month_start(F.col("submission_time")).alias("year_month")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.count("pred").alias("n_pred"),
            F.sum(value).alias("total"), F.count(value).alias("n_scored"),
            F.count(F.when(F.col("pred") == "negative", F.lit(1))).alias("n_negative"),
            F.sum("rating").alias("sum_rating"), F.count("rating").alias("n_rating"))
            .write.mode("overwrite").parquet(f"{store}/batch={batch_id}"))

    (stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def read_monthly(spark: SparkSession, store: str, min_reviews: int) -> DataFrame:
    """The monthly table from all partial sums; equals the batch result."""
    sums = spark.read.parquet(store).groupBy("year_month").agg(*[
        F.sum(c).alias(c) for c in
        ("n_rows", "n_pred", "total", "n_scored", "n_negative", "sum_rating", "n_rating")])
    return sums.filter(F.col("year_month").isNotNull() & (F.col("n_pred") >= min_reviews)).select(
        "year_month", F.try_divide("total", "n_scored").alias("mean_sentiment"),
        (F.col("n_negative") * 100.0 / F.col("n_rows")).alias("pct_negative"),
        F.col("n_pred").alias("review_count"),
        F.try_divide("sum_rating", "n_rating").alias("mean_rating"))
