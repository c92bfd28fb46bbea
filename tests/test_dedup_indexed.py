"""Duplicates over batches, looked up in the state of the stream instead of the table of all batches."""

import pytest
from pyspark.sql import functions as F

from gleaner.streaming import incremental

SCHEMA = "review_id string, n int, text string"


@pytest.fixture
def drops(spark, tmp_path):
    """Land one drop after another and run the job after each; returns the kept rows and the progress."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def land(*batches, again=False):
        progress = []
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            for _ in range(2 if again else 1):
                stream = incremental.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, "parquet")
                progress += incremental.dedup_indexed(stream, str(tmp_path / "out"), str(tmp_path / "check"), [F.col("n")])
        rows = spark.read.parquet(str(tmp_path / "out"))
        return sorted(((r["review_id"] or "", r["n"], r["text"], r["ingest_batch"]) for r in rows.collect())), [p for p in progress if p["rows"]]
    return land


def test_first_row_of_each_id_over_batches(drops):
    kept, _ = drops([("a", 2, "late"), ("a", 1, "first"), ("b", 5, "b")], [("a", 0, "seen"), ("c", 3, "c2"), ("c", 3, "c1"), (None, 1, "x"), (None, 2, "y")],
                    [("c", 0, "seen"), (None, 0, "seen"), ("b", 5, "b"), ("d", 1, "d")], again=True)
    assert kept == [("", 1, "x", 1), ("a", 1, "first", 0), ("b", 5, "b", 0), ("c", 3, "c1", 1), ("d", 1, "d", 2)]


def test_a_batch_reads_its_own_rows_only(drops):
    batches = [[(f"{b}-{i}", i, "t") for i in range(200)] + [("0-0", 0, "again")] for b in range(4)]
    kept, progress = drops(*batches)
    assert len(kept) == 800
    # The history grows, what a batch reads and touches does not.
    assert [p["rows"] for p in progress] == [201] * 4 and [p["ids"] for p in progress] == [200, 400, 600, 800]
    assert [p["touched"] for p in progress][1:] == [201] * 3


def test_a_lost_checkpoint_is_refused(drops, tmp_path, spark):
    drops([("a", 1, "t")])
    stream = incremental.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, "parquet")
    with pytest.raises(ValueError, match="checkpoint"):
        incremental.dedup_indexed(stream, str(tmp_path / "out"), str(tmp_path / "other"), [F.col("n")])


def test_the_provider_setting_is_put_back(drops, spark):
    before = spark.conf.get(incremental._PROVIDER)
    drops([("a", 1, "t")])
    assert spark.conf.get(incremental._PROVIDER) == before


def test_only_finished_batches_are_read(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = lambda *ids: spark.createDataFrame([(i, 1, "t") for i in ids], SCHEMA)
    rows("a", "b").write.parquet(f"{out}/ingest_batch=0")
    rows("c", "half").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{out}/ingest_batch=1")
    read = lambda: sorted((r["review_id"], r["ingest_batch"]) for r in incremental.read_committed(spark, out).collect())
    assert read() == [("a", 0), ("b", 0)]
    for _ in range(2):  # the retry, and one more
        rows("c", "d").write.mode("overwrite").parquet(f"{out}/ingest_batch=1")
        assert read() == [("a", 0), ("b", 0), ("c", 1), ("d", 1)]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no finished batch"):
        incremental.read_committed(spark, str(tmp_path / "none"))
