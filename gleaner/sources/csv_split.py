"""CSV files with quoted line breaks, read by many tasks per file.

A reader that starts in the middle of a file cannot tell whether a line break ends a row or belongs to a quoted cell:
that depends on all quotes before it. Here every task reads a range of a file as plain lines and reports, per chunk of
lines, how many quotes it saw; a running sum over the chunks of a file says which chunks start inside a cell. Then each
chunk cuts itself into rows. Only the two ends of a chunk that belong to rows of its neighbours meet in a shuffle.

Cells may hold line breaks, separators and doubled quotes. A row ends at a line break (LF or CRLF) after an even number of
quotes. Rows of a file that uses CRLF have LF in their cells, as Spark's multi-line reader has it. Empty lines are no
rows. A quote may only stand in a quoted cell (RFC 4180); compressed files are read by one task each, as always.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from gleaner.session import scratch_path

#: Bytes of text in a chunk, about.
CHUNK_BYTES = 1 << 20

_QUOTE, _LF = 0x22, 0x0A


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where the range starts in the file), value: all lines, in their order within a range."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _chunked(lines: DataFrame, texts: bool) -> DataFrame:
    """file, block, seq, quotes, crlf (whether the first line ends so), and the text of consecutive lines of one range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq, held, size = None, 0, [], 0

        def chunk() -> pa.RecordBatch:
            text = b"\n".join(held)
            columns = [pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([seq], pa.int32()), pa.array([text.count(b'"')], pa.int64()),
                       pa.array([held[0].endswith(b"\r")])]
            return pa.RecordBatch.from_arrays(columns + ([pa.array([text], pa.binary())] if texts else []),
                                              ["file", "block", "seq", "quotes", "crlf"] + (["text"] if texts else []))

        for b in batches:
            files, blocks, values = b.column("file").dictionary_encode(), b.column("block").to_numpy(), b.column("value")
            names = files.dictionary.to_pylist()
            codes = files.indices.to_numpy()
            edges = np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            for lo, hi in zip(np.append(0, edges), np.append(edges, b.num_rows)):
                here = (names[codes[lo]], int(blocks[lo])) if hi > lo else at
                if here != at:
                    if held:
                        yield chunk()
                    at, seq, held, size = here, 0, [], 0
                for value in values.slice(lo, hi - lo).to_pylist():
                    held.append(value)
                    size += len(value) + 1
                    if size >= CHUNK_BYTES:
                        yield chunk()
                        seq, held, size = seq + 1, [], 0
        if held:
            yield chunk()

    return lines.mapInArrow(run, "file string, block bigint, seq int, quotes bigint, crlf boolean" + (", text binary" if texts else ""))


def rows_of(text: bytes, inside: bool) -> tuple[bytes | None, list[bytes], bytes | None]:
    """(continuation of the row before, whole rows, start of the row after) of a text that consists of whole lines.

    ``inside``: the text starts within a quoted cell.
    """
    raw = np.frombuffer(text, dtype=np.uint8)
    breaks = np.flatnonzero(raw == _LF)
    before = np.searchsorted(np.flatnonzero(raw == _QUOTE), breaks) + inside
    cuts = breaks[before % 2 == 0].tolist()
    open_ = (text.count(b'"') + inside) % 2 == 1
    parts, lo = [], 0
    for cut in cuts:
        parts.append(text[lo:cut])
        lo = cut + 1
    last = text[lo:]
    head = None
    if not open_:
        parts.append(last)
    if inside:
        if not parts:
            return text, [], None
        head = parts.pop(0)
    return head, parts, last if open_ else None


def _cut(chunks: DataFrame) -> DataFrame:
    """file, block, seq, k, kind, text: whole rows (kind 0), starts (1) and continuations (2) of rows that leave their
    chunk. Of a file with CRLF the lines of a row keep no CR."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                text, crlf = row.column("text")[0].as_py(), row.column("crlf")[0].as_py()
                if crlf:
                    text = (text + b"\n").replace(b"\r\n", b"\n")[:-1]
                head, whole, tail = rows_of(text, row.column("inside")[0].as_py())
                # Numbered so that a header, wherever it ends, is row 0 of its file.
                texts = whole + ([tail] if tail is not None else []) + ([head] if head is not None else [])
                kinds = [0] * len(whole) + [1] * (tail is not None) + [2] * (head is not None)
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row.column("file").to_pylist() * n), pa.array(row.column("block").to_pylist() * n, pa.int64()),
                     pa.array(row.column("seq").to_pylist() * n, pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(kinds, pa.int8()),
                     pa.array(texts, pa.binary())], ["file", "block", "seq", "k", "kind", "text"])

    return chunks.select("file", "block", "seq", "inside", "crlf", "text").mapInArrow(
        run, "file string, block bigint, seq int, k int, kind tinyint, text binary")


def _joined(ends: DataFrame) -> DataFrame:
    """Rows put together from their start and all continuations."""
    # The continuation in a chunk comes before the start in it, so it belongs to a chunk before.
    so_far = Window.partitionBy("file").orderBy("block", "seq", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    of = F.last(F.when(F.col("kind") == 1, F.struct("block", "seq", "k")), ignorenulls=True).over(so_far)
    parts = F.array_sort(F.collect_list(F.struct("block", "seq", "text")))
    joined = F.expr("array_join(transform(parts, p -> cast(p.text as string)), '\n')")
    return ends.withColumn("of", of).groupBy("file", "of").agg(parts.alias("parts")).select("file", "of.*", joined.alias("text"))


def split_rows(spark: SparkSession, path: str) -> DataFrame:
    """file, block, seq, k, text: every row of every file as text, header rows included; block, seq and k are in file order."""
    counted = _chunked(_lines(spark, path), False)
    so_far = Window.partitionBy("file").orderBy("block", "seq")
    before = F.coalesce(F.sum("quotes").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One short row per chunk: stored, so that Spark knows its size when it plans the join.
    stored = scratch_path(spark, "csv-chunks")
    counted.select("file", "block", "seq", (before % 2 == 1).alias("inside"), F.first("crlf").over(so_far).alias("crlf")).write.parquet(stored)
    cut = _cut(_chunked(_lines(spark, path), True).drop("crlf").join(spark.read.parquet(stored), ["file", "block", "seq"]))
    whole = cut.filter("kind = 0").select("file", "block", "seq", "k", F.col("text").cast("string").alias("text"))
    return whole.unionByName(_joined(cut.filter("kind > 0")))


def read_split(spark: SparkSession, path: str, schema: T.StructType, keep: list[Column] | None = None) -> DataFrame:
    """The cells of all rows as text, in the columns of ``schema``; files have a header each."""
    rows = split_rows(spark, path).filter((F.col("text") != "") & ~((F.col("block") == 0) & (F.col("seq") == 0) & (F.col("k") == 0)))
    cells = ", ".join(f"`{f.name}` string" for f in schema)
    # Unpacking a one-element array parses each row once.
    parsed = F.array(F.from_csv("text", cells, {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}))
    return rows.select(*(keep or []), F.inline(parsed))
