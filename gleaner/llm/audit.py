"""Audit of how document filters interact, from a sparse document-term matrix.

``term_matrix`` counts words into compressed sparse rows. Each slice of documents becomes a shard with a vocabulary
of its own. The words of all shards are dealt by a checksum to groups of a bounded number of words; each group
numbers its words once for the whole corpus and answers every shard with the numbers of its words, so that
words travel once, joined to one string per shard and group. A shard lists a word once, so frequent words make no hot
group. Shards and their answers meet one shard at a time. A row's sum is its number of words, its number of nonzero entries the number of distinct words.

``audit`` says for every order of the filters what each of them removes. Copies of a text are found by its hash of
256 bits; rows with equal id and hash are one row with a count before any shuffle by a key that may be hot. What
reaches the report is a count per part, set of failed filters and labels; the orders are exploded from these counts.

Filters (each fails a document): A fewer than 100 words; B distinct words under 80 % of the words; C more than 10 % of
the code points are A-Z; D any of #$%&*|; E the text of a smaller id, anywhere in the table.

Defined results: null text is an empty text; a null or empty language is the part with the empty name; a row without an
id fails E never and counts as no smaller id; rows that repeat are counted each, and do not fail E for one another when their ids are equal;
several labels of an id count as 1 if any is; texts without words have no entries (they fail A, not B); long texts
are read whole (one may be a shard of its own); an empty table gives no part and so no rows; further columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.llm.common import slices, small_batches, stage

#: Bytes of text for each group of the dictionary.
GROUP_BYTES = 16 << 20

FILTERS = "ABCDE"


def _count_words(texts: list[bytes | None], groups: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vocabulary, group of each word, row ends, columns, counts) of texts in UTF-8; columns are places in the
    vocabulary, which is ordered by group."""
    ids: dict[bytes, int] = {}
    columns, counts, ends = [], [], [0]
    for t in texts:
        words = (t or b"").split()  # at ASCII white space only
        column, n = np.unique(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words)), return_counts=True)
        columns.append(column)
        counts.append(n)
        ends.append(ends[-1] + len(column))
    words = list(ids)
    group = np.fromiter((crc32(w) % groups for w in words), np.int32, len(words))
    order = np.argsort(group, kind="stable")
    place = np.empty(len(words), dtype=np.int32)
    place[order] = np.arange(len(words), dtype=np.int32)
    return ([words[i] for i in order], group[order], np.array(ends, dtype=np.int32),
            place[np.concatenate(columns)] if len(words) else place, np.concatenate(counts or [[]]).astype(np.int32))


_ENTRIES = "ends array<int>, columns array<int>, counts array<int>"


def _one(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays([0, len(values)], pa.array(values))


def _shards(docs: DataFrame, carry: list[str], groups: int) -> DataFrame:
    """shard, rows (the carried columns), ends, columns (local), counts, words (group and its words joined by a space): a row
    per slice of documents."""
    kept = docs.select(*carry)
    kinds = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 40
        for b in batches:
            texts = b.column("__text").cast(pa.binary())
            for lo, hi in slices(pc.binary_length(texts).fill_null(0).to_pylist()):
                words, group, ends, columns, counts = _count_words(texts.slice(lo, hi - lo).to_pylist(), groups)
                rows = pa.StructArray.from_arrays([b.column(c).slice(lo, hi - lo) for c in carry], carry)
                first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
                parts = [b" ".join(words[i:j]) for i, j in zip(first, np.append(first[1:], len(words)))]
                told = pa.StructArray.from_arrays([pa.array(group[first], pa.int32()), pa.array(parts, pa.binary()).cast(pa.string())], ["group", "joined"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int64()), pa.ListArray.from_arrays([0, hi - lo], rows), _one(ends), _one(columns), _one(counts),
                     pa.ListArray.from_arrays([0, len(parts)], told)], ["shard", "rows", "ends", "columns", "counts", "words"])
                shard += 1

    return docs.select(*carry, F.col("text").alias("__text")).mapInArrow(
        run, f"shard bigint, rows array<struct<{kinds}>>, {_ENTRIES}, words array<struct<`group`: int, joined: string>>")


def _number(table: pa.Table) -> pa.Table:
    """The words of one group of the dictionary, of all shards: their numbers for each shard, and (without a shard) the
    words in the order of their numbers."""
    group = table.column("group")[0].as_py()
    parts = pc.split_pattern(table.column("joined").combine_chunks(), " ")
    coded = parts.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    numbers = pa.array(rank[coded.indices.to_numpy()] | group << 32)
    answers = pa.ListArray.from_arrays(parts.offsets, numbers)
    words = " ".join(coded.dictionary.take(pa.array(order)).to_pylist())
    return pa.table({
        "shard": pa.concat_arrays([table.column("shard").combine_chunks(), pa.nulls(1, pa.int64())]),
        "group": pa.array([group] * (table.num_rows + 1), pa.int32()),
        "numbers": pa.concat_arrays([answers, pa.array([[]], pa.list_(pa.int64()))]),
        "joined": pa.array([None] * table.num_rows + [words], pa.string())})


def _renumber(shard: pa.Table, answers: pa.Table) -> pa.Table:
    """A shard with the numbers of its words and its rows' sums; ``answers``: group, numbers."""
    known = answers.sort_by("group").column("numbers").combine_chunks().flatten().to_numpy() if answers.num_rows else np.zeros(0, dtype=np.int64)
    ends, columns, counts = (shard.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("ends", "columns", "counts"))
    sums = np.diff(np.append(0, np.cumsum(counts, dtype=np.int64))[ends])
    return shard.select(["shard", "rows", "ends"]).append_column("columns", _one(known[columns])).append_column(
        "counts", shard.column("counts")).append_column("sums", _one(sums))


def term_matrix(docs: DataFrame, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """(shards, dictionary) of ``text``. A shard: shard, rows (array of the carried columns), ends (of the rows in the
    following arrays, after a 0), columns (global word numbers), counts, sums (of the counts of each row). Dictionary: word,
    column."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    with small_batches(docs.sparkSession):
        local = stage(_shards(docs, carry, 1 + size // GROUP_BYTES), "matrix-local", wide=True)
    asked = local.select("shard", F.inline("words"))
    told = stage(asked.groupBy("group").applyInArrow(_number, "shard bigint, `group` int, numbers array<bigint>, joined string"), "matrix-numbers", wide=True)
    words = told.filter("shard IS NULL").select(
        F.posexplode(F.split("joined", " ")).alias("k", "word"), "group")
    dictionary = words.select("word", F.shiftleft(F.col("group").cast("bigint"), 32).bitwiseOR(F.col("k").cast("bigint")).alias("column"))
    # A worker holds one shard and its answers; both sides are sorted by the shard, which spills, and never collected.
    answers = told.filter("shard IS NOT NULL").select("shard", "group", "numbers")
    rows = local.schema["rows"].dataType.simpleString()
    shards = local.drop("words").groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(
        _renumber, f"shard bigint, rows {rows}, ends array<int>, columns array<bigint>, counts array<int>, sums array<bigint>")
    return shards, dictionary


def row_counts(shards: DataFrame) -> DataFrame:
    """The carried columns of each document with n_words (its row's sum) and n_distinct (its nonzero entries)."""
    each = F.transform("rows", lambda row, i: F.struct(
        row.alias("row"), F.get("sums", i).alias("n_words"), (F.get("ends", i + 1) - F.get("ends", i)).cast("bigint").alias("n_distinct")))
    return shards.select(F.inline(each)).select("row.*", "n_words", "n_distinct")


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of documents with counts: part, failed (bits of the filters), good, toxic, n."""
    text = F.coalesce("text", F.lit(""))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    looked = docs.select(
        F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("copy"),
        (F.when(100 * capitals.cast("bigint") > 10 * F.length(text).cast("bigint"), _bit("C")).otherwise(0)
         + F.when(text.rlike("[#$%&*|]"), _bit("D")).otherwise(0)).alias("seen"), text.alias("text"))
    shards, _ = term_matrix(looked, ["id", "part", "copy", "seen"])
    failed = (F.col("seen") + F.when(F.col("n_words") < 100, _bit("A")).otherwise(0)
              + F.when(100 * F.col("n_distinct") < 80 * F.col("n_words"), _bit("B")).otherwise(0))
    rows = stage(row_counts(shards).groupBy("id", "part", "copy", failed.alias("failed")).agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    first = rows.groupBy("copy").agg(F.min("id").alias("id"))
    marked = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Rows of a text with its smallest id: the key (text, id) is not hot where the text is.
    joined = rows.join(first.withColumn("first", F.lit(True)), ["copy", "id"], "left").join(marked, "id", "left")
    copied = F.col("id").isNotNull() & F.col("first").isNull()
    return joined.groupBy(
        "part", (F.col("failed") + F.when(copied, _bit("E")).otherwise(0)).alias("failed"),
        F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.sum("n").alias("n"))


def _orders() -> Column:
    """All orders of the filters with every step: an array of (filter_order, step, bit, bits before)."""
    steps = [{"filter_order": "".join(order), "step": k + 1, "bit": _bit(name), "before": sum(map(_bit, order[:k]))}
             for order in permutations(FILTERS) for k, name in enumerate(order)]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = flags(docs, labels).groupBy("part", "failed").agg(
        F.sum("n").alias("n"), F.sum(F.col("good") * F.col("n")).alias("good"), F.sum(F.col("toxic") * F.col("n")).alias("toxic"))
    one = counts.select("*", F.explode(_orders()).alias("o")).select("part", "failed", "n", "good", "toxic", "o.*")
    fails = F.col("failed").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("failed").bitwiseAND(F.col("before")) != 0

    def total(cond: Column, what: str = "n") -> Column:
        return F.sum(F.when(cond, F.col(what)).otherwise(0)).cast("bigint")

    steps = one.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"),
        total(F.col("failed") == F.col("bit")).alias("unique_fails"), total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"))
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit")).cast("bigint")).drop("bit")
