"""The corpus pipeline: documents to sharded training documents in five stages.

Each stage takes the documents that its predecessor kept (stored as Parquet and read again) and returns the
columns of documents; the last adds the place of every document.

Defined results: rows with null text or without a letter go at the first stage; rows that repeat a
document (same id and text) become one at the second; an empty table gives an empty result; further
columns of documents are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gleaner.llm import decontamination, language, mixing, sharding, simhash
from gleaner.llm.common import learnable, stage, table, text_hash

N_SHARDS = 40


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    return next(f"{name}{i}" for i in range(len(docs.columns) + 1) if f"{name}{i}" not in docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6, trained on the labelled rows of the corpus: documents in which it finds no language go."""
    name = _free(docs, "mixture")
    found = language.identify(docs, language.fit(docs.filter(learnable())), name)
    return found.filter(F.size(f"{name}.languages") > 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9 with the shingles of 4 words and 4 bits of its contract: of each component the document with the smallest
    id stays (of rows without an id, or with the same, the one with the smallest text hash; of rows that agree in
    both, the first in the order of all columns)."""
    key = _free(docs, "text_key")
    keyed = docs.withColumn(key, text_hash())
    found = simhash.near_duplicates(docs.select("doc_id", "text"), keep_hash=True)
    first = Window.partitionBy("component_id", "root").orderBy(F.col("doc_id").asc_nulls_last(), "text_hash")
    stays = found.withColumn("n", F.row_number().over(first)).filter("n = 1").select(
        F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    kept = keyed.join(stays, keyed["doc_id"].eqNullSafe(stays["kept_id"]) & keyed[key].eqNullSafe(stays["kept_hash"]))
    turn, same = _free(docs, "turn"), Window.partitionBy("kept_id", "kept_hash").orderBy(*(keyed[c] for c in docs.columns))
    return kept.withColumn(turn, F.row_number().over(same)).filter(F.col(turn) == 1).select(*(keyed[c] for c in docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a window of a benchmark item go."""
    key = _free(docs, "text_key")
    keyed = docs.withColumn(key, text_hash())
    found = decontamination.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    hit = found.filter("contaminated").select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct()
    return keyed.join(hit, keyed["doc_id"].eqNullSafe(hit["hit_id"]) & keyed[key].eqNullSafe(hit["hit_hash"]), "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: every document as often as the mix takes it."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: doc_id, lang, source, n_chars, size, text_crc32, shard, slot of every document."""
    placed = sharding.assign(docs, N_SHARDS, carry=("lang", "source", "n_chars"))
    return placed.select("doc_id", "lang", "source", "n_chars", "size", "text_crc32", "law", "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Hashed fingerprints, trained likelihoods and keyed rounding have no SQL counterpart.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
