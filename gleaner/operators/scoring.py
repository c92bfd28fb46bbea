"""Sentiment scoring of a text column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from gleaner import constants as K
from gleaner.functions import scores
from gleaner.functions.text import raw_tokens
from gleaner.operators.blocks import word_blocks
from gleaner.session import scratch_path
from gleaner.sources.sinks import write_stage

Predict = Callable[[list[str], int], "list[list[float]]"]


def add_class_columns(df: DataFrame, z0: Column, z1: Column, z2: Column,
                      with_score: bool = True) -> DataFrame:
    """Class index, label, three probabilities, confidence and signed score from three logits.

    The class comes from the logits, so rounding inside exp cannot change it.
    """
    p0, p1, p2 = scores.softmax3(z0, z1, z2)
    idx = scores.argmax3(z0, z1, z2)
    out = df.withColumns({
        "pred_idx": idx, "pred": scores.label_of(idx), "prob_negative": p0, "prob_neutral": p1,
        "prob_positive": p2})
    out = out.withColumn("confidence", scores.confidence(
        F.col("prob_negative"), F.col("prob_neutral"), F.col("prob_positive")))
    if with_score:
        out = out.withColumn("score", scores.signed_score(F.col("prob_negative"), F.col("prob_positive")))
    return out


def score_with_model(df: DataFrame, text: str, loader: Callable[[], Predict],
                     batch_size: int = K.SCORE_BATCH, max_tokens: int = K.MAX_MODEL_TOKENS,
                     with_score: bool = True, by_length: bool = True) -> DataFrame:
    """Batched three-class inference with the caller's model.

    ``loader()`` runs once per task and returns ``predict(texts, max_tokens) -> logits``, one row
    of three per text. A model pads a batch to its longest text, so with ``by_length`` texts of like length share one
    (``padding_report`` tells what that saves). Only the text column travels to Python (Arrow batches); Spark itself puts
    each result back on its row. Filter before scoring: Spark cannot push filters through it.
    """

    @F.pandas_udf("neg double, neu double, pos double")
    def logits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = loader()
        for texts in batches:
            values = texts.fillna("").astype(str).tolist()
            order = length_order(values, max_tokens) if by_length else list(range(len(values)))
            rows: list = [None] * len(values)
            for start in range(0, len(values), batch_size):
                mine = order[start:start + batch_size]
                for i, row in zip(mine, predict([values[i] for i in mine], max_tokens), strict=True):
                    rows[i] = row
            yield pd.DataFrame(rows, columns=["neg", "neu", "pos"], dtype="float64")

    # Without this, each of the three fields would call the model again.
    scored = df.withColumn("_logits", logits.asNondeterministic()(F.col(text)))
    z = [F.col(f"_logits.{c}") for c in ("neg", "neu", "pos")]
    return add_class_columns(scored, *z, with_score=with_score).drop("_logits")


def length_order(texts: list[str], max_tokens: int) -> list[int]:
    """Places of the texts, shortest first; as far as a model reads them, in words."""
    lengths = [min(len(t.split()), max_tokens) for t in texts]
    return sorted(range(len(texts)), key=lengths.__getitem__)


def padding_report(df: DataFrame, text: str, batch_size: int = K.SCORE_BATCH, max_tokens: int = K.MAX_MODEL_TOKENS) -> DataFrame:
    """(words, plain, by_length): words that are read, and cells of the model's batches with texts as they come and by length."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = b[text].fillna("").astype(str).tolist()
            n = [min(len(t.split()), max_tokens) for t in values]
            cells = [sum(len(part) * max(n[i] for i in part) for part in (order[s:s + batch_size] for s in range(0, len(n), batch_size)))
                     for order in (list(range(len(n))), length_order(values, max_tokens))]
            yield pd.DataFrame({"words": [sum(n)], "plain": [cells[0]], "by_length": [cells[1]]})

    parts = df.select(text).mapInPandas(count, "words bigint, plain bigint, by_length bigint")
    return parts.agg(*[F.sum(c).alias(c) for c in ("words", "plain", "by_length")])


#: Terms of a lexicon that Spark will send to all tasks, and their longest size: some MB when stored.
SMALL_LEXICON, LONGEST_TERM = 200_000, 100


def lexicon_score(df: DataFrame, key: str, text: str, lexicon: DataFrame, scale: float = 1.0) -> DataFrame:
    """Scores from a term table (term, w_negative, w_neutral, w_positive).

    Logits are the mean weights over all words of the text. A lexicon of at most ``SMALL_LEXICON`` terms is stored, so that Spark
    knows its size and sends it to the tasks, where the words of a text meet it in place: one short row per text is
    shuffled. A larger one is met by the different words of blocks of documents, so that neither a token nor a document's
    count is sent to its term.
    """
    stored = write_stage(lexicon, scratch_path(df.sparkSession, "lexicon"))
    size = stored.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("term")).alias("longest")).first()
    if size["n"] <= SMALL_LEXICON and (size["longest"] or 0) <= LONGEST_TERM:
        words = df.select(key, F.explode_outer(raw_tokens(F.col(text))).alias("term"))
        weights = words.withColumn("_times", F.col("term").isNotNull().cast("int")).join(stored, "term", "left")
        sums = weights.groupBy(key).agg(F.sum("_times").alias("_n"), *[
            F.sum(F.coalesce(F.col(f"w_{c}"), F.lit(0)) * F.col("_times")).alias(f"_{c}") for c in K.LABELS])
    else:
        parts = _block_sums(df.select(key, raw_tokens(F.col(text)).alias("_tokens")), key, stored)
        sums = parts.groupBy(key).agg(*[F.sum(c).alias(c) for c in parts.columns if c != key])
    z = [F.coalesce(F.try_divide(F.col(f"_{c}") * scale, F.col("_n")), F.lit(0.0)) for c in K.LABELS]
    return add_class_columns(sums, *z).select(
        key, "pred_idx", "pred", "prob_negative", "prob_neutral", "prob_positive", "confidence", "score")


def _block_sums(docs: DataFrame, key: str, lexicon: DataFrame) -> DataFrame:
    """key, number of words and sums of the three weights of each row; ``docs`` has the key and ``_tokens``."""
    spark = docs.sparkSession
    blocks = write_stage(word_blocks(docs, key, "_tokens"), scratch_path(spark, "word-blocks"))
    pairs = blocks.select("block", F.posexplode("terms").alias("place", "term"))
    weights = F.array(*[F.coalesce(F.col(f"w_{c}").cast("double"), F.lit(0.0)) for c in K.LABELS])
    known = pairs.join(lexicon.select("term", weights.alias("w")), "term").groupBy("block").agg(
        F.collect_list(F.struct("place", "w")).alias("known"))  # one block's vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ends, places, counts = (batch.column(c).slice(i, 1).flatten().to_numpy().astype(np.int64) for c in ("ends", "places", "counts"))
                found = batch.column("known").slice(i, 1).flatten()
                at = found.field("place").to_numpy().astype(np.int64)
                width = max(places.max(initial=-1), at.max(initial=-1)) + 1
                w = found.field("w").flatten().to_numpy().reshape(-1, 3)
                of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                # A term that the lexicon lists twice counts twice.
                times = counts * np.maximum(np.bincount(at, minlength=width), 1)[places]
                sums = [np.bincount(of, np.bincount(at, w[:, j], width)[places] * counts, len(ends) - 1) for j in range(3)]
                n = np.bincount(of, times, len(ends) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("keys").slice(i, 1).flatten(), pa.array(n), *map(pa.array, sums)], [key, "_n", *[f"_{c}" for c in K.LABELS]])

    kind = docs.schema[key].dataType.simpleString()
    return blocks.drop("terms").join(known, "block", "left").mapInArrow(
        run, f"`{key}` {kind}, _n bigint, " + ", ".join(f"_{c} double" for c in K.LABELS))


def linear_head(df: DataFrame, vector: str, weights: list[list[float]]) -> DataFrame:
    """Scores from an embedding column: one dot product per class, then the class columns."""

    def dot(w: list[float]) -> Column:
        return F.aggregate(
            F.zip_with(F.col(vector), F.array(*[F.lit(float(x)) for x in w]),
                       lambda a, b: a.cast("double") * b),
            F.lit(0.0), lambda acc, x: acc + x)

    named = df.withColumns({f"_z{i}": dot(w) for i, w in enumerate(weights)})
    return add_class_columns(named, F.col("_z0"), F.col("_z1"), F.col("_z2")).drop("_z0", "_z1", "_z2")


def train_text_classifier(labelled: DataFrame, text: str = "full_text", label: str = "rating_sentiment",
                          features: int = 1 << 18, max_iter: int = 20, reg: float = 0.01):
    """Multinomial logistic regression on hashed TF-IDF, trained from star-derived labels."""
    rows = _with_tokens(labelled.filter(F.col(label).isNotNull()), text).withColumn(
        "_label", F.array_position(F.array(*[F.lit(x) for x in K.LABELS]), F.col(label)).cast("double") - 1)
    stages = [HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
              IDF(inputCol="_tf", outputCol="_features"),
              LogisticRegression(featuresCol="_features", labelCol="_label", family="multinomial",
                                 maxIter=max_iter, regParam=reg, rawPredictionCol="_raw",
                                 probabilityCol="_prob", predictionCol="_prediction")]
    return Pipeline(stages=stages).fit(rows)


def split_held_out(df: DataFrame, key: Column, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Rows to train on and rows held out, by the hash of their key: the same on every run, and copies of a
    key on the same side."""
    out = F.pmod(F.xxhash64(key), F.lit(10_000)) < int(share * 10_000)
    return df.filter(~out), df.filter(out)


def classify(df: DataFrame, model, text: str = "full_text") -> DataFrame:
    """Class columns from a trained text classifier; classes it never saw get probability 0."""
    scored = model.transform(_with_tokens(df, text)).withColumn("_p", vector_to_array("_prob"))
    p = [F.coalesce(F.get("_p", F.lit(i)), F.lit(0.0)) for i in range(3)]
    z = [F.col(f"prob_{c}") for c in K.LABELS]
    idx = scores.argmax3(*z)
    out = scored.withColumns({f"prob_{c}": p[i] for i, c in enumerate(K.LABELS)})
    out = out.withColumns({"pred_idx": idx, "pred": scores.label_of(idx),
                           "confidence": scores.confidence(*z), "score": scores.signed_score(z[0], z[2])})
    return out.drop("_tokens", "_tf", "_features", "_raw", "_prob", "_prediction", "_p")


def _with_tokens(df: DataFrame, text: str) -> DataFrame:
    """Tokens of the texts, unless the caller has stored them."""
    return df if "_tokens" in df.columns else df.withColumn("_tokens", raw_tokens(F.col(text)))
