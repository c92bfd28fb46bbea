"""Toxicity scores from a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text becomes the set of its hashed character n-grams (within words, with their borders). ``fit`` counts
in how many labelled texts of either class an n-gram occurs and takes the logarithm of the ratio of the two
rates, drawn towards zero by ``z`` standard errors, so that chance differences of rare n-grams vanish. A
logistic regression is trained on the n-gram sets scaled by these ratios: shards are trained in parallel
and their weights averaged, several rounds. ``predictions`` learns from at most SAMPLE_ROWS labelled rows,
chosen by hash; their ids are sent to the texts, so that no text is moved to its label.

Defined results: null and empty texts hold no n-gram and get the score of the intercept; null labels are
not learned from; labels of one document that differ each count as a row; without rows of both classes the
score is the share of toxic rows (0.5 without any); a text of any length is read whole; further columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gleaner.llm.common import held_out, learnable, stage, sum_partials
from gleaner.llm.language import letters_and_spaces

#: Hashed n-grams; a model holds one weight for each.
N_FEATURES = 1 << 20
#: Lengths of the n-grams.
SIZES = (3, 4, 5)
#: Labelled rows that are learned from, at most.
SAMPLE_ROWS = 40_000
#: Shards of the sample that are trained side by side.
SHARDS = 8


def all_ngrams(text: str | None) -> np.ndarray:
    """Hashed n-grams of a text that do not run over a word's border, with repeats."""
    codes = letters_and_spaces(text)
    if not len(codes):
        return np.zeros(0, dtype=np.int32)
    inner = codes != 32
    mixed, plain, found = np.zeros(len(codes), dtype=np.uint32), np.ones(len(codes), dtype=bool), []
    for n in range(1, SIZES[-1] + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        mixed = mixed[:m] * np.uint32(0x01000193) ^ codes[n - 1:] * np.uint32(0x9E3779B1)
        if n > 2:
            plain = plain[:m] & inner[n - 2:n - 2 + m]  # a space may stand at the ends only
        if n in SIZES:
            h = mixed[plain[:m]]
            h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
            found.append((h ^ h >> np.uint32(13)) & np.uint32(N_FEATURES - 1))
    return np.concatenate(found).astype(np.int32) if found else np.zeros(0, dtype=np.int32)


def ngrams(text: str | None) -> np.ndarray:
    """Distinct hashed n-grams of a text."""
    return np.unique(all_ngrams(text))


def log_ratio(n_pos: int, n_neg: int, z: float = 2.0) -> Column:
    """Logarithm of the ratio of the rates ``pos`` and ``neg`` of an n-gram, nearer to zero by ``z`` standard errors."""
    share = n_pos / (n_pos + n_neg)
    p, q = F.col("pos") + share, F.col("neg") + (1 - share)  # one more row, shared out as the classes are: unseen n-grams have ratio 0
    ratio = F.log(p / n_pos) - F.log(q / n_neg)
    return F.signum(ratio) * F.greatest(F.lit(0.0), F.abs(ratio) - z * F.sqrt(1 / p + 1 / q))


class Model:
    """Weights of the n-grams (ratio and classifier weight in one) and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float) -> None:
        self.weights, self.intercept = weights, intercept

    def score(self, text: str | None) -> float:
        found = all_ngrams(text)
        found = np.unique(found[self.weights[found] != 0])
        return float(1 / (1 + np.exp(-np.clip(self.weights[found].sum(dtype=np.float64) + self.intercept, -40, 40))))


def _trained(rows: list[tuple[np.ndarray, int]], ratios: np.ndarray, start: np.ndarray, epochs: int, decay: float) -> np.ndarray:
    """Adaptive-step logistic regression over one shard; the last number is the intercept."""
    w, seen = start.copy(), np.full(len(start), 1.0)
    for _ in range(epochs):
        for found, label in rows:
            x = ratios[found]
            gap = 1 / (1 + np.exp(-np.clip(w[found] @ x + w[-1], -40, 40))) - label
            g = gap * x + decay * w[found]
            seen[found] += g * g
            w[found] -= 0.5 * g / np.sqrt(seen[found])
            seen[-1] += gap * gap
            w[-1] -= 0.5 * gap / np.sqrt(seen[-1])
    return w


def fit(labelled: DataFrame, rounds: int = 3, epochs: int = 2, decay: float = 1e-4) -> Model:
    """Model of ``text`` and ``label`` (0 or 1; nulls are left out); ``doc_id`` spreads the rows."""
    rows = labelled.filter("label IN (0, 1)").select(
        F.col("label").cast("int").alias("label"), "text", F.xxhash64("doc_id", "text").alias("order"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, N_FEATURES + 1), dtype=np.int32)
        for b in batches:
            for text, label in zip(b["text"], b["label"]):
                sums[label][ngrams(text)] += 1
                sums[label][-1] += 1
        some = np.flatnonzero(sums.any(axis=0))
        yield pd.DataFrame({"feature": some.astype(np.int32), "neg": sums[0][some], "pos": sums[1][some]})

    # One row per n-gram hash, and one (the last) with the numbers of rows. Only n-grams with a ratio reach the driver.
    counts = stage(rows.mapInPandas(count, "feature int, neg int, pos int").groupBy("feature").agg(
        F.sum("neg").alias("neg"), F.sum("pos").alias("pos")), "toxic-counts")
    totals = counts.filter(F.col("feature") == N_FEATURES).first()
    n_neg, n_pos = (totals["neg"], totals["pos"]) if totals else (0, 0)
    if not n_pos or not n_neg:
        return Model(np.zeros(N_FEATURES, np.float32), 0.0 if n_pos == n_neg else 40.0 if n_pos else -40.0)
    telling = counts.filter(F.col("feature") < N_FEATURES).select("feature", log_ratio(n_pos, n_neg).alias("ratio")).filter(
        "ratio <> 0").toPandas().sort_values("feature")
    kept, ratios = telling["feature"].to_numpy(), telling["ratio"].to_numpy(np.float32)
    spark = labelled.sparkSession
    known = spark.sparkContext.broadcast((kept, ratios))

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = (np.searchsorted(known.value[0], np.intersect1d(ngrams(t), known.value[0], assume_unique=True)) for t in b["text"])
            yield pd.DataFrame({"label": b["label"], "order": b["order"], "found": [f.astype(np.int32).tobytes() for f in found]})

    # Dealt out once and stored: every round reads the shards as they stand.
    sample = rows.mapInPandas(featurise, "label int, order bigint, found binary")
    shards = stage(sample.repartition(SHARDS, F.pmod("order", F.lit(SHARDS))).sortWithinPartitions("order", "found"), "toxic-sample")
    start = np.append(np.zeros(len(kept)), np.log(n_pos / n_neg))
    for _ in range(rounds):
        given = spark.sparkContext.broadcast(start)

        def train(batches: Iterator[pd.DataFrame], given=given) -> Iterator[pd.DataFrame]:
            mine = [(np.frombuffer(f, np.int32), label) for b in batches for f, label in zip(b["found"], b["label"])]
            if mine:
                w = _trained(mine, known.value[1], given.value, epochs, decay)
                yield pd.DataFrame({"payload": [np.append(w, 1.0).tobytes()]})

        total = sum_partials(shards.select("label", "found").mapInPandas(train, "payload binary"), "float64")
        start = total[:-1] / total[-1]
    weights = np.zeros(N_FEATURES, np.float32)
    weights[kept] = start[:-1] * ratios
    return Model(weights, float(start[-1]))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    scored = F.pandas_udf(lambda texts: pd.Series([sent.value.score(t) for t in texts], dtype="float64"), "double")
    return docs.withColumn(column, scored("text"))


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Learn from the labels (``doc_id``, ``label``) outside the held-out fold, then score all documents:
    doc_id, held_out, score, predicted."""
    known = labels.filter("label IN (0, 1)").filter(learnable()).select("doc_id", "label").distinct().orderBy(
        F.xxhash64("doc_id"), "label").limit(SAMPLE_ROWS)
    # Bounded by SAMPLE_ROWS, so it may be sent to every task.
    model = fit(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
