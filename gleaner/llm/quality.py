"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

``statistics`` turns every whole text into a row of numbers (shares of kinds of characters, word and line
shape, repetition). ``fit`` standardises them, maps them to random Fourier features, whose inner
products approximate a Gaussian kernel, sums the normal equations over partitions, solves the ridge problem,
and calibrates the raw scores by isotonic regression on score bins counted over all learnable rows.

Defined results: null and empty texts have all-zero statistics and are scored as such; null labels are
not learned from; several labels of one document each count as a row; with one class only, or no row,
the score is the share of label 1 (0.5 without any); a text of any length is read whole; further
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.common import held_out, learnable, slices, stage, sum_partials
from gleaner.llm.words import hashed_words

#: Random Fourier features.
N_FOURIER = 384
#: Bins of the raw score for calibration.
N_BINS = 2048

_KINDS = np.zeros(256, dtype=np.int64)  # 0: none of these
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58], _KINDS[128:192], _KINDS[192:] = 1, 2, 3, 9, 4
for _c in b" \t\r\x0b\x0c":
    _KINDS[_c] = 5
for _c in b".,;:'\"-()?":
    _KINDS[_c] = 6
_KINDS[10], _KINDS[ord("!")], _KINDS[ord("|")] = 7, 8, 10
N_STATISTICS = 24


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of N_STATISTICS numbers for each text; all zero for a text without characters."""
    out = np.zeros((len(texts), N_STATISTICS))
    words, counts = hashed_words(texts)
    end = np.cumsum(counts)
    for k, text in enumerate(texts):
        if not text:
            continue
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        kinds = np.bincount(_KINDS[raw], minlength=11)
        chars = len(raw) - kinds[9]  # continuation bytes belong to their character
        upper, lower, digit, wide, blank, marks, lines, loud, other, bar = (int(kinds[i]) for i in (1, 2, 3, 4, 5, 6, 7, 8, 0, 10))
        own = words[end[k] - counts[k]:end[k]]
        n = max(1, len(own))
        tokens = text.split()
        m = max(1, len(tokens))
        sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) if tokens else np.zeros(1, np.int64)
        rows = [r for r in text.split("\n") if r.strip()]
        pairs = own[:-1] * np.uint64(31) + own[1:]
        letters = max(1, upper + lower + wide)
        shares = np.bincount(raw, minlength=256) / len(raw)
        shares = shares[shares > 0]
        out[k] = (
            1.0, np.log1p(chars), np.log1p(len(own)), upper / letters, digit / chars, wide / letters, blank / chars,
            marks / chars, loud / m, other / m, bar / m, np.log1p(lines), np.log1p(len(text) / max(1, len(rows))),
            sizes.mean() / 10, sizes.std() / 10, np.log1p(sizes.max()), len(np.unique(own)) / n,
            len(np.unique(pairs)) / max(1, len(pairs)), float((own[1:] == own[:-1]).mean()) if len(own) > 1 else 0.0,
            len(set(rows)) / max(1, len(rows)), -(shares * np.log(shares)).sum(), len(own) / m,
            sum(r.rstrip()[-1] in ".!?\"'" for r in rows) / max(1, len(rows)),
            len(re.findall(r"[.!?](?=\s|$)", text)) / m)
    return out


def statistics_table(docs: DataFrame) -> DataFrame:
    """Stored ``doc_id`` and ``x`` (array of statistics) of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["text"]]
            for lo, hi in slices([len(t or "") for t in texts]):
                yield pd.DataFrame({"id": b["id"].iloc[lo:hi].to_numpy(), "x": list(statistics(texts[lo:hi]))})

    rows = docs.select(F.col("doc_id").cast("bigint").cast("string").alias("id"), "text")
    return stage(rows.mapInPandas(run, "id string, x array<double>").select(
        F.col("id").cast("bigint").alias("doc_id"), "x"), "statistics")


class Model:
    """Standardisation, random Fourier features, ridge weights and calibration steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        # A Gaussian kernel as wide as the typical distance of standardised rows.
        self.omega = rng.normal(size=(len(mean), N_FOURIER)) / np.sqrt(2 * len(mean))
        self.phase = rng.uniform(0, 2 * np.pi, N_FOURIER)
        self.weights = np.zeros(N_FOURIER + 1)
        self.edges, self.levels = np.zeros(0), np.full(1, 0.5)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.omega + self.phase) * np.sqrt(2 / N_FOURIER), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        """Isotonic level, with a small slope inside a level so that the order of raw scores stays."""
        level = self.levels[np.searchsorted(self.edges, raw, side="right")]
        return np.clip(0.999 * level + 0.001 * np.clip(raw, 0, 1), 0, 1)


def pool_adjacent(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Non-decreasing shares of ones for ordered bins (isotonic regression); empty bins take the level before."""
    blocks: list[list[float]] = []
    for count, one in zip(n.tolist(), ones.tolist()):
        blocks.append([count, one, 1])
        while len(blocks) > 1 and blocks[-2][1] * max(blocks[-1][0], 1e-12) >= blocks[-1][1] * max(blocks[-2][0], 1e-12):
            count, one, width = blocks.pop()
            blocks[-1] = [blocks[-1][0] + count, blocks[-1][1] + one, blocks[-1][2] + width]
    return np.concatenate([np.full(int(w), one / count if count else 0.0) for count, one, w in blocks])


def _sums(rows: DataFrame, part) -> np.ndarray | None:
    """Sum over partitions of what ``part`` makes of a batch's statistics and labels."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                made = part(np.array(b["x"].tolist()), b["label"].to_numpy(dtype=np.float64))
                total = made if total is None else total + made
        if total is not None:
            yield pd.DataFrame({"payload": [total.tobytes()]})
    return sum_partials(rows.select("x", "label").mapInPandas(run, "payload binary"), "float64")


def fit(rows: DataFrame, ridge: float = 1e-2) -> Model:
    """Model of ``x`` and ``label``; ``ridge`` is a share of the number of rows."""
    d = N_STATISTICS
    moments = _sums(rows, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(axis=0), (x * x).sum(axis=0)]))
    if moments is None:
        return Model(np.zeros(d), np.ones(d))
    n, ones = moments[:2]
    mean = moments[2:2 + d] / n
    model = Model(mean, np.maximum(np.sqrt(np.maximum(moments[2 + d:] / n - mean * mean, 0)), 1e-6))
    model.levels = np.full(1, ones / n)
    if not 0 < ones < n:
        return model
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = sent.value.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    size = N_FOURIER + 1
    equations = _sums(rows, normal)
    model.weights = np.linalg.solve(equations[: size * size].reshape(size, size) + ridge * n * np.diag(
        np.append(np.ones(N_FOURIER), 0.0)) / N_FOURIER + 1e-9 * n * np.eye(size), equations[size * size:])
    grid = np.linspace(-0.5, 1.5, N_BINS - 1)
    ready = spark.sparkContext.broadcast(model)

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.searchsorted(grid, ready.value.raw(x), side="right")
        return np.concatenate([np.bincount(at, minlength=N_BINS), np.bincount(at, weights=y, minlength=N_BINS)])

    bins = _sums(rows, binned)
    model.edges, model.levels = grid, pool_adjacent(bins[:N_BINS], bins[N_BINS:])
    return model


def score(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (with ``x``) with ``score``."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(xs: pd.Series) -> pd.Series:
        return pd.Series(sent.value.calibrated(sent.value.raw(np.array(xs.tolist()).reshape(len(xs), N_STATISTICS))))

    return rows.withColumn("score", scored("x"))


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Learn from the labels (``doc_id``, ``label``) outside the held-out fold, then score all documents:
    doc_id, held_out, score, predicted."""
    rows = statistics_table(docs.select("doc_id", "text"))
    known = labels.filter("label IN (0, 1)").filter(learnable()).select("doc_id", "label")
    model = fit(stage(rows.filter(learnable()).join(known, "doc_id"), "quality-labelled"))
    return score(rows, model).select("doc_id", held_out().alias("held_out"), "score",
                                     (F.col("score") >= threshold).cast("int").alias("predicted"))
