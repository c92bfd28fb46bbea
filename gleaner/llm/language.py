"""Language identification by multilingual mixture inference.

``train`` counts hashed character trigrams of each language over all labelled texts. ``identify`` treats a
text as a mixture: expectation-maximisation estimates the share of each language from the trigram
likelihoods, then the set of languages is chosen by penalised likelihood (a language is added while it
raises the log-likelihood by more than its penalty), and the set's shares are estimated anew.

Defined results: a null text or one without a letter is ``und`` with score 0 and no languages; a text
of any length is read whole; with nothing to learn from every text is ``und``; languages with equal
shares rank by name; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.common import held_out, learnable

#: Hashed trigrams; the model holds one number for each and each language.
N_FEATURES = 1 << 16
UNKNOWN = "und"
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def letters_and_spaces(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters; a run of other characters is one space, and the text stands
    between spaces. Empty for a null text and for one without a letter."""
    if not isinstance(text, str):
        return np.zeros(0, dtype=np.uint32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, dtype=np.uint32)
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # of a run of others only the first
    return np.concatenate([[32], np.where(letter, codes, 32)[kept], [32]]).astype(np.uint32)


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams of letters and spaces."""
    codes = letters_and_spaces(text)
    mixed = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA77) ^ codes[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64)


def train(docs: DataFrame) -> DataFrame:
    """``lang``, ``feature``, ``n``: trigram counts of each language over all rows with a language."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                found = trigrams(text)
                if lang not in counts:
                    counts[lang] = np.zeros(N_FEATURES, dtype=np.int64)
                np.add(counts[lang], np.bincount(found, minlength=N_FEATURES), out=counts[lang])
        for lang, n in counts.items():
            some = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "feature": some.astype(np.int32), "n": n[some]})

    return docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInPandas(
        run, "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


class Model:
    """Trigram likelihoods of each language."""

    def __init__(self, counts: pd.DataFrame, smoothing: float = 0.5) -> None:
        self.langs = sorted(counts["lang"].unique())
        n = np.full((N_FEATURES, len(self.langs)), smoothing)
        n[counts["feature"].to_numpy(), np.searchsorted(self.langs, counts["lang"])] += counts["n"].to_numpy()
        logs = np.log(n / n.sum(axis=0))
        best = logs.max(axis=1, keepdims=True) if self.langs else logs
        #: Likelihoods and log-likelihoods of each trigram, over its largest.
        self.likely, self.logs = np.exp(logs - best), logs - best

    def mixture(self, likely: np.ndarray, weights: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
        """Shares of the languages and the log-likelihood, from scaled likelihoods of distinct trigrams."""
        total = weights.sum()
        shares = np.full(likely.shape[1], 1 / likely.shape[1])
        for _ in range(rounds):
            new = shares * (likely.T @ (weights / (likely @ shares))) / total
            moved, shares = np.abs(new - shares).max(), new
            if moved < 1e-3:
                break
        return shares, float(weights @ np.log(likely @ shares))

    def identify(self, text: str | None, penalty: float = 3.0) -> tuple[list[str], list[float]]:
        """Languages of a text, largest share first. ``penalty`` times half the logarithm of the number
        of trigrams is the price of a language; 3, as neighbouring trigrams overlap by that much."""
        found = trigrams(text)
        if not len(found) or not self.langs:
            return [], []
        some, n = np.unique(found, return_counts=True)
        weights, likely = n.astype(np.float64), self.likely[some]
        shares, _ = self.mixture(likely, weights)
        order = np.lexsort((np.arange(len(shares)), -shares))
        price = penalty / 2 * np.log(len(found))
        # The best language alone, then the next by share while each pays for itself.
        alone = weights @ self.logs[some]
        chosen, part, level = [int(np.argmax(alone))], np.ones(1), float(alone.max())
        for k in order:
            if k in chosen:
                continue
            new, higher = self.mixture(likely[:, [*chosen, k]], weights)
            if higher - level <= price:
                break
            chosen, part, level = [*chosen, int(k)], new, higher
        rank = sorted(range(len(chosen)), key=lambda i: (-part[i], chosen[i]))
        return [self.langs[chosen[i]] for i in rank], [float(min(1.0, part[i])) for i in rank]


def fit(docs: DataFrame) -> Model:
    """Model of the labelled rows. The counts that reach the driver are bounded by trigram hashes times languages."""
    return Model(train(docs).toPandas())


def identify(docs: DataFrame, model: Model, column: str = "mixture") -> DataFrame:
    """``docs`` with a struct of ``languages`` and ``shares`` (arrays, largest share first)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("languages array<string>, shares array<double>")
    def found(texts: pd.Series) -> pd.DataFrame:
        got = [sent.value.identify(t) for t in texts]
        return pd.DataFrame({"languages": [g[0] for g in got], "shares": [g[1] for g in got]})

    return docs.withColumn(column, found("text"))


def predictions(docs: DataFrame) -> DataFrame:
    """Learn from the rows outside the held-out fold, then label all rows: doc_id, held_out, lang_pred,
    score (share of that language in the chosen mixture), languages, shares."""
    model = fit(docs.filter(learnable()))
    rows = identify(docs.select("doc_id", "text"), model).select("doc_id", "mixture.languages", "mixture.shares")
    first = lambda c, default: F.coalesce(F.get(c, F.lit(0)), F.lit(default))
    return rows.select("doc_id", held_out().alias("held_out"), first("languages", UNKNOWN).alias("lang_pred"),
                       first("shares", 0.0).alias("score"), "languages", "shares")
