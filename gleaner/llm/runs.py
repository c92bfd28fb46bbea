"""Periodic runs of words: stretches that repeat one phrase over and over.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that holds at least
``least_times`` periods and ``least_length`` words and that no neighbouring word extends.

The longest common extension (LCE) of two positions says for how many words the texts from there on agree.
Only suffixes at positions whose remainder lies in a difference cover are sorted, by their words and then by
doubling; the common prefixes of neighbours in that order stand in a sparse table for range minima. Two positions
are compared word by word until both stand on the cover, at most COVER_STEP - 1 words later; the table answers the
rest. For each period p the positions of a grid are compared with those p words further on. A run of
period p holds a grid position, as the grid's step is no longer than the stretch in which words agree with
their p-th successor; so one question a grid position, n log n in all, finds every run.

Texts are handled together in slices, with a separator of its own after each text, longest texts first, so that
a period's grid covers only those texts that are long enough for it.

``find`` returns one row per document: doc_id, n_words, runs (array of start, length, period, by start and period),
collapsed (the words outside of repetitions, joined by one space: of every run the first q words stay, unless
another run drops them). Defined results: a null or empty text has no words, no runs and an empty collapsed text;
rows that repeat are rows of their own; ties cannot occur among runs (start and period differ); a text of any length
is read whole, in memory of about 100 bytes a word; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gleaner.llm.common import slices

#: A perfect difference cover: every remainder is the difference of two members.
COVER_STEP, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Grid positions that are compared at a time.
BLOCK = 1 << 20

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _shifts() -> np.ndarray:
    """[r, d]: the fewest words to go on from a position with remainder r until it and the position d words
    further on both stand on the cover."""
    out = np.full((COVER_STEP, COVER_STEP), COVER_STEP, dtype=np.int64)
    for d in range(COVER_STEP):
        for c in COVER:
            if (c + d) % COVER_STEP in COVER:
                out[:, d] = np.minimum(out[:, d], (c - np.arange(COVER_STEP)) % COVER_STEP)
    return out


_SHIFT = _shifts()


def _dense(order: np.ndarray, differs: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(differs)
    return rank


class Extensions:
    """Longest common extensions of a sequence of word numbers (0 or more)."""

    def __init__(self, words: np.ndarray) -> None:
        n = self.n = len(words)
        # Behind the end stands a word of its own, for as long as any comparison runs.
        self.words = np.concatenate([words.astype(np.int64) + 1, np.zeros(2 * COVER_STEP, dtype=np.int64)])
        residues = np.arange(COVER_STEP)[np.isin(np.arange(COVER_STEP), COVER)]
        places = (np.arange(0, n + COVER_STEP, COVER_STEP)[:, None] + residues).ravel()
        self.sampled = sampled = places[places < n]
        self.at = np.full(n + 1, -1, dtype=np.int64)
        self.at[sampled] = np.arange(len(sampled))
        if not len(sampled):
            return
        self._sort(sampled)
        self._common()

    def _sort(self, sampled: np.ndarray) -> None:
        """Ranks of the sampled suffixes by their first COVER_STEP words, then by twice as many, and so on."""
        bits = max(1, int(self.words.max()).bit_length())
        per = 63 // bits
        keys = []
        for lo in range(0, COVER_STEP, per):
            key = np.zeros(len(sampled), dtype=np.int64)
            for k in range(lo, min(lo + per, COVER_STEP)):
                key = key << bits | self.words[sampled + k]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        differs = np.zeros(len(order), dtype=np.int64)
        for key in keys:
            key = key[order]
            differs[1:] |= key[1:] != key[:-1]
        levels, width = [_dense(order, differs)], COVER_STEP
        while levels[-1].max() + 1 < len(sampled):
            rank = levels[-1]
            after = self._after(np.arange(len(sampled)), width)
            key = rank * (len(sampled) + 1) + np.where(after < 0, 0, rank[after] + 1)
            order = np.argsort(key, kind="stable")
            key = key[order]
            differs = np.append(0, key[1:] != key[:-1]).astype(np.int64)
            levels.append(_dense(order, differs))
            width *= 2
        self.levels, self.order, self.rank = levels, order, levels[-1]

    def _after(self, index: np.ndarray, words: int) -> np.ndarray:
        """Number of the sampled suffix so many words (a multiple of COVER_STEP) after another; -1 behind the end."""
        place = self.sampled[index] + words
        return np.where(place < self.n, self.at[np.minimum(place, self.n)], -1)

    def _common(self) -> None:
        """Common prefixes of neighbours in the order, and their minima over 2, 4, 8, ... neighbours."""
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        common = np.zeros(len(a), dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            rank, width = self.levels[level], COVER_STEP << level
            # Suffixes that a step leads behind the end have been told apart by their end marks.
            same = np.flatnonzero((a >= 0) & (b >= 0))
            same = same[rank[a[same]] == rank[b[same]]]
            common[same] += width
            a[same], b[same] = self._after(a[same], width), self._after(b[same], width)
        left, right = self.sampled[self.order[:-1]] + common, self.sampled[self.order[1:]] + common
        common += self._direct(left, right, np.full(len(left), COVER_STEP))
        self.minima = [common.astype(np.int32)]
        while 2 << (len(self.minima) - 1) <= len(common):
            half, last = 1 << (len(self.minima) - 1), self.minima[-1]
            self.minima.append(np.minimum(last[:-half], last[half:]))
        del self.levels

    def _direct(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Number of equal words from i and j on, at most ``most``; j is the later position of each pair or both lie
        at different places, so the end mark of one never meets that of the other."""
        out = np.zeros(len(i), dtype=np.int64)
        going = np.flatnonzero((most > 0) & (np.maximum(i, j) < self.n))
        step = 0
        while len(going):
            a, b = i[going] + step, j[going] + step
            going = going[(self.words[a] == self.words[b]) & (np.maximum(a, b) < self.n)]
            step += 1
            out[going] = step
            going = going[most[going] > step]
        return out

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from i < j on."""
        shift = _SHIFT[i % COVER_STEP, (j - i) % COVER_STEP]
        out = self._direct(i, j, shift)
        far = np.flatnonzero((out == shift) & (j + shift < self.n))
        a = self.rank[self.at[i[far] + shift[far]]]
        b = self.rank[self.at[j[far] + shift[far]]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        least = np.empty(len(far), dtype=np.int64)
        for k in np.unique(level):
            mine = level == k
            row = self.minima[k]
            least[mine] = np.minimum(row[lo[mine]], row[hi[mine] - (1 << k)])
        out[far] += least
        return out


def _grid(sizes: np.ndarray, ends: np.ndarray, least_times: int, least_length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(position, period, step) in blocks. Texts stand one after the other, longest first."""
    last = int(sizes[0]) // least_times if len(sizes) else 0
    periods = np.arange(1, last + 1)
    need = np.maximum(least_length, least_times * periods)
    # Texts with room for a run of the period are a head of the sequence.
    texts = np.searchsorted(-sizes, -need, side="right")
    covered = np.where(texts > 0, ends[np.maximum(texts, 1) - 1], 0)
    steps = need - periods
    counts = -(-covered // steps)
    lo = 0
    while lo < len(periods):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(counts[lo:]), BLOCK, side="right")))
        total = int(counts[lo:hi].sum())
        which = np.repeat(np.arange(lo, hi), counts[lo:hi])
        nth = np.arange(total) - np.repeat(np.cumsum(counts[lo:hi]) - counts[lo:hi], counts[lo:hi])
        yield nth * steps[which], periods[which], steps[which]
        lo = hi


def _runs(words: np.ndarray, sizes: np.ndarray, ends: np.ndarray, least_times: int, least_length: int) -> np.ndarray:
    """(start, length, period) of all runs of a sequence in which every text ends with a separator."""
    ext = Extensions(words)
    found = []
    for i, p, step in _grid(sizes, ends, least_times, least_length):
        ok = i + p < ext.n
        ok[ok] = ext.words[i[ok]] == ext.words[i[ok] + p[ok]]
        i, p, step = i[ok], p[ok], step[ok]
        forward = ext.lce(i, i + p)
        # The stretch holds at least ``step`` agreeing words, so it must reach back for those missing in front.
        back = np.maximum(step - forward, 0)
        ok = i >= back
        i, p, step, forward, back = i[ok], p[ok], step[ok], forward[ok], back[ok]
        ok = ext.lce(i - back, i - back + p) >= back + forward
        i, p, step, forward, back = i[ok], p[ok], step[ok], forward[ok], back[ok]
        # A stretch that reaches back to the grid position before was met there; else its first word is nearer.
        before = np.minimum(step, i)
        low, high = back, before + 1  # reaches back by low, not by high
        while len(i) and (high - low > 1).any():
            mid = (low + high) // 2
            reaches = ext.lce(i - mid, i - mid + p) >= mid
            low, high = np.where(reaches, mid, low), np.where(reaches, high, mid)
        first = (low < step)
        found.append(np.stack([i - low, low + forward + p, p], axis=1)[first])
    if not found:
        return np.zeros((0, 3), dtype=np.int64)
    runs = np.concatenate(found)
    # The same stretch is met with multiples of its smallest period, too.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[new]


def runs_of(texts: list[bytes | None], least_times: int = 4, least_length: int = 6) -> list[tuple[int, np.ndarray, bytes]]:
    """(number of words, runs, collapsed text) of each text in UTF-8."""
    split = [(t or b"").split() for t in texts]  # bytes are split at ASCII white space only
    order = sorted(range(len(split)), key=lambda k: -len(split[k]))
    ids: dict[bytes, int] = {}
    sizes = np.array([len(split[k]) for k in order], dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    words = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    for k, size, end in zip(order, sizes, ends):
        words[end - size - 1:end - 1] = np.fromiter((ids.setdefault(w, len(ids)) for w in split[k]), np.int64, size)
    if len(ends):
        words[ends - 1] = len(ids) + np.arange(len(ends))
    runs = _runs(words, sizes, ends, least_times, least_length)
    of = np.searchsorted(ends, runs[:, 0], side="right")
    cuts = np.searchsorted(of, np.arange(len(ends) + 1))
    out: list[tuple[int, np.ndarray, bytes]] = [None] * len(texts)  # type: ignore[list-item]
    for place, k in enumerate(order):
        mine = runs[cuts[place]:cuts[place + 1]].copy()
        kept = split[k]
        if len(mine):
            mine[:, 0] -= ends[place] - sizes[place] - 1
            mine = mine[np.lexsort((mine[:, 2], mine[:, 0]))]
            edge = np.zeros(len(kept) + 1, dtype=np.int64)
            np.add.at(edge, mine[:, 0] + mine[:, 2], 1)
            np.add.at(edge, mine[:, 0] + mine[:, 1], -1)
            kept = [kept[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
        out[k] = (len(split[k]), mine, b" ".join(kept))
    return out


def find(docs: DataFrame, least_times: int = 4, least_length: int = 6) -> DataFrame:
    """doc_id, n_words, runs, collapsed of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for lo, hi in slices([len(t or b"") for t in texts]):
                part = runs_of(texts[lo:hi], least_times, least_length)
                found = [[dict(zip(("start", "length", "period"), r)) for r in runs.tolist()] for _, runs, _ in part]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array([n for n, _, _ in part], pa.int64()), pa.array(found, _RUNS),
                     pa.array([c for _, _, c in part], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {doc_id}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the most periods, compared exactly (ties: smallest start, then smallest period); null without runs."""
    first = F.get(runs, F.lit(0))
    return F.aggregate(runs, first, lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
