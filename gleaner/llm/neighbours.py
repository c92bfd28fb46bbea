"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. The index is cut into segments; each holds, for
every pivot, the inverted file of the vectors that have it among their nearest, with the place it takes
there. A query goes through the files of its own nearest pivots, which adds up the footrule distance
between the two orders (a pivot that one side lacks counts as standing behind its last); the share
``rerank`` of each segment with the smallest distance, and whatever is as near as the last of it, is ranked anew by
the cosine. Pivots are a bounded sample of the vectors; every vector is indexed. Queries meet segments in blocks; a
segment is sent anew to each block, 5 MB against some seconds of arithmetic for each pair.

Vectors are divided by their largest component, which leaves the cosine as it is and makes exact multiples equal. Equal
ones are one entry that carries its smallest ids, as many as can be asked for, so a large group of copies or of
vectors on one ray is neither a hot segment nor a loss, and its ties go to the smaller ids.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do
those without an id or of another length than most (the shorter one of ties); rows of one id are one item
and not each other's neighbours; with fewer candidates than asked for, all are returned; ties go to the
smaller id; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from gleaner.llm.common import stage

#: Pivots, and how many of the nearest stand for a vector.
PIVOTS, PREFIX = 256, 64
#: Vectors of a segment, and queries of a block, about.
SEGMENT_ROWS, QUERY_ROWS = 8192, 4096
#: Share of a segment that is ranked by the measure itself.
RERANK = 0.15


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``v`` (array of doubles, the largest 1 or -1): distinct rows that take part."""
    v = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists(
        v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    largest = F.array_max(F.transform(v, lambda x: F.abs(x)))
    # A quotient is rounded once, so exact multiples of a vector give the same numbers. The one-element array holds the largest.
    scaled = F.get(F.transform(F.array(largest), lambda m: F.transform(v, lambda x: x / m)), F.lit(0))
    rows = vectors.filter(sound).select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled.alias("v"))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    return rows.filter(F.size("v") == (length["d"] if length else 0)).distinct()


def entries(rows: DataFrame, k: int) -> DataFrame:
    """``v``, ``ids``: distinct vectors with their k + 1 smallest ids in order."""
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return rows.withColumn("n", first).filter(F.col("n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def pick_pivots(found: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """Unit vectors of the ``n`` entries with the smallest hashes."""
    rows = found.select("v").orderBy(F.xxhash64("v", F.lit(11)), "v").limit(n).collect()
    p = np.array([r["v"] for r in rows], dtype=np.float64)
    return _units(p) if len(rows) else p.reshape(0, 0)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first; ties to the smaller number."""
    return np.argsort(-(_units(x) @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int16)


class InvertedFiles:
    """For each pivot the rows that have it among their nearest, and the place it takes there."""

    def __init__(self, orders: np.ndarray, n_pivots: int) -> None:
        self.n, self.prefix = orders.shape
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.rows, self.places = by_pivot // self.prefix, (by_pivot % self.prefix).astype(np.int32)
        self.ends = np.searchsorted(flat[by_pivot], np.arange(n_pivots + 1))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of every row to a query's order: twice the sum of (prefix - place) less what
        shared pivots take off."""
        total = np.full(self.n, self.prefix * (self.prefix + 1), dtype=np.int32)
        for place, pivot in enumerate(order):
            own = slice(self.ends[pivot], self.ends[pivot + 1])
            total[self.rows[own]] -= 2 * (self.prefix - np.maximum(self.places[own], place))
        return total


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row, in double precision."""
    qs, xs = np.abs(q).max(), np.abs(x).max(axis=1)
    q, x = q / qs, x / xs[:, None]
    return np.einsum("ij,j->i", x, q) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("i,i->", q, q)))


def _search(segment: pd.DataFrame, queries: pd.DataFrame, k: int, rerank: float, n_pivots: int) -> pd.DataFrame:
    x, ids = np.array(segment["v"].tolist()), segment["ids"].tolist()
    files = InvertedFiles(np.array(segment["nearest"].tolist(), dtype=np.int64), n_pivots)
    n_ranked = min(len(x), max(int(np.ceil(rerank * len(x))), k + 1))
    out = []
    for key, q, order in zip(queries["key"], queries["v"], queries["nearest"]):
        distance = files.footrule(np.asarray(order))
        cut = np.partition(distance, n_ranked - 1)[n_ranked - 1]
        near = np.flatnonzero(distance <= cut)
        scores = cosines(np.asarray(q), x[near])
        # The best k + 1 entries, and all that tie with the last.
        bar = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1] if len(scores) > k + 1 else -np.inf
        best = np.flatnonzero(scores >= bar)
        rows = sorted((-scores[b], i) for b in best for i in ids[near[b]])
        out += [(key, i, -s) for s, i in rows[: k + 1]]
    return pd.DataFrame(out, columns=["key", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS, prefix: int = PREFIX,
            rerank: float = RERANK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for every row of ``queries`` the k largest cosines found
    among ``vectors`` (both: ``vec_id``, ``embedding``), without the query's own id."""
    rows = stage(usable(vectors), "vectors")
    found = stage(entries(rows, k), "entries")
    chosen = pick_pivots(found, pivots)
    prefix, width = min(prefix, max(1, len(chosen))), chosen.shape[1]
    sent = vectors.sparkSession.sparkContext.broadcast(chosen)

    @F.pandas_udf("array<smallint>")
    def order(vs: pd.Series) -> pd.Series:
        return pd.Series(list(nearest_pivots(np.array(vs.tolist()), sent.value, prefix)))

    n_segments = max(1, -(-found.count() // SEGMENT_ROWS))
    index = stage(found.withColumn("nearest", order("v")).withColumn(
        "segment", F.pmod(F.xxhash64("v"), F.lit(n_segments)).cast("int")), "permutation-index")
    asked = stage(usable(queries).filter(F.size("v") == width), "asked")
    distinct = asked.select("v").distinct().select(F.xxhash64("v", F.lit(3)).alias("key"), "v")
    n_blocks = max(1, -(-distinct.count() // QUERY_ROWS))
    blocks = distinct.withColumn("nearest", order("v")).withColumn("block", F.pmod("key", F.lit(n_blocks)).cast("int"))
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = blocks.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(n_segments - 1))))
    n_pivots = len(chosen)

    def search(segment: pd.DataFrame, queries_: pd.DataFrame) -> pd.DataFrame:
        if not len(segment) or not len(queries_):
            return pd.DataFrame({"key": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return _search(segment, queries_, k, rerank, n_pivots)

    hits = left.groupBy("segment", "block").cogroup(right.groupBy("segment", "block")).applyInPandas(
        search, "key bigint, vec_id bigint, score double")
    # One more than asked for, as one of them may be the query itself.
    best = Window.partitionBy("key").orderBy(F.col("score").desc(), "vec_id")
    lists = hits.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("hits"))
    own = asked.select(F.col("vec_id").alias("query_id"), F.xxhash64("v", F.lit(3)).alias("key"))
    ranked = own.join(lists, "key").select("query_id", F.posexplode(F.slice(
        F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)).alias("place", "hit"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"),
                         F.col("hit.score").alias("score"))
