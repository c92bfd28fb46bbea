"""SimHash near-duplicates by a self-join of a binary trie over the fingerprints.

``fingerprints`` hashes the word shingles of whole texts. ``fingerprint_links`` joins the trie of all
distinct fingerprints with itself: its top levels are the partitioning (one subtree for each prefix,
met by every subtree whose prefix differs in few enough bits), the levels below are walked inside
a task, two nodes at a time, adding up the differing bits and giving a pair up once they exceed the
error budget. A task returns a spanning forest of the links it finds, never all pairs, so components
keep every link while a dense group gives one row a member. ``near_duplicates`` labels documents.

Defined results: a null or wordless text has fingerprint 0 and links like any other; a text of fewer
words than a shingle is one shingle; rows that repeat share a fingerprint; a null id is never the
smallest unless its component has no other; an empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.common import stage, text_hash
from gleaner.llm.components import connected_components

#: Fingerprints of one subtree at the level where tasks take over, and the most levels above it. Beyond that many levels
#: subtrees grow instead, so a fingerprint meets at most a fixed number of others' subtrees (280 of 2,048) and what
#: is shuffled grows with the number of fingerprints: about 2 KB for each.
SUBTREE, MOST_BITS = 16384, 11
#: Node pairs whose subtrees have at most this many pairs of fingerprints are compared directly.
LEAF_PAIRS = 64
#: Node pairs walked at a time.
FRONT = 1 << 15


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles (repeats count); bit set if set in over half of them."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(flat, seed)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist()
    hashes = np.array([digest(flat[a:b], seed) for a, b in zip(first, last)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 8192):
        part = hashes[lo:lo + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``fp`` (the fingerprint's bits as a long) of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "hash": b["hash"], "fp": _signed([fingerprint(t, shingle, seed) for t in texts])})

    # Nullable numbers travel as text, so that pandas does not turn them into floats.
    rows = docs.select(F.col("doc_id").cast("bigint").cast("string").alias("id"), text_hash().cast("string").alias("hash"), "text")
    return rows.mapInPandas(run, "id string, hash string, fp bigint").select(
        F.col("id").cast("bigint").alias("doc_id"), F.col("hash").cast("bigint").alias("text_hash"), "fp")


class _Trie:
    """A binary trie over sorted distinct fingerprints: a node is a range of them and a depth."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.zeros: dict[int, np.ndarray] = {}

    def split(self, depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where the ones begin in each range, at the bit below ``depth``."""
        if depth not in self.zeros:
            zero = (self.values >> np.uint64(63 - depth)) & np.uint64(1) == 0
            self.zeros[depth] = np.concatenate([[0], np.cumsum(zero)]).astype(np.int32)
        z = self.zeros[depth]
        return lo + z[hi] - z[lo]


class _Forest:
    """Components of the fingerprints of two subtrees; a root is the smallest index."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n, dtype=np.int64)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def _leaf_pairs(lo_a, hi_a, lo_b, hi_b) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of small ranges."""
    n_b = hi_b - lo_b
    n = (hi_a - lo_a) * n_b
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    width = np.repeat(n_b, n)
    return np.repeat(lo_a, n) + k // width, np.repeat(lo_b, n) + k % width


def join_tries(left: np.ndarray, right: np.ndarray | None, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between two sorted fingerprint arrays (within one if ``right`` is
    None): ends of its edges, as fingerprints."""
    inner = right is None
    a = _Trie(left)
    b = a if inner else _Trie(right)
    every = left if inner else np.concatenate([left, right])
    forest, shift = _Forest(len(every)), 0 if inner else len(left)
    top = [np.array([x], dtype=np.int32) for x in (0, len(a.values), 0, len(b.values), 0)]
    stack = [(0, top)]
    while stack:
        depth, (la, ha, lb, hb, far) = stack.pop()
        small = (ha - la).astype(np.int64) * (hb - lb) <= LEAF_PAIRS
        if small.any():
            i, j = _leaf_pairs(la[small], ha[small], lb[small], hb[small])
            near = np.bitwise_count(a.values[i] ^ b.values[j]) <= budget
            if inner:
                near &= i < j
            forest.link(i[near], j[near] + shift)
        la, ha, lb, hb, far = (x[~small] for x in (la, ha, lb, hb, far))
        if not len(la):
            continue
        ma, mb = a.split(depth, la, ha), b.split(depth, lb, hb)
        twin = (la == lb) & (ha == hb) if inner else np.zeros(len(la), dtype=bool)
        four = [(la, ma, lb, mb, far), (ma, ha, mb, hb, far), (la, ma, mb, hb, far + 1),
                tuple(x[~twin] for x in (ma, ha, lb, mb, far + 1))]
        la, ha, lb, hb, far = (np.concatenate(x) for x in zip(*four))
        live = (ha > la) & (hb > lb) & (far <= budget)
        front = [x[live] for x in (la, ha, lb, hb, far)]
        for lo in range(0, len(front[0]), FRONT):
            stack.append((depth + 1, [x[lo:lo + FRONT] for x in front]))
    tied = np.flatnonzero(forest.root != np.arange(len(every)))
    return every[tied], every[forest.root[tied]]


def _subtrees(prefix_bits: int, longest: int):
    """Sorted runs of one prefix, at most ``longest`` long, from sorted partitions."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, number = np.zeros(0, dtype=np.uint64), 0
        for b in batches:
            held = np.concatenate([held, b["fp"].to_numpy(dtype=np.int64).view(np.uint64)])
            while len(held):
                prefix = held >> np.uint64(64 - prefix_bits)
                n = min(longest, int(np.searchsorted(prefix, prefix[0], side="right")))
                if n == len(held) and n < longest:
                    break  # the next batch may go on with it
                yield pd.DataFrame({"prefix": [int(prefix[0])], "part": [f"{b['part'].iloc[0]}-{number}"],
                                    "fps": [held[:n].tobytes()]})
                held, number = held[n:], number + 1
            last = b["part"].iloc[0] if len(b) else None
        if len(held):
            yield pd.DataFrame({"prefix": [int(held[0] >> np.uint64(64 - prefix_bits))],
                                "part": [f"{last}-{number}"], "fps": [held.tobytes()]})
    return run


def fingerprint_links(distinct: DataFrame, budget: int = 4) -> DataFrame:
    """``u``, ``v``: links of fingerprints that differ in at most ``budget`` bits, as a forest from each
    pair of subtrees; any two linked fingerprints are in one component of these edges."""
    pairs = _subtree_pairs(distinct, budget)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                own = row.left_part == row.part
                u, v = join_tries(np.frombuffer(row.left_fps, np.uint64), None if own else np.frombuffer(row.fps, np.uint64), budget)
                yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return pairs.select("left_part", "left_fps", "part", "fps").mapInPandas(run, "u bigint, v bigint")


def _subtree_pairs(distinct: DataFrame, budget: int) -> DataFrame:
    """left_part, left_fps, part, fps: all pairs of subtrees whose prefixes differ in few enough bits."""
    n = distinct.count()
    bits = min(MOST_BITS, max(1, math.ceil(math.log2(max(2, n / SUBTREE)))))
    longest = SUBTREE if bits < MOST_BITS else max(SUBTREE, 2 * n >> bits)
    # The sign bit turned over, the order of longs is that of unsigned numbers.
    ordered = distinct.select("fp").repartitionByRange(F.col("fp").bitwiseXOR(F.lit(-(1 << 63)))).sortWithinPartitions(
        F.col("fp").bitwiseXOR(F.lit(-(1 << 63)))).withColumn("part", F.spark_partition_id())
    trees = stage(ordered.mapInPandas(_subtrees(bits, longest), "prefix bigint, part string, fps binary"), "subtrees")
    masks = F.filter(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda m: F.bit_count(m) <= budget)
    left = trees.select(F.col("part").alias("left_part"), F.col("fps").alias("left_fps"), "prefix",
                        F.explode(masks).alias("mask")).withColumn(
        "other", F.col("prefix").bitwiseXOR(F.col("mask").cast("bigint"))).filter("other >= prefix").drop("prefix")
    return left.join(trees.select(F.col("prefix").alias("other"), "part", "fps"), "other").filter(
        (F.col("mask") != 0) | (F.col("left_part") <= F.col("part")))


def near_duplicates(docs: DataFrame, shingle: int = 4, budget: int = 4, seed: int = 42, keep_hash: bool = False) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (the smallest id of the component) of every row; with
    ``keep_hash`` also ``text_hash`` and ``root`` (a fingerprint that names the component)."""
    rows = fingerprints(docs, shingle, seed)
    rows = stage(rows if keep_hash else rows.drop("text_hash"), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = connected_components(fingerprint_links(nodes, budget))
    # Only fingerprints with a link are looked up; all others are components of their own.
    member = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = stage(member.join(nodes, member["node"] == nodes["fp"]).select("node", "root", "first_id"), "linked")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = linked.join(smallest, "root").select("node", "root", "component_id")
    labelled = nodes.join(linked, nodes["fp"] == linked["node"], "left").select(
        F.col("fp").alias("of"), F.coalesce("root", "fp").alias("root"),
        F.when(F.col("node").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"))
    found = rows.join(labelled, rows["fp"] == labelled["of"])
    return found.select("doc_id", "fp", "component_id", *(["text_hash", "root"] if keep_hash else []))
