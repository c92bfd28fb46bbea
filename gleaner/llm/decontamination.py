"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` turns documents into stored segments. A segment holds the postings of the documents of one
slice of a partition: its distinct terms in order, how often each occurs, and their positions.
Documents are numbered along one line of positions with a gap between neighbours, so that no phrase
runs over a border. ``phrase_matches`` starts from the rarest term of a phrase in the segment and
intersects its offset-adjusted list with those of the next rarer terms until none is left;
``proximity_matches`` looks for stretches that hold most words of an item in any order.
The item set is handed to the tasks in blocks of bounded size, one pass over the index for each.

Defined results: a null or wordless text has no words and no match; items without words match
nothing; items without an id take no part; repeated items of one id count once; rows that repeat a
document are documents of their own; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.common import slices, stage, text_hash
from gleaner.llm.words import hashed_words

#: Texts of one block of items, in bytes; blocks are handed to every task in turn.
ITEM_BLOCK_BYTES = 4 << 20
#: Stretches whose words are counted at a time.
STRETCHES = 1 << 16

INDEX = ("segment string, doc_ids array<bigint>, text_hashes array<bigint>, n_words array<int>, "
         "terms binary, counts binary, positions binary")
PHRASES = "segment string, ord int, doc_id bigint, text_hash bigint, item_id string, start int, length int"
PROXIMITY = ("segment string, ord int, doc_id bigint, text_hash bigint, item_id string, start int, "
             "n_found int, n_distinct int")


def _pack(values: np.ndarray) -> bytes:
    """Differences of numbers, byte planes apart, compressed."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    planes = steps.view(np.uint8).reshape(len(steps), steps.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(dtype).ravel(), dtype=dtype)


def _first_positions(n_words: np.ndarray) -> np.ndarray:
    """Where each document starts on the line of positions; one place between documents stays free."""
    return np.concatenate([[0], np.cumsum(n_words + 1)[:-1]]) if len(n_words) else np.zeros(0, np.int64)


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [t if isinstance(t, str) else None for t in batch["text"]]
        for lo, hi in slices([len(t or "") for t in texts]):
            words, n_words = hashed_words(texts[lo:hi])
            places = np.arange(len(words)) + np.repeat(np.arange(hi - lo), n_words)
            order = np.argsort(words, kind="stable")
            terms, first, counts = np.unique(words[order], return_index=True, return_counts=True)
            part = batch.iloc[lo:hi]
            yield pd.DataFrame({
                "segment": [f"{part['part'].iloc[0]}-{part['row'].iloc[0]}"],
                "doc_ids": [[None if pd.isna(x) else int(x) for x in part["doc_id"]]],
                "text_hashes": [[None if pd.isna(x) else int(x) for x in part["text_hash"]]],
                "n_words": [n_words.astype(np.int32).tolist()],
                "terms": [_pack(terms)], "counts": [_pack(counts.astype(np.int32))],
                "positions": [_pack(places[order].astype(np.int32))]})


def build_index(docs: DataFrame) -> DataFrame:
    """Stored segments of ``doc_id`` and ``text``; a segment is named by partition and first row."""
    rows = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), "text",
        text_hash().cast("string").alias("text_hash"), F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("row"))
    return stage(rows.mapInPandas(_segments, INDEX), "postings")


class Segment:
    """Postings of one segment, opened."""

    def __init__(self, row) -> None:
        self.name = row.segment
        self.doc_ids, self.text_hashes = row.doc_ids, row.text_hashes
        self.first = _first_positions(np.asarray(row.n_words, dtype=np.int64))
        self.terms = _unpack(row.terms, np.uint64)
        self.ends = np.cumsum(_unpack(row.counts, np.int32), dtype=np.int64)
        self.positions = _unpack(row.positions, np.int32)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the terms, and how often each occurs here (0: not at all)."""
        if not len(self.terms):
            return np.zeros(words.shape, np.int64), np.zeros(words.shape, np.int64)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        n = self.ends[at] - np.where(at > 0, self.ends[at - 1], 0)
        return at, np.where(self.terms[at] == words, n, 0)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[(self.ends[term - 1] if term else 0):self.ends[term]]

    def phrase(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Positions at which the terms follow one another."""
        order = np.argsort(counts, kind="stable")
        found = self.postings(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                break
            wanted, posted = found + k, self.postings(terms[k])
            at = np.minimum(np.searchsorted(posted, wanted), len(posted) - 1)
            found = found[posted[at] == wanted]
        return found

    def document(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of positions, and the positions counted from the start of each."""
        ords = np.searchsorted(self.first, places, side="right") - 1
        return ords, places - self.first[ords]

    def rows(self, ords: np.ndarray, item_id: str, columns: dict) -> pd.DataFrame:
        pick = lambda values: pd.array([values[o] for o in ords], dtype="Int64")
        return pd.DataFrame({"segment": self.name, "ord": ords.astype(np.int32), "doc_id": pick(self.doc_ids),
                             "text_hash": pick(self.text_hashes), "item_id": item_id, **columns})


def _opened(batches: Iterator[pd.DataFrame]) -> Iterator[Segment]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            yield Segment(row)


class Items:
    """The words of a block of items one after the other, and the windows of each item."""

    def __init__(self, ids: list[str], words: np.ndarray, counts: np.ndarray, window: int) -> None:
        self.ids, self.words = ids, words
        self.first = np.cumsum(counts) - counts
        self.sizes = np.minimum(window, counts)
        n = np.where(counts > 0, counts - self.sizes + 1, 0)
        self.of = np.repeat(np.arange(len(ids)), n)  # the item of each window, and where it starts
        self.starts = np.repeat(self.first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.lengths = counts
        parts = [np.unique(words[f:f + c]) for f, c in zip(self.first, counts)]
        self.n_distinct = np.array([len(p) for p in parts], dtype=np.int64)
        self.distinct = np.concatenate(parts) if parts else words[:0]


def _phrases_of(segment: Segment, items: Items) -> Iterator[pd.DataFrame]:
    if not len(items.of):
        return
    terms, counts = segment.find(items.words)
    present = np.append(0, np.cumsum(counts > 0))
    size = items.sizes[items.of]
    # Only windows whose words all occur in the segment are looked up.
    whole = np.flatnonzero(present[items.starts + size] - present[items.starts] == size)
    for mine in np.split(whole, np.flatnonzero(np.diff(items.of[whole])) + 1) if len(whole) else ():
        item = items.of[mine[0]]
        size = int(items.sizes[item])
        places = np.unique(np.concatenate([segment.phrase(terms[s:s + size], counts[s:s + size]) for s in items.starts[mine]]))
        if not len(places):
            continue
        ords, at = segment.document(places)
        # Windows that overlap or touch are one span.
        new = np.flatnonzero((np.diff(ords, prepend=-1) != 0) | (np.diff(at, prepend=at[0] - size - 1) > size))
        last = np.append(new[1:], len(at)) - 1
        yield segment.rows(ords[new], items.ids[item], {"start": at[new].astype(np.int32),
                                                        "length": (at[last] + size - at[new]).astype(np.int32)})


def _near_of(segment: Segment, items: Items, given: int | None, share: float) -> Iterator[pd.DataFrame]:
    terms, counts = segment.find(items.distinct)
    ends = np.cumsum(items.n_distinct)
    there = np.append(0, np.cumsum(counts > 0))
    need = np.ceil(share * items.n_distinct - 1e-9).astype(np.int64)
    for item in np.flatnonzero((need > 0) & (there[ends] - there[ends - items.n_distinct] >= need)):
        own = slice(ends[item] - items.n_distinct[item], ends[item])
        span = max(40, 2 * int(items.lengths[item])) if given is None else given
        yield from _near(segment, items.ids[item], terms[own], counts[own], int(need[item]), span)


def _near(segment: Segment, item_id: str, terms: np.ndarray, counts: np.ndarray, need: int, span: int) -> Iterator[pd.DataFrame]:
    n, least = len(terms), -(-need // 2)
    # Of the n - need + least rarest words a stretch with enough words holds at least ``least``.
    rare = np.argsort(counts, kind="stable")[:n - need + least]
    merged = np.sort(np.concatenate([segment.postings(terms[k]) for k in rare if counts[k]] or [np.zeros(0, np.int32)])).astype(np.int64)
    if len(merged) < least:
        return
    seeds = merged[:len(merged) - least + 1]
    seeds = np.unique(seeds[merged[least - 1:] - seeds < span])
    hits = []
    for lo in range(0, len(seeds), max(1, STRETCHES // span)):
        some = seeds[lo:lo + max(1, STRETCHES // span)]
        tried = np.unique((some[:, None] - np.arange(span)[None, :]).ravel())
        ords, at = segment.document(np.maximum(tried, 0))
        inside = (tried >= 0) & (at >= 0)
        tried, ords = tried[inside], ords[inside]
        border = np.append(segment.first[1:], np.iinfo(np.int32).max)[ords]
        found = np.zeros(len(tried), np.int32)
        for k in np.flatnonzero(counts > 0):
            posted = segment.postings(terms[k])
            found += np.searchsorted(posted, np.minimum(tried + span, border)) > np.searchsorted(posted, tried)
        good = found >= need
        hits.append((tried[good], ords[good], found[good]))
    if not sum(len(h[0]) for h in hits):
        return
    tried, ords, found = (np.concatenate(x) for x in zip(*hits))
    tried, once = np.unique(tried, return_index=True)
    ords, found = ords[once], found[once]
    # One row for each run of neighbouring stretches: its first with the most words.
    run = np.cumsum((np.diff(tried, prepend=tried[0]) > 1) | (np.diff(ords, prepend=ords[0]) != 0))
    best = pd.DataFrame({"run": run, "less": -found, "at": np.arange(len(run))}).sort_values(
        ["run", "less", "at"]).drop_duplicates("run")["at"].to_numpy()
    starts = segment.document(tried[best])[1]
    yield segment.rows(ords[best], item_id, {"start": starts.astype(np.int32), "n_found": found[best], "n_distinct": np.int32(n)})


def _search(index: DataFrame, items: DataFrame, schema: str, match, window: int = 1) -> DataFrame:
    """Union over blocks of items; a block is read by the driver and never larger than its bound
    (but for a single item that is). ``item_id`` and ``text`` are read."""
    spark = index.sparkSession
    items = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-2 * size // ITEM_BLOCK_BYTES))
    found = None
    for block in range(n_blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect()
        words, counts = hashed_words([r["text"] for r in mine])
        sent = spark.sparkContext.broadcast(Items([r["item_id"] for r in mine], words, np.asarray(counts, dtype=np.int64), window))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for segment in _opened(batches):
                yield from match(segment, sent.value)

        part = index.mapInPandas(run, schema)
        found = part if found is None else found.unionAll(part)
    return found


def phrase_matches(index: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Spans of document words covered by occurrences of ``window`` consecutive item words (the whole
    item where it has fewer): one row for each longest chain of overlapping or touching windows of
    an item. ``start`` counts words from 0."""
    return _search(index, items, PHRASES, _phrases_of, window)


def proximity_matches(index: DataFrame, items: DataFrame, span: int | None = None, share: float = 0.8) -> DataFrame:
    """Stretches of at most ``span`` document words (twice the item's words, 40 at least, if not given) that hold at
    least ``share`` of an item's distinct words in any order: of each run of neighbouring stretches the first that
    holds the most."""
    return _search(index, items, PROXIMITY, lambda segment, block: _near_of(segment, block, span, share))


def indexed_documents(index: DataFrame) -> DataFrame:
    """One row for each indexed document: segment, ord, doc_id, text_hash, n_words."""
    return index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "text_hashes", "n_words")).alias("ord", "d")).select(
        "segment", "ord", F.col("d.doc_ids").alias("doc_id"), F.col("d.text_hashes").alias("text_hash"),
        F.col("d.n_words").cast("bigint").alias("n_words"))


def covered_words(spans: str = "spans") -> F.col:
    """Number of words under an array of (start, length) spans that may overlap."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(acc["upto"], s["start"]))).alias("n"),
        F.greatest(acc["upto"], s["start"] + s["length"]).alias("upto"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"].cast("bigint"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, near: bool = False) -> DataFrame:
    """One row for each document: doc_id, text_hash, n_words, n_hit (words under any match), item_ids
    (sorted as strings), contaminated; with ``near`` also near_ids, the items most of whose words stand close together."""
    index = build_index(docs)
    hits = phrase_matches(index, items, window).groupBy("segment", "ord").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        covered_words(F.collect_list(F.struct("start", "length"))).alias("n_hit"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    found = indexed_documents(index).join(hits, ["segment", "ord"], "left")
    if near:
        close = proximity_matches(index, items).groupBy("segment", "ord").agg(F.array_sort(F.collect_set("item_id")).alias("near_ids"))
        found = found.join(close, ["segment", "ord"], "left")
    ids = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    return found.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), ids("item_ids"), (n_hit > 0).alias("contaminated"),
                        *([ids("near_ids")] if near else []))
