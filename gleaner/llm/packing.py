"""Best-fit packing of tokenised documents into sequences of a bounded length.

``tokenised`` turns documents into pieces of at most ``capacity`` tokens and stores them. ``placed`` plans with the
histogram of their lengths alone: longest first, every length goes to the sequences whose free room it fills best,
many equal pieces and many equal sequences in one step. The plan says for ranges of ranks within a length which
sequences and which offset they get; a piece finds its place by its rank among the pieces of its length. So
the planning handles at most ``capacity`` counts, however many documents there are. ``sequences`` joins the tokens
of the pieces to whole sequences.

Ranks come from prefix sums over groups of about GROUP_ROWS pieces of one length, so a length that a third of all
pieces share is many groups. Pieces are dealt to the groups by the number they got when they were stored, so
copies are spread, too.

Tokens: a text is cut where the vocabulary's pattern never joins (before a space that follows a word, between a letter and a
punctuation mark, around a line break between two words), each different part of a slice is encoded once, and the parts' ids
are put together again. A worker holds the ids of up to HELD_PARTS parts for its later slices. Special tokens' names in a text
are ordinary text. The end mark ``end_id`` follows every document.

Defined results: a null or empty text is the end mark alone; a document longer than ``capacity`` is cut, its first
piece taking the remainder; rows that repeat (or have no id) are rows of their own; ties in rank go by id, start and stored
number; texts of any length are read whole; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gleaner.llm.common import slices, stage

CAPACITY = 1024
#: Pieces of one length that are ranked together, about.
GROUP_ROWS = 1000

#: Bytes of the texts that are encoded together, about.
SLICE_BYTES = 6 << 20
#: Words that are encoded as one text.
JOINED = 10_000
#: Parts whose ids a worker holds, and their longest size in bytes: some 20 MB.
HELD_PARTS, LONGEST_HELD = 400_000, 32

_loaded: dict[int, object] = {}
_spaces: dict[int, np.ndarray] = {}
_held: dict[int, tuple] = {}


def _tokenizer(vocabulary: str):
    """The tokenizer of a vocabulary file's content, read once in a worker."""
    key = hash(vocabulary)
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        _loaded.clear()
        _spaces.clear()
        _held.clear()
        tokenizer = Tokenizer.from_str(vocabulary)
        tokenizer.encode_special_tokens = True
        _loaded[key] = tokenizer
    return _loaded[key]


def _encode_parts(tokenizer, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, where each part's ids start, their number). Words with one space in front are encoded as one text, which is a
    good deal faster than one by one: a token that starts with a space starts the next word. So are words of ASCII letters
    without a space, with a line break behind each, which is a token of its own."""
    words = [i for i, p in enumerate(parts) if p[0] == " " and p.split() == [p[1:]]]
    ids = np.concatenate([np.zeros(0, dtype=np.uint32)] + [
        np.array(tokenizer.encode_batch_fast(["".join([parts[i] for i in words[lo:lo + JOINED]])], add_special_tokens=False)[0].ids, dtype=np.uint32)
        for lo in range(0, len(words), JOINED)])
    first = np.flatnonzero(_space_starts(tokenizer)[ids])
    bare = [i for i, p in enumerate(parts) if p.isascii() and p.isalpha()]
    broken = np.concatenate([np.zeros(0, dtype=np.uint32)] + [
        np.array(tokenizer.encode_batch_fast(["".join([parts[i] + "\n" for i in bare[lo:lo + JOINED]])], add_special_tokens=False)[0].ids, dtype=np.uint32)
        for lo in range(0, len(bare), JOINED)])
    ends = np.flatnonzero(broken == broken[-1]) if bare else np.zeros(0, dtype=np.int64)
    others = sorted(set(range(len(parts))) - set(words) - set(bare))
    found = [e.ids for e in tokenizer.encode_batch_fast([parts[i] for i in others], add_special_tokens=False)]
    starts, lengths = np.empty(len(parts), dtype=np.int64), np.empty(len(parts), dtype=np.int64)
    starts[words], lengths[words] = first, np.diff(np.append(first, len(ids)))
    after = np.append(-1, ends)[:-1] + 1 if bare else ends
    starts[bare], lengths[bare] = len(ids) + after, ends - after
    size = np.array([len(f) for f in found], dtype=np.int64)
    starts[others], lengths[others] = len(ids) + len(broken) + np.cumsum(size) - size, size
    return np.concatenate([ids, broken, np.fromiter((i for f in found for i in f), np.uint32, int(size.sum()))]), starts, lengths


def _ids_of(tokenizer, parts: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_encode_parts``, but parts that the worker holds are looked up."""
    owner, words, ids, starts, lengths = _held.get(id(tokenizer), (None,) * 5)
    if owner is not tokenizer:
        words, ids, starts, lengths = pa.array([], pa.large_binary()), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = pc.index_in(parts, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    new = np.flatnonzero(at < 0)
    fresh = parts.take(pa.array(new))
    found, first, size = _encode_parts(tokenizer, [p.decode() for p in fresh.to_pylist()])
    all_starts, all_lengths = np.append(starts, len(ids) + first), np.append(lengths, size)
    at[new] = len(words) + np.arange(len(new))
    all_ids = np.append(ids, found)
    short = np.asarray(pc.binary_length(fresh)) <= LONGEST_HELD
    more = np.flatnonzero(short)[:max(HELD_PARTS - len(words), 0)]
    if len(more):
        n = size[more]
        before = np.cumsum(n) - n
        own = found[np.arange(int(n.sum())) + np.repeat(first[more] - before, n)]
        _held.clear()
        _held[id(tokenizer)] = (tokenizer, pa.concat_arrays([words, fresh.take(pa.array(more))]), np.append(ids, own),
                                np.append(starts, len(ids) + before), np.append(lengths, n))
    return all_ids, all_starts[at], all_lengths[at]


def _space_starts(tokenizer) -> np.ndarray:
    """Whether the token of each id starts with a space, which byte-level vocabularies write as one letter."""
    key = id(tokenizer)
    if key not in _spaces:
        letter = tokenizer.pre_tokenizer.pre_tokenize_str(" ")[0][0]
        vocabulary = tokenizer.get_vocab()
        table = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            table[i] = token.startswith(letter)
        _spaces.clear()
        _spaces[key] = table
    return _spaces[key]


def encode(tokenizer, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in order, number of ids of each text), texts in UTF-8."""
    sizes = np.array([len(t or b"") for t in texts], dtype=np.int64)
    data = b"".join(t or b"" for t in texts)
    raw = np.frombuffer(data, dtype=np.uint8)
    plain = (raw > 0x20) & (raw < 0x7F)
    # Before a space: behind a visible ASCII character, or between another character and a visible ASCII one.
    cut = np.zeros(len(raw) + 1, dtype=bool)
    if len(raw) > 2:
        cut[1:-2] = (raw[1:-1] == 0x20) & (plain[:-2] | (raw[:-2] >= 0x80) & plain[2:])
        letter = ((raw | 0x20) >= 0x61) & ((raw | 0x20) <= 0x7A)
        mark = plain & ~letter & ((raw < 0x30) | (raw > 0x39))
        cut[1:-1] |= letter[:-1] & mark[1:]
        # A single line break behind a visible ASCII character, and what is visible ASCII behind that.
        broken = plain[:-1] & (raw[1:] == 0x0A)
        cut[1:-1] |= broken
        cut[2:-1] |= broken[:-1] & plain[2:]
    ends = np.cumsum(sizes)
    cut[np.maximum(ends - 1, 0)] = False  # what stands behind a last space is another text
    cut[ends - sizes] = cut[ends] = True
    cut[0] = True
    bounds = np.flatnonzero(cut)
    if len(bounds) < 2:
        return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
    coded = parts.dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False)
    flat, starts, lengths = _ids_of(tokenizer, coded.dictionary)
    n = lengths[which]
    before = np.cumsum(n) - n
    ids = flat[np.arange(int(n.sum())) + np.repeat(starts[which] - before, n)]
    total = np.append(before, n.sum())
    return ids, total[np.searchsorted(bounds, ends)] - total[np.searchsorted(bounds, ends - sizes)]


def tokenised(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Stored pieces: doc_id, piece (from 0), start (ids of the document before it), length, ids (unsigned 32-bit,
    little-endian), row (a number of its own). ``path`` names a vocabulary file, which the driver reads."""
    with open(path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary: some MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, row = _tokenizer(sent.value), TaskContext.get().partitionId() << 40
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for lo, hi in slices([len(t or b"") for t in texts], SLICE_BYTES):
                ids, counts = encode(tokenizer, texts[lo:hi])
                of, piece, start, length, tokens, at = [], [], [], [], [], 0
                for k, n in enumerate(counts.tolist()):
                    own = np.append(ids[at:at + n], np.uint32(end_id)).astype("<u4").tobytes()
                    at, n, low, number = at + n, n + 1, 0, 0
                    while low < n:
                        high = low + ((n - low) % capacity or capacity)
                        of.append(lo + k)
                        piece.append(number)
                        start.append(low)
                        length.append(high - low)
                        tokens.append(own[4 * low:4 * high])
                        low, number = high, number + 1
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(tokens, pa.binary()), pa.array(np.arange(row, row + len(of)))], ["doc_id", "piece", "start", "length", "ids", "row"])
                row += len(of)

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return stage(docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {doc_id}, piece int, start bigint, length bigint, ids binary, row bigint"), "packing-pieces")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset): where the pieces of each length go. Number k of a range
    goes to sequence ``first sequence`` + k.

    A piece goes to the sequence with the least room that still holds it, else to a new one. As the best place after
    that is the same sequence again while it has room, full sequences get all their pieces of a length at a time.
    """
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, number)
    out, made = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for room in range(length, capacity):
            keep: list[tuple[int, int]] = []
            fits = room // length
            for first, n in open_.pop(room, []):
                full = min(n, left // fits)
                last = left - full * fits if full < n else 0  # pieces of one more, not full
                rank = _fill(out, open_, length, room, capacity, rank, first, full, last, fits)
                left -= full * fits + last
                taken = full + (last > 0)
                if taken < n:
                    keep.append((first + taken, n - taken))
            if keep:
                open_[room] = keep + open_.get(room, [])
            if not left:
                break
        if left:
            fits = capacity // length
            full, last = divmod(left, fits)
            _fill(out, open_, length, capacity, capacity, rank, made, full, last, fits)
            made += full + (last > 0)
    return out


def _fill(out: list, open_: dict, length: int, room: int, capacity: int, rank: int, first: int, full: int, last: int, fits: int) -> int:
    """Put ``fits`` pieces into each of ``full`` sequences and ``last`` pieces into the next; the rank after them."""
    for number, pieces, start in ((full, fits, first), (1, last, first + full)):
        if not number or not pieces:
            continue
        for k in range(pieces):
            out.append((length, rank, number, start, capacity - room + k * length))
            rank += number
        if room - pieces * length:
            open_[room - pieces * length].append((start, number))
    return rank


def placed(pieces: DataFrame, carry: list[str], capacity: int = CAPACITY) -> DataFrame:
    """The carried columns of each piece with sequence_id and offset; ``pieces`` has doc_id, start, length, row."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity``
    ranges = sorted(plan(counts, capacity))
    # At most one range for each length and room that meet, whatever the number of pieces.
    sent = spark.sparkContext.broadcast(np.array(ranges, dtype=np.int64).reshape(-1, 5))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        r = sent.value
        at = np.searchsorted(r[:, 0] << 48 | r[:, 1], length.to_numpy(np.int64) << 48 | rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": r[at, 3] + rank.to_numpy(np.int64) - r[at, 1], "offset": r[at, 4]})

    groups = spark.createDataFrame([(n, -(-c // GROUP_ROWS)) for n, c in counts.items()], "length bigint, groups bigint")
    dealt = pieces.join(F.broadcast(groups), "length").withColumn("of", F.pmod(F.xxhash64("row"), F.col("groups"))).drop("groups")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("of").rowsBetween(Window.unboundedPreceding, -1))
    sums = dealt.groupBy("length", "of").agg(F.count(F.lit(1)).alias("n")).select("length", "of", F.coalesce(before, F.lit(0)).alias("before"))
    in_group = F.row_number().over(Window.partitionBy("length", "of").orderBy("doc_id", "start", "row")) - 1
    ranked = dealt.withColumn("in_group", in_group).join(sums, ["length", "of"])
    return ranked.withColumn("place", place("length", F.col("before") + F.col("in_group"))).select(*carry, "place.*")


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """sequence_id, ids (its tokens), documents (array of doc_id, piece, offset, length in their order). ``places`` carries row."""
    held = pieces.join(places.select("row", "sequence_id", "offset"), "row")
    # A sequence holds at most its capacity of pieces.
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    return held.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"], p["length"])).alias("documents"))
