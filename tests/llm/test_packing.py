import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleaner.llm import packing, queries
from tests.llm.conftest import DOCS

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_encode_equals_whole_texts(tokenizer):
    rng = random.Random(1)
    bits = ["a", "Word", "l\u00e4nge", "\u8bed\u8a00", " ", "  ", "\n", "\u00a0", "\u3000", "\u2003 ", "\x1c", "\x85", "'s", " 've", "12", "\u0663", "...", " -", "\t", "\U0001f600", "\u200b", "e\u0301", "<|endoftext|>"]
    for _ in range(300):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 5))]
        ids, counts = packing.encode(tokenizer, [t.encode() for t in texts])
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w], texts
    ids, counts = packing.encode(tokenizer, [None, b"", b" ", b" a"])
    assert counts.tolist() == [0, 0, 1, 1]


def test_parts_of_earlier_slices_are_not_encoded_again(monkeypatch, tokenizer):
    """What a worker holds gives the same ids, also at the cuts around marks and line breaks; a slice that comes again needs no encoding."""
    asked = []
    plain = packing._encode_parts
    monkeypatch.setattr(packing, "_encode_parts", lambda t, parts: asked.append(len(parts)) or plain(t, parts))
    rng = random.Random(5)
    bits = ["Word", "don't", "it'so", "'", "'re", ",", ".", ".\n", "\n", "\n\n", "\r\n", " ", "a", " the", "7", "-", "x_y", "l\u00e4nge", "e\u0301", ".\u0301", "\u8bed"]
    for held in (packing.HELD_PARTS, 20):
        packing._held.clear()
        monkeypatch.setattr(packing, "HELD_PARTS", held)
        for _ in range(300):
            texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 4))]
            ids, counts = packing.encode(tokenizer, [t.encode() for t in texts])
            want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
            assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w], texts
        assert len(packing._held[id(tokenizer)][1]) <= held
    packing._held.clear()
    monkeypatch.setattr(packing, "HELD_PARTS", 1000)
    first = packing.encode(tokenizer, [b"Some words, some more.\nAnd a line", b"words"])
    again = packing.encode(tokenizer, [b"Some words, some more.\nAnd a line", b"words"])
    assert asked[-2] > 0 and asked[-1] == 0 and all((x == y).all() for x, y in zip(first, again))


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            r = min(fit)
            rooms.remove(r)
        else:
            r = capacity
        rooms.append(r - n)
    return len(rooms)


def test_plan_is_best_fit_without_overlap():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([7, 16, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))] + [rng.randint(1, 3)] * rng.randint(0, 200)
        plan = packing.plan(Counter(lengths), capacity)
        used, ranks = defaultdict(list), defaultdict(list)
        for length, rank, n, first, offset in plan:
            ranks[length] += range(rank, rank + n)
            for k in range(n):
                used[first + k].append((offset, length))
        assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in Counter(lengths).items()}
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert sorted(used) == list(range(best_fit(lengths, capacity)))


def test_plan_is_small_for_many_pieces():
    rng = np.random.default_rng(3)
    counts = {int(n): int(c) for n, c in zip(range(1, 1025), rng.integers(1, 10**8, 1024))}
    plan = packing.plan(counts)
    total = sum(n * c for n, c in counts.items())
    made = max(first + n for _, _, n, first, _ in plan)
    assert sum(n for _, _, n, _, _ in plan) == sum(counts.values()) and len(plan) < 60_000
    assert made < 1.01 * max(-(-total // 1024), sum(c for n, c in counts.items() if n > 512))


def test_query_equals_plain_tokens(spark, make, tmp_path, tokenizer):
    rng = random.Random(4)
    data = [(i, " ".join(rng.choice(["water", "le", "stra\u00dfe", "\u6c34", "q7"]) for _ in range(rng.choice([0, 1, 5, 200, 1500]))), "en", "s", 1) for i in range(200)]
    data += [(None, None, None, None, None), (500, None, "en", "s", 1), (501, "", "en", "s", 1), (2**60 + 1, "x", "en", "s", 1), (502, "long text " * 40_000, "en", "s", 1)]
    data += [(7, "copy", "en", "s", 1)] * 150
    make(data, DOCS).repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op13(spark, str(tmp_path)).collect()
    want = []
    for doc_id, text, *_ in data:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        low = piece = 0
        while low < len(ids):
            high = low + ((len(ids) - low) % 1024 or 1024)
            want.append((str(doc_id), piece, low, high - low, zlib.crc32(np.array(ids[low:high], dtype="<u4").tobytes())))
            low, piece = high, piece + 1
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(held) == best_fit([n for _, _, _, n, _ in want], 1024)


def test_sequences_hold_all_tokens(make, tokenizer):
    data = [(i, "the water " * (i % 9 * 40), "en", "s", 1) for i in range(60)]
    pieces = packing.tokenised(make(data, DOCS), PATH, capacity=128)
    places = packing.placed(pieces, ["row"], 128)
    rows = packing.sequences(pieces, places).collect()
    docs = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) <= 128 and [d["offset"] for d in r["documents"]][0] == 0
        for d in r["documents"]:
            docs[d["doc_id"]].append((d["piece"], ids[d["offset"]:d["offset"] + d["length"]].tolist()))
    assert {i: sum((p for _, p in sorted(parts)), []) for i, parts in docs.items()} == {
        i: tokenizer.encode(t, add_special_tokens=False).ids + [2] for i, t, *_ in data}


def test_empty_table(make):
    pieces = packing.tokenised(make([], DOCS), PATH)
    assert packing.placed(pieces, ["doc_id", "row"]).collect() == []
