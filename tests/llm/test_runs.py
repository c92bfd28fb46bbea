import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from gleaner.llm import queries, runs
from tests.llm.conftest import DOCS


def plain(words, times=4, least=6):
    """All runs by comparing every word with that p words further on."""
    seen, out = set(), []
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            length = i - start + p
            if i > start and length >= max(least, times * p) and (start, length) not in seen:
                seen.add((start, length))
                out.append((start, length, p))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    drop = {i for s, length, p in found for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def made(rng):
    words = []
    for _ in range(rng.randint(0, 8)):
        phrase = [str(rng.randint(1, rng.choice([1, 2, 3, 50]))) for _ in range(rng.randint(1, rng.choice([2, 5, 40])))]
        words += phrase * rng.choice([1, 2, 3, 4, 5, 9, 60])
        words = words[:len(words) - rng.randint(0, min(3, len(words)))]
    return rng.choice([" ", "\n", " \t"]).join(words)


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        texts = [made(rng) for _ in range(rng.randint(0, 6))]
        for text, (n, found, rest) in zip(texts, runs.runs_of([t.encode() for t in texts])):
            words = text.split()
            assert n == len(words) and [tuple(r) for r in found.tolist()] == plain(words)
            assert rest.decode() == collapsed(words, plain(words))


def test_extensions_equal_brute_force():
    rng = np.random.default_rng(2)
    for sigma, n in ((1, 200), (2, 500), (3, 31), (40, 300), (2, 1), (2, 0)):
        words = rng.integers(0, sigma, n)
        ext = runs.Extensions(words)
        if n < 2:
            continue
        i, j = rng.integers(0, n, (2, 300))
        i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
        want = [next((k for k in range(n - b) if words[a + k] != words[b + k]), n - b) for a, b in zip(i, j)]
        assert ext.lce(i, j).tolist() == want


def test_one_word_repeated_and_words_apart():
    assert runs.runs_of([b"a " * 100_000])[0][1].tolist() == [[0, 100_000, 1]]
    assert [r.tolist() for _, r, _ in runs.runs_of([b"a a a a a", b"a a a a a a", None, b"", "a\u00a0a ".encode() * 6])] == [
        [], [[0, 6, 1]], [], [], [[0, 6, 1]]]
    # Equal texts beside each other never make one run.
    assert all(not len(r) for _, r, _ in runs.runs_of([b"x y x y"] * 50))


def test_query_equals_brute_force(spark, make, tmp_path):
    rng = random.Random(3)
    data = [(i, made(rng), "en", "s", 1) for i in range(300)]
    data += [(300 + i, " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(0, 400))), "en", "s", 1) for i in range(300)]
    data += [(900, None, None, None, None), (901, "", "en", "s", 1), (None, "a b " * 9, "en", "s", 1), (5, data[5][1], "en", "s", 1), (2**60 + 1, "q", "en", "s", 1),
             (902, "long phrase " * 30_000, "en", "s", 1)]
    make(data, DOCS).repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op11(spark, str(tmp_path)).collect()
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]) for r in rows)
    want, planted = [], 0
    for doc_id, text, *_ in data:
        words = (text or "").split()
        n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        found = plain(words) if n < 50_000 else [(0, n, 2)]
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
        text = "".join(f"{s},{length},{p}\n" for s, length, p in found)
        want.append(((doc_id is None, doc_id or 0), len(found), *best, best[1] and 1000 * best[1] // best[2],
                     hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(collapsed(words, found).encode()).hexdigest()))
    assert planted > 30 and got == sorted(want, key=lambda r: r[0])
    schema = {f.name: f.dataType.simpleString() for f in queries.op11(spark, str(tmp_path)).schema}
    assert {schema[c] for c in ("n_runs", "start", "length", "period", "exponent_milli")} == {"bigint"}


def test_empty_table(make):
    assert runs.find(make([], DOCS)).collect() == []


def test_strongest_prefers_exact_ratio_then_start(spark):
    one = spark.createDataFrame([([(0, 13, 3), (5, 26, 6), (9, 35, 8)],), ([],), ([(0, 12, 3), (7, 16, 4)],)],
                                "runs array<struct<start: bigint, length: bigint, period: bigint>>")
    assert [tuple(r[0]) if r[0] else None for r in one.select(runs.strongest(F.col("runs"))).collect()] == [(9, 35, 8), None, (0, 12, 3)]
