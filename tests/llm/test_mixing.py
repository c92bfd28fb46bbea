import math
import re
from collections import defaultdict

import pytest

from gleaner.llm import mixing
from tests.llm.conftest import DOCS


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Water filling by repetition."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left, weight = total - sum(2 * sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        new = {s for s in names if s not in full and 2 * sizes[s] <= left * w[s] / weight}
        if not new:
            return {s: 2 * sizes[s] if s in full else left * w[s] / weight for s in names}
        full |= new


def rows(n):
    out = []
    for i in range(n):
        source = [None, "b", "a", "é", "hot"][i % 5] if i % 3 else "hot"
        out.append((i, "w " * (1 + i * 7919 % 97), "en", source, i))
    return out + [(10_000, None, "en", "b", None), (10_001, "", None, "b", None), (10_002, "x " * 5000, "en", "hot", None)]


def test_targets_and_taken(make):
    data = rows(1200)
    got = mixing.mix(make(data, DOCS)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in data)
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t, _, s, _ in data:
        sizes[s] += size(t)
    want = targets(sizes)
    by_id = {r[0]: r for r in data}
    for r in got:
        s = by_id[r["doc_id"]][3]
        assert r["size"] == size(by_id[r["doc_id"]][1]) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s], rel=1e-9)
        assert r["copies"] in (math.floor(want[s] / sizes[s] + 1e-9), math.floor(want[s] / sizes[s] + 1e-9) + 1)
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(5, 0.002 * want[s])


def test_reruns_agree_whatever_the_partitioning(make):
    df = make(rows(300), DOCS)
    pick = lambda d: sorted((r["doc_id"], r["taken"]) for r in mixing.mix(d).collect())
    assert pick(df) == pick(df.repartition(7)) == pick(df.repartition(3, "source"))


def test_every_document_is_taken_as_often_as_expected(make):
    """Mean copies over seeds follow the rate of the source."""
    df = make([(i, "w " * 10, "en", "ab"[i % 2], 0) for i in range(80)], DOCS).cache()
    n = defaultdict(int)
    for seed in range(6):
        for r in mixing.mix(df, share=1.2, seed=seed).collect():
            n[r["doc_id"]] += r["copies"]
    assert len({v for v in n.values()}) > 2  # not always the same documents
    assert sum(n.values()) == pytest.approx(6 * 1.2 * 80, abs=8)


def test_mixed_repeats_rows_and_keeps_columns(make):
    data = rows(60) + [(1, "w w w", "en", "hot", 1), (1, "w w w", "en", "hot", 1), (None, "w w", "en", "b", 1), (None, None, None, None, None)]
    df = make(data, DOCS)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    counts, want = defaultdict(int), defaultdict(int)
    for r in out.collect():
        counts[(r["doc_id"], size(r["text"]), r["source"])] += 1
    for r in mixing.mix(df).collect():
        want[(r["doc_id"], r["size"], r["source"])] += r["copies"]
    assert dict(counts) == {k: v for k, v in want.items() if v}


def test_empty_and_wordless(make):
    assert mixing.mix(make([], DOCS)).collect() == []
    assert mixing.mixed(make([], DOCS)).collect() == []
    got = mixing.mix(make([(1, "", "en", "a", 0), (2, None, "en", None, 0)], DOCS)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


def test_a_third_of_the_rows_are_one_document(make, monkeypatch):
    """Repeated rows and rows without an id, beyond what one task handles in a list."""
    monkeypatch.setattr(mixing, "CHUNK", 50)
    data = rows(500)[:-1] + [(7, "w w w", "en", "hot", 1)] * 150 + [(None, None, None, None, None)] * 120 + [
        (None, f"a b c{i}", "en", "hot", i) for i in range(130)]  # one entry, different texts
    df = make(data, DOCS).repartition(5)
    got = mixing.mix(df).collect()
    assert len(got) == len(data)
    of = lambda i, n, s: [r["copies"] for r in got if (r["doc_id"], r["size"], r["source"]) == (i, n, s)]
    assert len(of(7, 3, "hot")) == 150 and len(of(None, 3, "hot")) == 130 and len(of(None, 0, None)) == 120
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = targets(sizes)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(5, 0.002 * want[s])
    rate = want["hot"] / sizes["hot"]
    assert abs(sum(of(7, 3, "hot")) - 150 * rate) < 1 + 1e-6 and abs(sum(of(None, 3, "hot")) - 130 * rate) < 1 + 1e-6
    out = mixing.mixed(df)
    assert out.columns == df.columns
    counts, expected = defaultdict(int), defaultdict(int)
    for r in out.collect():
        counts[(r["doc_id"], size(r["text"]), r["source"])] += 1
    for r in got:
        expected[(r["doc_id"], r["size"], r["source"])] += r["copies"]
    assert dict(counts) == {k: v for k, v in expected.items() if v}
    each = defaultdict(int)
    for r in out.filter("doc_id IS NULL AND source = 'hot'").collect():
        each[r["text"]] += 1
    assert set(each.values()) <= {math.floor(rate), math.floor(rate) + 1}


def test_fractions_of_repeated_rows_are_settled_once(make):
    """Three rows of one document at a rate of 1.5: four or five copies in all, by the draw of one fraction."""
    seen = set()
    for seed in range(4):
        data = [(1, "w w w w", "en", "a", 0)] * 3 + [(2 + i, "w w w w", "en", "a", 0) for i in range(9)]
        got = mixing.mix(make(data, DOCS), seed=seed).collect()
        seen.add(sum(r["copies"] for r in got if r["doc_id"] == 1))
        assert sum(r["copies"] for r in got) == 18
    assert seen <= {4, 5}
