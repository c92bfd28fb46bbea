import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st

from gleaner.llm import simhash
from gleaner.llm.components import connected_components
from tests.llm.conftest import DOCS

BASE = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark wood at night"


def slow_fingerprint(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not w:
        return 0
    s = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, j in pairs:
        parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.none(), st.text(max_size=60), st.lists(st.sampled_from(["A", "b", "ä", "a b", "\t", "\n", "x1"]), max_size=30).map(" ".join)))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_trie_join_matches_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for x in base[:150] for k in (1, 4, 5)]
    dense = [int(base[0]) ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)]
    v = np.unique(np.concatenate([base, np.array(near + dense, dtype=np.uint64)]))
    at = {int(x): i for i, x in enumerate(v)}
    want = components(len(v), zip(*np.nonzero(np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= 4, 1))))
    pairs = lambda e: [(at[int(a)], at[int(b)]) for a, b in zip(*e)]
    assert components(len(v), pairs(simhash.join_tries(v, None, 4))) == want
    shuffled = rng.permutation(len(v))
    a, b = np.sort(v[shuffled[:300]]), np.sort(v[shuffled[300:]])
    assert components(len(v), pairs(simhash.join_tries(a, None, 4)) + pairs(simhash.join_tries(b, None, 4)) + pairs(simhash.join_tries(a, b, 4))) == want


def test_near_duplicates_against_all_pairs(make, monkeypatch):
    monkeypatch.setattr(simhash, "SUBTREE", 8)  # several subtrees, and several pieces of one
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 120)) for _ in range(40)]
    data = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " end") for i, t in enumerate(texts[:20])]
    data += [(200, None), (201, ""), (202, "  \t"), (203, "one"), (204, "ONE"), (205, BASE), (206, BASE.upper()), (206, BASE), (None, BASE), (None, "solo text"), (300, "w " * 100_000)]
    rows = simhash.near_duplicates(make([(i, t, "en", "s", 1) for i, t in data], DOCS), keep_hash=True).collect()
    fps = [slow_fingerprint(t) for _, t in data]
    v = np.array(fps, dtype=np.uint64)
    label = components(len(v), zip(*np.nonzero(np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= 4, 1))))
    smallest = {r: min((data[i][0] for i in range(len(data)) if label[i] == r and data[i][0] is not None), default=None) for r in set(label)}
    want = sorted(str((i, f, smallest[r])) for (i, _), f, r in zip(data, fps, label))
    assert sorted(str((r["doc_id"], r["fp"] % 2**64, r["component_id"])) for r in rows) == want


def test_empty(make):
    assert simhash.near_duplicates(make([], DOCS)).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, j) for j in range(101, 180)] + [(500, 500), (7, 6)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = lambda x: got.get(x, x)
    assert len({root(x) for x in range(41)}) == 1 and len({root(x) for x in range(100, 180)}) == 1
    assert root(0) != root(100) and 500 not in got


def test_subtrees_grow_so_that_the_shuffle_stays_in_proportion(spark, monkeypatch):
    """Bytes of all subtree pairs a fingerprint: with ever more levels they grow with the input, with bounded ones they do not."""
    monkeypatch.setattr(simhash, "SUBTREE", 16)
    rng = np.random.default_rng(6)

    def bytes_each(n):
        fps = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1))
        df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
        return simhash._subtree_pairs(df, 4).selectExpr("sum(length(left_fps) + length(fps))").first()[0] / len(fps)

    monkeypatch.setattr(simhash, "MOST_BITS", 6)
    small, large = bytes_each(2_000), bytes_each(16_000)
    assert large < 1.3 * small
    monkeypatch.setattr(simhash, "MOST_BITS", 60)
    assert bytes_each(16_000) > 1.8 * small


def test_bounded_levels_find_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:80]:
        for _ in range(3):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    values = np.array(sorted(fps), dtype=np.uint64)
    df = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long")

    def groups():
        root = {int(v): int(v) for v in values.view(np.int64)}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x
        for r in simhash.fingerprint_links(df, 4).collect():
            a, b = top(r["u"]), top(r["v"])
            root[max(a, b)] = min(a, b)
        return sorted(sorted(k for k in root if top(k) == t) for t in {top(k) for k in root})

    want = groups()
    monkeypatch.setattr(simhash, "SUBTREE", 8)
    monkeypatch.setattr(simhash, "MOST_BITS", 3)
    assert groups() == want and max(map(len, want)) >= 4
