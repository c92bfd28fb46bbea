import re

from gleaner.llm import decontamination as d
from tests.llm.conftest import DOCS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=10):
    out = {}
    for i, t, *_ in docs:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(window, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == v[s:s + n] and item is not None:
                        hit |= set(range(p, p + n))
                        ids.add(str(item))
        out[i] = (len(w), len(hit), sorted(ids))
    return out


def doc(i, text):
    return (i, text, "en", "s", None)


DOC_ROWS = [
    doc(1, LONG), doc(2, "X1 " + LONG.upper() + " -- " + LONG), doc(3, None), doc(4, ""), doc(5, "?!"), doc(6, "tiny item"),
    doc(7, "the Tiny  item, twice tiny item"), doc(8, " ".join(LONG.split()[:9])), doc(9, "äÄ Ünï " + LONG[:20]),
    doc(10, "w " * 30000 + LONG), doc(11, "b b b b b b b b b b b b"), doc(12, "ab" * 50000)]
ITEMS = [(1, LONG), (10, "tiny item"), (2, None), (3, ""), (None, LONG), (4, "b " * 10), (1, "äÄ ünï")]


def test_against_brute_force(make, spark):
    docs, items = make(DOC_ROWS, DOCS), make(ITEMS, "item_id long, text string")
    rows = d.contamination(docs, items).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in rows}
    assert got == brute(DOC_ROWS, ITEMS)
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in rows)


def test_repeated_rows_null_ids_and_empty(make):
    docs = make([doc(None, LONG), doc(None, LONG), doc(1, LONG), doc(1, LONG)], DOCS)
    items = make([(7, LONG)], "item_id long, text string")
    rows = d.contamination(docs, items).collect()
    assert sorted((str(r["doc_id"]), r["n_hit"]) for r in rows) == [("1", 12)] * 2 + [("None", 12)] * 2
    assert d.contamination(make([], DOCS), items).collect() == []
    assert [r["n_hit"] for r in d.contamination(docs, make([], "item_id long, text string")).collect()] == [0] * 4


def test_spans_do_not_cross_documents(make):
    half = LONG.split()
    docs = make([doc(1, " ".join(half[:6])), doc(2, " ".join(half[6:]))], DOCS).coalesce(1)
    index = d.build_index(docs)
    assert d.phrase_matches(index, make([(1, LONG)], "item_id long, text string")).count() == 0


def test_phrase_positions_and_proximity(make):
    docs = make([doc(1, "one two " + LONG + " three"), doc(2, "iota beta x gamma delta alpha y zeta eta epsilon theta"), doc(3, "alpha beta")], DOCS)
    index = d.build_index(docs)
    items = make([(5, LONG)], "item_id long, text string")
    spans = [(r["doc_id"], r["start"], r["length"]) for r in d.phrase_matches(index, items).collect()]
    assert spans == [(1, 2, 12)]
    near = {r["doc_id"]: (r["start"], r["n_found"], r["n_distinct"]) for r in d.proximity_matches(index, items, span=14, share=0.7).collect()}
    assert near[1][1:] == (12, 12) and near[2] == (0, 9, 12) and 3 not in near


def test_proximity_span_grows_with_the_item(make):
    long = [f"w{i}" for i in range(70)]
    index = d.build_index(make([doc(1, "x y " + " ".join(reversed(long)) + " z"), doc(2, " q q ".join(long))], DOCS))
    items = make([(5, " ".join(long))], "item_id long, text string")
    # The words of document 2 lie three times as far apart: 47 of 70 in a stretch of 140.
    assert [(r["doc_id"], r["n_found"], r["n_distinct"]) for r in d.proximity_matches(index, items).collect()] == [(1, 70, 70)]
    assert d.proximity_matches(index, items, span=40).collect() == []


def test_pack_round_trip():
    import numpy as np
    v = np.array([0, 5, 5, 2, 2**31 - 1], dtype=np.int32)
    assert d._unpack(d._pack(v), np.int32).tolist() == v.tolist()
    u = np.array([1, 2**63, 2**64 - 1], dtype=np.uint64)
    assert d._unpack(d._pack(u), np.uint64).tolist() == u.tolist()


def test_proximity_equals_brute_force(make):
    import random
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary[:rng.choice([5, 20, 60])], k=rng.randint(1, 18)))) for i in range(30)] + [(40, ""), (41, None)]
    texts = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.choice([0, 3, 40, 200]))
        if i % 3 == 0:
            planted = items[i % 30][1].split()
            rng.shuffle(planted)
            at = rng.randint(0, len(words))
            words[at:at] = planted
        texts.append((i, " ".join(words)))
    docs = make([doc(i, t) for i, t in texts], DOCS).repartition(3)
    for span, share in ((None, 0.8), (12, 0.9), (7, 0.5)):
        got = {(r["doc_id"], r["item_id"]) for r in d.proximity_matches(d.build_index(docs), make(items, "item_id long, text string"), span, share).collect()}
        want = set()
        for i, t in texts:
            words = t.split()
            for item, text in items:
                own = set((text or "").split())
                width = span or max(40, 2 * len((text or "").split()))
                need = -(-len(own) * round(share * 10) // 10)
                if own and any(len(own & set(words[s:s + width])) >= need for s in range(len(words))):
                    want.add((i, str(item)))
        assert got == want and len(want) > 10
