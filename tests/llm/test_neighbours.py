import numpy as np

from gleaner.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, ids, k):
    rows = {i: np.array(v, dtype=np.float64) for i, v in rows}
    out = []
    for q in ids:
        s = sorted((-(rows[q] @ v) / (np.linalg.norm(rows[q]) * np.linalg.norm(v)), i) for i, v in rows.items() if i != q)
        out.append([i for _, i in s[:k]])
    return out


def result(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return got


def test_recall_and_exact_scores(make):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=24))]) for i in range(1500)]
    df = make(rows, SCHEMA)
    got = result(neighbours.nearest(df, df.filter("vec_id % 50 = 0")))
    want = brute(rows, sorted(got), 5)
    found = np.mean([len({v for _, v, _ in got[q]} & set(w)) / 5 for q, w in zip(sorted(got), want)])
    assert len(got) == 30 and found >= 0.9
    vectors = dict(rows)
    for q, hits in got.items():
        assert [r for r, _, _ in hits] == [1, 2, 3, 4, 5]
        for _, v, s in hits:
            a, b = np.array(vectors[q]), np.array(vectors[v])
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_copies_ties_and_bad_vectors(make):
    same = [1.0, 2.0, 0.0]
    rows = [(i, same) for i in range(40)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 1.0]), (103, [float("nan"), 1.0, 1.0]),
            (104, [float("inf"), 1.0, 1.0]), (105, []), (None, [1.0, 1.0, 1.0]), (150, [1.0, 0.0]), (50, [2.0, 4.0, 0.0]), (51, [0.0, 0.0, 1.0])]
    df = make(rows, SCHEMA)
    got = result(neighbours.nearest(df, df.filter("vec_id % 50 = 0 OR vec_id = 7")))
    assert sorted(got) == [0, 7, 50]
    assert [v for _, v, _ in got[0]] == [1, 2, 3, 4, 5]
    assert [v for _, v, _ in got[7]] == [0, 1, 2, 3, 4]
    assert [v for _, v, _ in got[50]] == [0, 1, 2, 3, 4]


def test_a_third_of_the_rows_on_one_ray(make):
    rng = np.random.default_rng(5)
    ray = rng.integers(-9, 10, 16)
    rows = [(i, [float(x) for x in (ray * int(rng.integers(1, 900)) if i % 3 == 1 else rng.integers(-9, 10, 16))]) for i in range(1800)]
    near = [(10_000 + i, [float(x) for x in ray * 1000 + rng.integers(-1, 2, 16)]) for i in range(300)]  # hardly another direction
    df = make(rows + near, SCHEMA)
    got = result(neighbours.nearest(df, df.filter("vec_id % 50 = 0"), rerank=0.05))
    vectors = {i: np.array(v) for i, v in rows + near}
    for q in (100, 250, 400):  # on the ray
        hits = got[q]
        assert [v for _, v, _ in hits] == [i for i in range(1, 40, 3) if i != q][:5] and all(abs(s - 1) < 1e-12 for _, _, s in hits)
    for q, hits in got.items():
        for _, v, s in hits:
            a, b = vectors[q], vectors[v]
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    want = brute(rows + near, sorted(got), 5)
    assert np.mean([got[q][0][2] >= vectors[q] @ vectors[w[0]] / np.linalg.norm(vectors[q]) / np.linalg.norm(vectors[w[0]]) - 1e-12
                    for q, w in zip(sorted(got), want)]) > 0.8


def test_what_ties_with_the_cut_is_ranked(make):
    # Vectors in so few directions that their pivot orders are all alike.
    rows = [(i, [1.0, (i % 7) / 1e6]) for i in range(500)]
    df = make(rows, SCHEMA)
    got = result(neighbours.nearest(df, df.filter("vec_id = 0"), rerank=0.01))
    assert [v for _, v, _ in got[0]] == [7, 14, 21, 28, 35]


def test_fewer_candidates_and_empty(make):
    df = make([(0, [1.0, 0.0]), (1, [0.0, 1.0])], SCHEMA)
    got = result(neighbours.nearest(df, df.filter("vec_id = 0")))
    assert [(r, v) for r, v, _ in got[0]] == [(1, 1)]
    empty = make([], SCHEMA)
    assert neighbours.nearest(empty, empty).collect() == []


def test_footrule():
    orders = np.array([[0, 1, 2], [2, 1, 0], [3, 4, 5]])
    files = neighbours.InvertedFiles(orders, 6)
    place = lambda o, p: list(o).index(p) if p in o else 3
    for q in ([0, 1, 2], [1, 5, 0]):
        want = [sum(abs(place(o, p) - place(q, p)) for p in range(6)) for o in orders]
        assert files.footrule(np.array(q)).tolist() == want
