from collections import Counter

import numpy as np

import corpus_pipeline as pipeline
from tests.llm.conftest import DOCS


def test_stages_take_effect(spark, make, tmp_path):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(20)
    data = [(i, text(60), "en", "ab"[i % 2], 1) for i in range(60)]
    data += [(100, data[3][1], "en", "a", 1), (101, data[4][1] + " " + text(1), "en", "b", 1)]
    data += [(200, None, "en", "a", 1), (201, "123 456", "en", "a", 1), (300, text(30) + " " + item + " " + text(5), "en", "b", 1), (5, data[5][1], "en", "b", 1)]
    make(data, DOCS, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, fn) in enumerate(pipeline.STAGES):
        out = fn(spark, docs, str(tmp_path))
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(Counter(r["doc_id"] for r in docs.select("doc_id").collect()))
    language, distinct, clean, mixed, sharded = seen
    assert set(r[0] for r in data) - set(language) == {200, 201}
    assert set(language) - set(distinct) <= {100, 101} and 100 not in distinct and distinct[5] == 1
    assert set(distinct) - set(clean) == {300}
    assert set(mixed) <= set(clean) and max(mixed.values()) <= 2 and mixed == sharded
    n = Counter(r["shard"] for r in docs.collect())
    assert max(n.values()) - min(n.get(s, 0) for s in range(pipeline.N_SHARDS)) <= 1
    again = pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, again.collect())) == sorted(map(str, docs.collect()))


def test_empty_and_clashing_names(spark, make, tmp_path):
    make([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
    docs = make([(1, "some words here", "en", "a", 1), (None, None, None, None, None)], DOCS)
    for _, fn in pipeline.STAGES[:-1]:
        docs = fn(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in docs.collect()} <= {1}


def test_of_repeated_rows_the_first_stays_whatever_the_partitioning(make, tmp_path, spark):
    data = [(7, "one two three four five", lang, source, n) for lang, source, n in (("en", "b", 2), ("en", "a", 3), (None, "a", 9), ("en", "a", 1))]
    data += [(8, "six seven eight nine ten", "en", None, None), (8, "six seven eight nine ten", "en", "z", 1)]
    want = {(7, None, "a", 9), (8, "en", None, None)}
    for n in (1, 5):
        docs = make(data, DOCS, extra=False).repartition(n, "n_chars")
        kept = pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()
        assert {(r["doc_id"], r["lang"], r["source"], r["n_chars"]) for r in kept} == want and len(kept) == 2
