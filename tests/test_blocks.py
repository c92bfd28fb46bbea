"""Documents in blocks of word counts, and the lexicon score that meets its terms by them."""

import random
from collections import Counter

import pytest

from gleaner.operators import scoring
from gleaner.operators.blocks import word_blocks


@pytest.mark.parametrize("most", [(2_000, 400_000), (3, 400_000), (2_000, 4)])
def test_blocks_hold_every_word(spark, most):
    rng = random.Random(1)
    rows = [(i % 7 if i % 5 else None, [rng.choice(["a", "b", "ccc", "d", None]) for _ in range(rng.randint(0, 9))]) for i in range(60)] + [(1, None), (2, [])]
    found = []
    for r in word_blocks(spark.createDataFrame(rows, "k int, tokens array<string>").repartition(3), "k", "tokens", *most).collect():
        assert len(r["keys"]) <= most[0] and len(r["ends"]) == len(r["keys"]) + 1 and len(set(r["terms"])) == len(r["terms"])
        for i, key in enumerate(r["keys"]):
            span = range(r["ends"][i], r["ends"][i + 1])
            found.append((key, sorted((r["terms"][r["places"][j]], r["counts"][j]) for j in span)))
    want = [(k, sorted(Counter(w for w in words or () if w is not None).items())) for k, words in rows]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_large_lexicon_meets_blocks(spark, rows, monkeypatch):
    """The same scores as from a lexicon that is sent to the tasks, with repeated and null keys, and no shuffle by document and term."""
    rng = random.Random(2)
    words = ["soup", "bread", "plug", "cable", "shirt", "unknown"]
    texts = [(i % 40 if i % 9 else None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(120)] + [(7, None), (500, ""), (501, "unknown")]
    docs = spark.createDataFrame(texts, "seq int, text string").repartition(4)
    lexicon = spark.createDataFrame([("soup", 0.5, 0.0, 1.0), ("bread", 1.0, None, 0.25), ("plug", 0.0, 2.0, 0.0), ("cable", 1.0, 0.0, 0.0),
                                     ("cable", 0.0, 0.0, 3.0), (None, 1.0, 1.0, 1.0)], "term string, w_negative double, w_neutral double, w_positive double")
    small = scoring.lexicon_score(docs, "seq", "text", lexicon, scale=4.0)
    monkeypatch.setattr(scoring, "SMALL_LEXICON", 0)
    large = scoring.lexicon_score(docs, "seq", "text", lexicon, scale=4.0)
    plain = lambda df: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows(df)]
    assert plain(small) == plain(large) and len(plain(large)) == 43
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = large._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(block" in plan and not any(
        "hashpartitioning(seq" in line and "term" in line for line in plan.splitlines())
