import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gleaner.llm import language, quality, toxicity
from tests.llm.conftest import DOCS

WORDS = {"en": "the and house with water from light stone which they".split(), "de": "und das haus mit wasser aus licht stein welche sie".split(),
         "fr": "et la maison avec eau dans lumière pierre laquelle elles".split()}


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def corpus(n, rng):
    out = []
    for i in range(n):
        lang = ["en", "de", "fr"][i % 3]
        out.append((i, " ".join(rng.choice(WORDS[lang], 40)), lang, "s", 1))
    return out


ODD = [(9001, None, "en", "s", 1), (9002, "", None, "s", 1), (9003, "123 !?", "de", "s", 1), (None, "the house and the water", None, None, None),
       (9004, "the house and " * 40_000, None, "s", 1), (9005, "the house and the water", "en", "s", 1), (9005, "the house and the water", "en", "s", 1)]


def test_language_accuracy_and_odd_rows(make):
    data = corpus(300, np.random.default_rng(0)) + ODD
    rows = language.predictions(make(data, DOCS)).collect()
    assert len(rows) == len(data)
    by_id = {r["doc_id"]: r for r in rows}
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([by_id[i]["lang_pred"] == lang for i, _, lang, *_ in data[:300]]) > 0.98
    assert [by_id[i]["lang_pred"] for i in (9001, 9002, 9003, None, 9004)] == ["und", "und", "und", "en", "en"]
    assert by_id[9001]["score"] == 0


def test_language_mixture_finds_both(make):
    counts = []
    for lang, words in WORDS.items():
        f, n = np.unique(language.trigrams(" ".join(words * 50)), return_counts=True)
        counts.append(pd.DataFrame({"lang": lang, "feature": f, "n": n}))
    model = language.Model(pd.concat(counts))
    langs, shares = model.identify(" ".join(WORDS["en"] * 6 + WORDS["fr"] * 3))
    assert langs == ["en", "fr"] and shares[0] > shares[1] > 0.2 and abs(sum(shares) - 1) < 0.05
    assert model.identify(" ".join(WORDS["de"] * 5))[0] == ["de"]


def test_language_without_labels_or_rows(make):
    assert language.predictions(make([], DOCS)).collect() == []
    rows = language.predictions(make([(1, "the house", None, "s", 1), (2, None, None, "s", 1)], DOCS)).collect()
    assert {r["lang_pred"] for r in rows} == {"und"}


def good(rng):
    return ". ".join(" ".join(rng.choice(WORDS["en"], 8)).capitalize() for _ in range(6)) + "."


def auc(rows, truth):
    pos = [r["score"] for r in rows if truth.get(r["doc_id"]) == 1 and r["held_out"]]
    neg = [r["score"] for r in rows if truth.get(r["doc_id"]) == 0 and r["held_out"]]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


LABELS = "doc_id long, label int"


def test_quality_on_held_out_rows(make):
    rng = np.random.default_rng(1)
    data = [(i, good(rng) if i % 4 else good(rng).upper().replace(" ", "!! "), "en", "s", 1) for i in range(300)] + ODD
    truth = {i: int(i % 4 > 0) for i in range(300)}
    labels = make([*truth.items(), (5, None), (None, 1), (77_777, 1)], LABELS)
    rows = quality.predictions(make(data, DOCS), labels).collect()
    assert len(rows) == len(data) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == held(r["doc_id"]) for r in rows)
    assert auc(rows, truth) > 0.99


def test_quality_one_class_no_labels_empty(make):
    docs = make(ODD, DOCS)
    assert {r["score"] for r in quality.predictions(docs, make([], LABELS)).collect()} == {quality.predictions(docs, make([], LABELS)).first()["score"]}
    one = quality.predictions(docs, make([(9002, 1), (9003, 1), (9005, 1)], LABELS)).collect()
    assert all(r["score"] > 0.9 for r in one)
    assert quality.predictions(make([], DOCS), make([], LABELS)).collect() == []


def test_isotonic_levels():
    n, ones = np.array([4, 0, 4, 2, 6]), np.array([2, 0, 1, 2, 3])
    levels = quality.pool_adjacent(n, ones)
    assert (np.diff(levels) >= 0).all() and len(levels) == 5
    assert levels[0] == levels[2] == 3 / 8 and levels[3] == levels[4] == 5 / 8


def test_toxicity_on_held_out_rows(make):
    rng = np.random.default_rng(2)
    data = []
    for i in range(400):
        words = list(rng.choice(WORDS["en"] + WORDS["fr"], 30))
        if i % 5 == 0:
            words[rng.integers(30)] = rng.choice(["blarghly", "blarghish", "blarghed"])
        data.append((i, " ".join(words), "en", "s", 1))
    truth = {i: int(i % 5 == 0) for i in range(400)}
    rows = toxicity.predictions(make(data + ODD, DOCS), make([*truth.items(), (7, None), (None, 0), (0, 1)], LABELS)).collect()
    assert len(rows) == 400 + len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    out = [i for i in truth if held(i)]
    assert np.mean([by_id[i]["predicted"] == truth[i] for i in out]) > 0.97 and auc(rows, truth) > 0.97
    assert by_id[9001]["predicted"] == by_id[9002]["predicted"] == by_id[9004]["predicted"] == 0


def test_toxicity_fit_of_many_partitions_equals_numpy(make):
    rng = np.random.default_rng(3)
    data = [(i, " ".join(rng.choice(WORDS["en"], 25)) + (" blargh" if i % 3 == 0 else " fine"), int(i % 3 == 0)) for i in range(240)]
    rows = make(data, "doc_id long, text string, label int", extra=False).repartition(211, "doc_id")
    model = toxicity.fit(rows, rounds=1)

    pos, neg = np.zeros(toxicity.N_FEATURES), np.zeros(toxicity.N_FEATURES)
    for _, text, label in data:
        (pos if label else neg)[toxicity.ngrams(text)] += 1
    n_pos, n_neg, share = 80, 160, 80 / 240
    p, q = pos + share, neg + 1 - share
    ratio = np.log(p / n_pos) - np.log(q / n_neg)
    ratio = np.sign(ratio) * np.maximum(0, np.abs(ratio) - 2 * np.sqrt(1 / p + 1 / q))
    kept = np.flatnonzero(ratio)
    assert set(np.flatnonzero(model.weights)) <= set(kept)
    ordered = rows.select("text", "label", F.xxhash64("doc_id", "text").alias("o")).repartition(
        toxicity.SHARDS, F.pmod("o", F.lit(toxicity.SHARDS))).withColumn("shard", F.spark_partition_id()).collect()
    shards = [sorted(((r["o"], np.searchsorted(kept, np.intersect1d(toxicity.ngrams(r["text"]), kept)).astype(np.int32).tobytes(), r["label"])
                      for r in ordered if r["shard"] == k)) for k in {r["shard"] for r in ordered}]
    start, r32 = np.append(np.zeros(len(kept)), np.log(n_pos / n_neg)), ratio[kept].astype(np.float32)
    fits = []
    for shard in shards:
        w, seen = start.copy(), np.ones(len(start))
        for _ in range(2):
            for _, found, label in shard:
                found = np.frombuffer(found, np.int32)
                x = r32[found]
                gap = 1 / (1 + np.exp(-(w[found] @ x + w[-1]))) - label
                g = gap * x + 1e-4 * w[found]
                seen[found] += g * g
                w[found] -= 0.5 * g / np.sqrt(seen[found])
                seen[-1] += gap * gap
                w[-1] -= 0.5 * gap / np.sqrt(seen[-1])
        fits.append(w)
    want = np.mean(fits, axis=0)
    assert np.allclose(model.weights[kept], want[:-1] * r32, atol=1e-4) and abs(model.intercept - want[-1]) < 1e-4


def test_toxicity_one_class_no_labels_empty(make):
    docs = make(ODD, DOCS)
    assert {r["score"] for r in toxicity.predictions(docs, make([], LABELS)).collect()} == {0.5}
    assert all(r["score"] > 0.99 for r in toxicity.predictions(docs, make([(9002, 1), (9003, 1), (9005, 1)], LABELS)).collect())
    assert toxicity.predictions(make([], DOCS), make([], LABELS)).collect() == []


def test_ngrams_stay_within_words():
    a, b = set(toxicity.ngrams("abc").tolist()), set(toxicity.ngrams("abc xyz").tolist())
    assert a <= b and set(toxicity.ngrams("xyz ABC!").tolist()) == b
    assert len(toxicity.ngrams(None)) == len(toxicity.ngrams("12")) == 0
