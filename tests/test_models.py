import itertools
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner import constants as K, schemas
from gleaner.operators import coherence, explorer, scoring, topics, vocabulary
from gleaner.plans import jobs
from gleaner.session import scratch_path
from gleaner.sources import tables

DOCS = [
    "milk sour milk date", "sour cream date late late", "price high price milk", "high price again small pack",
    "pack small sour price high", "milk date late again",
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, d.split()) for i, d in enumerate(DOCS)], "id int, tokens array<string>")


# --- vocabulary ---------------------------------------------------------------------------------

def test_doc_freq_bow_and_sizes(spark, docs, rows):
    texts = [d.split() for d in DOCS]
    df, tf = Counter(t for d in texts for t in set(d)), Counter(t for d in texts for t in d)
    assert rows(vocabulary.doc_freq(docs)) == sorted(((t, df[t], tf[t]) for t in df), key=repr)
    vocab = vocabulary.vocabulary(docs, min_df=2, max_df_share=0.5)
    want = sorted((-n, t) for t, n in df.items() if 2 <= n <= 3)
    assert [r["term"] for r in vocab.collect()] == [t for _, t in want]
    assert [r["term"] for r in vocabulary.vocabulary(docs, min_df=1, max_df_share=1.0, max_terms=2).collect()] == \
        [t for _, t in sorted((-n, t) for t, n in df.items())[:2]]
    keep = {t for _, t in want}
    bow = sorted((i, t, n) for i, d in enumerate(texts) for t, n in Counter(d).items() if t in keep)
    assert sorted(map(tuple, vocabulary.bag_of_words(docs, vocab, "id").select("id", "term", "n").collect())) == bow
    assert tuple(vocabulary.corpus_sizes(docs, vocab).first()) == (6, len(keep))


def test_lexicon_lemmas(spark, rows):
    docs = spark.createDataFrame([(1, ["prices", "boxes", "bus", "women", "xyzs", "prices"]), (2, [])], "id int, tokens array<string>")
    lexicon = spark.createDataFrame([(w,) for w in ("price", "box", "bus", "woman", "bu")], "word string")
    got = {r["id"]: r["tokens"] for r in vocabulary.lemmatize_with_lexicon(docs, lexicon, "id").collect()}
    assert got == {1: ["price", "box", "bu", "woman", "xyzs", "price"], 2: []}


# --- coherence ----------------------------------------------------------------------------------

def brute_cv(texts, topic_words, window):
    windows = []
    for d in texts:
        windows += [set(d[s:s + window]) for s in range(max(1, len(d) - window + 1))]
    n, eps, out = len(windows), 1e-12, {}
    for t, words in topic_words.items():
        p = {w: sum(w in x for x in windows) / n for w in words}

        def npmi(a, b):
            joint = sum(a in x and b in x for x in windows) / n + eps
            return math.log(joint / (p[a] * p[b])) / -math.log(joint) if p[a] and p[b] else 0.0

        rows = {a: [npmi(a, b) for b in words] for a in words}
        total = [sum(c) for c in zip(*rows.values())]
        cos = []
        for v in rows.values():
            dot = sum(a * b for a, b in zip(v, total))
            norm = math.sqrt(sum(a * a for a in v) * sum(b * b for b in total))
            cos.append(dot / norm if norm else 0.0)
        out[t] = sum(cos) / len(cos)
    return out


@pytest.mark.parametrize("window", [1, 2, 3, 4, 110])
def test_cv_against_brute_force(spark, docs, window):
    phi = spark.createDataFrame(
        [(0, w, 1.0 / (i + 1)) for i, w in enumerate(["milk", "sour", "date", "late"])]
        + [(1, w, 1.0 / (i + 1)) for i, w in enumerate(["price", "high", "pack"])], "topic int, term string, weight double")
    got = {r["topic"]: r["coherence"] for r in coherence.coherence_cv(docs, phi, top_n=4, window=window).collect()}
    want = brute_cv([d.split() for d in DOCS], {0: ["milk", "sour", "date", "late"], 1: ["price", "high", "pack"]}, window)
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_cv_on_long_documents(spark):
    random.seed(5)
    texts = [[random.choice("abcdefgh") * 3 for _ in range(n)] for n in (3, 109, 110, 111, 260)]
    docs = spark.createDataFrame([(t,) for t in texts], "tokens array<string>")
    words = ["aaa", "bbb", "ccc"]
    phi = spark.createDataFrame([(0, w, 1.0 - i / 9) for i, w in enumerate(words)], "topic int, term string, weight double")
    masks = coherence.window_masks(docs, {0: words}).agg(F.sum("n")).first()[0]
    assert masks == sum(max(1, len(t) - 109) for t in texts)
    got = coherence.coherence_cv(docs, phi, window=7).first()["coherence"]
    assert got == pytest.approx(brute_cv(texts, {0: words}, 7)[0], abs=1e-9)


# --- explorer -----------------------------------------------------------------------------------

PHI = {0: {"a": 0.5, "b": 0.3, "c": 0.2}, 1: {"a": 0.1, "b": 0.1, "d": 0.8}}
THETA = {0: ([0.9, 0.1], 10.0), 1: ([0.2, 0.8], 5.0)}


@pytest.fixture
def model(spark):
    phi = spark.createDataFrame([(t, w, x) for t, ws in PHI.items() for w, x in ws.items()], "topic int, term string, weight double")
    docs = spark.createDataFrame([(i, th, n) for i, (th, n) in THETA.items()], "id int, theta array<double>, doc_len double")
    return phi, docs


def test_explorer_tables_against_brute_force(spark, model, rows):
    phi, docs = model
    mass = {t: sum(th[t] * n for th, n in THETA.values()) for t in PHI}
    prop = {t: m / sum(mass.values()) for t, m in mass.items()}
    got = explorer.topic_mass_of(docs)
    assert {r["topic"]: (r["mass"], r["proportion"]) for r in got.collect()} == {t: pytest.approx((mass[t], prop[t])) for t in mass}
    joined = explorer.topic_mass(topics.theta_long(docs, "id"), docs.select("id", "doc_len"), "id")
    assert {r["topic"]: r["mass"] for r in joined.collect()} == {t: pytest.approx(m) for t, m in mass.items()}
    order = explorer.topic_order(got)
    assert [(r["display"], r["topic"]) for r in order.orderBy("display").collect()] == [(1, 0), (2, 1)]
    cards = explorer.topic_cards(order, tables.topic_label_table(spark, {0: "zero"}, {0: "text"}))
    assert rows(cards) == [(1, 0, "zero", "text"), (2, 1, None, None)]

    freq = explorer.term_frequency(phi, got)
    tf = {w: sum(PHI[t].get(w, 0) * mass[t] for t in PHI) for w in "abcd"}
    p = {w: f / sum(tf.values()) for w, f in tf.items()}
    assert {r["term"]: r["p_term"] for r in explorer.overall_frequency(freq).collect()} == {w: pytest.approx(x) for w, x in p.items()}

    def sal(w):
        s = sum(PHI[t].get(w, 0) for t in PHI)
        return p[w] * sum(x / s * math.log(x / s / prop[t]) for t in PHI if (x := PHI[t].get(w, 0)) > 0)

    got_sal = [(r["term"], r["saliency"]) for r in explorer.saliency(freq, 3).collect()]
    assert [w for w, _ in got_sal] == sorted("abcd", key=lambda w: -sal(w))[:3]
    assert [x for _, x in got_sal] == pytest.approx([sal(w) for w, _ in got_sal])

    for lam in (0.0, 0.6, 1.0):
        rel = explorer.relevance(freq, [lam], 2).filter("topic = 0").orderBy("rank").collect()
        want = {w: lam * math.log(x) + (1 - lam) * math.log(x / p[w]) for w, x in PHI[0].items()}
        assert [r["term"] for r in rel] == sorted(want, key=lambda w: -want[w])[:2]
        assert [r["relevance"] for r in rel] == pytest.approx(sorted(want.values(), reverse=True)[:2])
    assert explorer.relevance(freq).select("lambda").distinct().count() == 101

    share = {(r["topic"], r["term"]): r["share"] for r in explorer.token_table(freq, 0.0).collect()}
    assert share[0, "a"] == pytest.approx(PHI[0]["a"] * mass[0] / tf["a"])
    assert explorer.token_table(freq, 0.95).count() == sum(x * mass[t] >= 0.95 for t in PHI for x in PHI[t].values())

    js = explorer.topic_distance(phi, 2).collect()
    m = {w: (PHI[0].get(w, 0) + PHI[1].get(w, 0)) / 2 for w in "abcd"}
    want = sum(x * math.log(x / m[w]) for t in PHI for w, x in PHI[t].items()) / 2
    assert len(js) == 1 and js[0]["js_divergence"] == pytest.approx(want)

    path = scratch_path(spark, "explorer")
    explorer.write_explorer({"topics": order}, path)
    assert spark.read.json(f"{path}/topics").count() == 2 and os.path.isdir(f"{path}/topics")


def test_relevance_bounds_lose_no_term(spark):
    random.seed(11)
    data = [(t, f"w{i}", random.choice([0.001, 0.002, random.random()])) for t in range(3) for i in range(90) if random.random() < 0.7]
    phi = spark.createDataFrame(data, "topic int, term string, weight double")
    mass = spark.createDataFrame([(0, 5.0, 0.5), (1, 3.0, 0.3), (2, 2.0, 0.2)], "topic int, mass double, proportion double")
    freq = explorer.term_frequency(phi, mass).cache()
    whole = explorer.relevance(freq, n=7).collect()
    single = {}
    for lam in (0.0, 0.01, 0.05, 0.1, 0.37, 0.6, 0.99, 1.0):  # one value alone is never pruned
        for r in explorer.relevance(freq, [lam], n=7).collect():
            single[r["topic"], lam, r["rank"]] = (r["term"], r["relevance"])
    assert len(whole) == 3 * 101 * 7
    got = {(r["topic"], r["lambda"], r["rank"]): (r["term"], r["relevance"]) for r in whole}
    assert {k: got[k] for k in single} == single
    few = explorer.relevance(freq.filter("term < 'w15'"), n=30)
    assert few.count() == 101 * freq.filter("term < 'w15'").count()  # fewer terms than n: all stay


# --- scoring ------------------------------------------------------------------------------------

def word_model():
    """A loader that travels to the workers by value: test modules cannot be imported there."""
    def loader():
        def predict(texts, max_tokens):
            assert len(texts) <= 2
            return [[float("bad" in t), 0.5, float("good" in t)] for t in texts]
        return predict
    return loader


def test_batch_score_stays_on_its_row(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["bad", "good", "meh", None, "bad good"] * 7)], "id int, t string").repartition(3)
    out = scoring.score_with_model(df, "t", word_model(), batch_size=2)
    assert set(schemas.SCORE_ADDED) <= set(out.columns)
    for r in out.collect():
        want = {"bad": "negative", "good": "positive", "bad good": "negative"}.get(r["t"], "neutral")
        assert r["pred"] == want  # the first maximum wins for "bad good"
        assert r["prob_negative"] + r["prob_neutral"] + r["prob_positive"] == pytest.approx(1.0)
        assert r["confidence"] == max(r["prob_negative"], r["prob_neutral"], r["prob_positive"])
        assert r["score"] == pytest.approx(r["prob_positive"] - r["prob_negative"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # one call per row, whatever columns are read
    assert "score" not in scoring.score_with_model(df, "t", word_model(), with_score=False, batch_size=2).columns


def test_lexicon_score(spark):
    df = spark.createDataFrame([(1, "Bad bad good"), (2, "nothing known"), (3, None)], "id int, t string")
    lex = spark.createDataFrame([("bad", 1, 0, 0), ("good", 0, 0, 1)], "term string, w_negative int, w_neutral int, w_positive int")
    got = {r["id"]: r for r in scoring.lexicon_score(df, "id", "t", lex, 3.0).collect()}
    e = [math.exp(2), 1.0, math.exp(1)]
    assert got[1]["pred"] == "negative" and got[1]["prob_positive"] == pytest.approx(e[2] / sum(e))
    assert got[2]["pred_idx"] == 0 and got[3]["confidence"] == pytest.approx(1 / 3)


def test_linear_head(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<float>")
    r = scoring.linear_head(df, "v", [[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]]).first()
    assert r["pred"] == "neutral" and r["prob_neutral"] == pytest.approx(math.exp(2) / (math.exp(1) + math.exp(2) + math.exp(1.5)))


def test_text_classifier_learns(spark):
    data = [("awful stale bread " * 2, "negative"), ("fresh tasty bread " * 2, "positive"), ("okay plain bread " * 2, "neutral")] * 10
    df = spark.createDataFrame(data + [("unlabelled", None)], "full_text string, rating_sentiment string")
    model = scoring.train_text_classifier(df, features=1 << 10, max_iter=15)
    out = scoring.classify(df, model)
    assert out.filter("rating_sentiment != pred").count() == 0
    assert set(out.columns) == {"full_text", "rating_sentiment", *schemas.SCORE_ADDED}
    assert out.filter(F.abs(F.expr("prob_negative + prob_neutral + prob_positive") - 1) > 1e-9).count() == 0


# --- end to end ---------------------------------------------------------------------------------

THEMES = ["tough meat chicken bland dry inedible gristle fatty", "price shrink packet expensive smaller costly pricey rise"]


@pytest.fixture(scope="module")
def scored(spark):
    random.seed(7)
    data = []
    for i in range(120):
        theme = i % 2
        text = " ".join(random.choices(THEMES[theme].split(), k=12))
        data.append((f"r{i}", f"p{i % 4}", "name", ["beef", "tea"][theme], 1.0, "t", text, f"t. {text}",
                     f"2024-0{1 + i % 6}-10 00:00:00", "negative", 0.8 if i else 0.79))
    names = "review_id product_id product_name category_keyword rating title text full_text submission_time pred confidence".split()
    df = spark.createDataFrame(data, ", ".join(f"{n} {'double' if n in ('rating', 'confidence') else 'string'}" for n in names))
    return df.withColumn("submission_time", F.col("submission_time").cast("timestamp_ntz"))


def test_topic_job_recovers_two_planted_themes(spark, scored, rows):
    docs = jobs.topic_corpus(scored)
    assert docs.count() == 119  # confidence 0.80 stays, 0.79 goes
    fitted = jobs.select_topics(docs, k_values=[2, 3], passes=8)
    sweep = {r["k"]: r["coherence"] for r in fitted["sweep"].collect()}
    assert fitted["k"] == max(sorted(sweep), key=lambda k: sweep[k])
    two = jobs.select_topics(docs, k_values=[2], passes=20)
    assigned = jobs.assign_topics(docs, two).cache()
    table = Counter((r["category_keyword"], r["dominant_topic"]) for r in assigned.collect())
    majority = {c: max((n, t) for (cat, t), n in table.items() if cat == c) for c in ("beef", "tea")}
    assert majority["beef"][1] != majority["tea"][1] and sum(n for n, _ in majority.values()) >= 107
    assert assigned.filter(F.abs(F.aggregate("theta", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).count() == 0
    assert two["phi"].groupBy("topic").agg(F.sum("weight").alias("s")).filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0

    reports = jobs.topic_reports(assigned, two, {0: "First"})
    assert reports["topics_out"].columns == schemas.TOPICS_OUT
    assert reports["exemplars"].count() == 6 and reports["top_words"].filter("rank > 15").count() == 0
    assert {r["topic_name"] for r in reports["top_words"].collect()} == {"First", "Topic 1"}
    shares = reports["by_category"].select((F.col("`0`") + F.col("`1`")).alias("s")).collect()
    assert all(r["s"] == pytest.approx(100.0) for r in shares)
    tables_out = jobs.explorer_tables(assigned, two, tables.topic_label_table(spark, {0: "First", 1: "Second"}))
    assert tables_out["cards"].count() == 2 and tables_out["distance"].first()["js_divergence"] > 0.3
    assert tables_out["topics"].agg(F.sum("proportion")).first()[0] == pytest.approx(1.0)


def test_empty_documents_get_the_prior(spark, scored):
    docs = jobs.topic_corpus(scored)
    fitted = jobs.select_topics(docs, k_values=[2], passes=2)
    blank = spark.createDataFrame([("x", ["unknown"])], "review_id string, tokens array<string>")
    theta = jobs.assign_topics(blank, fitted).first()["theta"]
    alpha = fitted["model"].estimatedDocConcentration().toArray()
    assert theta == pytest.approx(list(alpha / alpha.sum()))


def test_corpus_with_lexicon(spark, scored):
    lexicon = spark.createDataFrame([("packet",), ("price",)], "word string")
    assert jobs.topic_corpus(scored, lexicon=lexicon).count() == 119


def test_best_k_prefers_the_smaller_on_ties(spark):
    sweep = spark.createDataFrame([(5, 0.4), (7, 0.5), (10, 0.5)], "k int, coherence double")
    assert tuple(topics.best_k(sweep).first()) == (7, 0.5)


def test_dominant_topic_takes_lowest_id(spark):
    df = spark.createDataFrame([([0.25, 0.5, 0.5],)], "theta array<double>")
    assert tuple(topics.dominant_topic(df).select("dominant_topic", "topic_probability").first()) == (1, 0.5)


def test_validate_job(spark, scored):
    cleaned = scored.withColumns({"rating": F.when(F.col("category_keyword") == "beef", 1.0).otherwise(5.0),
                                  "rating_sentiment": F.when(F.col("category_keyword") == "beef", "negative").otherwise("positive")})
    cleaned = cleaned.drop("pred", "confidence")

    def loader():
        return lambda texts, n: [[float("meat" in t or "dry" in t), 0.0, 0.5] for t in texts]

    out = jobs.validate(cleaned, jobs.model_scorer(loader), per_star=40, store=scratch_path(spark, "sample"))
    assert out["sample"].count() == 80
    assert {r["rating"]: r["n"] for r in out["rating_counts"].collect()} == {1: 40, 5: 40}
    assert out["confusion"].agg(F.sum("n")).first()[0] == 80 and out["accuracy"].first()[0] > 0.8
    full = jobs.score_full(cleaned, jobs.model_scorer(loader))
    assert full.count() == 120 and "Exchange" not in full._jdf.queryExecution().executedPlan().toString()


def test_temporal_job(spark, scored):
    many = scored.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(10))))
    events = tables.event_table(spark, [("2024-03-01", "e", "", ""), ("2030-01-01", "z", "", "")])
    docs = many.withColumn("dominant_topic", F.lit(1))
    out = jobs.temporal_reports(many, events, docs, quarters=["2024Q1", "2024Q2"])
    assert out["monthly"].count() == 6 and out["events"].count() == 1
    impact = out["event_impact"].first()
    assert impact["n_before"] == 200 and impact["delta"] == 0.0
    assert out["category_wide"].count() == 2 and out["topic_month"].filter("n > 0").count() == 6


def test_registry_is_consistent():
    import __spark_entry__ as entry
    names, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= names and len(names) >= 130
    assert all(itertools.chain([entry.oracle_sql()[n].strip() for n in sql]))


def test_large_lexicon_scores_as_a_small_one(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(w for w in ("good", "bad", "fine", "the") if (i + len(w)) % 3)) for i in range(20)] + [(30, None), (31, "")], "id int, t string")
    lex = spark.createDataFrame([("good", 0.0, 0.0, 1.0), ("bad", 1.0, 0.0, 0.0), ("fine", 0.0, 1.0, 0.0)], "term string, w_negative double, w_neutral double, w_positive double")
    small = sorted(map(tuple, scoring.lexicon_score(docs, "id", "t", lex, 3.0).collect()))
    monkeypatch.setattr(scoring, "SMALL_LEXICON", 2)
    assert sorted(map(tuple, scoring.lexicon_score(docs, "id", "t", lex, 3.0).collect())) == small and len(small) == 22


def test_batches_by_length_pad_less_and_score_the_same(spark):
    def loader():
        def predict(texts, max_tokens):
            return [[float(len(t)), float(t.count("a")), float(len(t.split()[:max_tokens]))] for t in texts]
        return predict

    docs = spark.createDataFrame([(i, None if i % 50 == 7 else "a b " * (i * 7919 % 211)) for i in range(500)], "id int, t string").repartition(3)
    scored = lambda by_length: sorted(map(tuple, scoring.score_with_model(docs, "t", loader, 16, 128, by_length=by_length).collect()), key=lambda r: r[0])
    assert scored(True) == scored(False)
    row = scoring.padding_report(docs, "t", 16, 128).first()
    assert row["words"] <= row["by_length"] < 1.1 * row["words"] < row["plain"]
    assert scoring.length_order(["a b c", "", "a " * 9, "a b"], 2) == [1, 0, 2, 3]


def test_window_masks_are_counted_in_batches_of_documents(spark, rows):
    """Short, long, empty and null documents; no window runs over the end of a document, and no array function per token."""
    docs = [["a", "x", "b"], [], None, ["x"] * 3 + ["a", "b"] * 2, ["b"]]
    df = spark.createDataFrame([(d,) for d in docs], "tokens array<string>").coalesce(1)
    masks = coherence.window_masks(df, {0: ["a", "b"], 3: ["b"]}, window=3)
    want = {}
    for d in docs:
        for i in range(max(1, len(d) - 2) if d else 0):
            for topic, ws in ((0, ["a", "b"]), (3, ["b"])):
                key = topic, sum(1 << j for j, w in enumerate(ws) if w in d[i:i + 3])
                want[key] = want.get(key, 0) + 1
    assert rows(masks) == sorted(((t, m, n) for (t, m), n in want.items()), key=repr)
    assert "zip_with" not in masks._jdf.queryExecution().toString()


def test_slices_hold_whole_documents(monkeypatch):
    monkeypatch.setattr(coherence, "SLICE_TOKENS", 5)
    assert list(coherence._slices(coherence.np.array([0, 9, 9, 11, 14, 15]))) == [(0, 1), (1, 4), (4, 5)]


def test_lda_in_numpy_equals_spark_ml(spark, monkeypatch):
    """Bound and shares of a model are those that Spark ML finds for it, and documents are estimated without its loop over rows."""
    rng = np.random.default_rng(3)
    themes = [["cable", "plug", "charger"], ["soup", "bread", "sugar"], ["shirt", "sleeve", "collar"]]
    rows = [(i, [str(rng.choice(themes[i % 3 if rng.random() > 0.1 else rng.integers(3)])) for _ in range(rng.integers(0, 25))]) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, []), (901, ["unknown"])], "id int, tokens array<string>").repartition(4)
    vectors = vocabulary.vectorise(docs, [t for ts in themes for t in ts]).select("id", "features").persist()
    monkeypatch.setattr(topics.LDA, "_fit", lambda *a: pytest.fail("fitted row by row"))
    fit = topics.fit_lda(vectors, 3)
    assert abs(topics.log_likelihood(fit, vectors) - fit.logLikelihood(vectors)) < 0.05
    own = {r["id"]: r["theta"] for r in topics.doc_topics(fit, vectors).collect()}
    want = {r["id"]: r["topicDistribution"].toArray() for r in fit.transform(vectors).collect()}
    alpha = fit.estimatedDocConcentration().toArray()
    assert own.keys() == want.keys()
    for i, theta in want.items():
        assert np.allclose(own[i], theta if theta.sum() else alpha / alpha.sum(), atol=0.01)
    again = topics.fit_lda(vectors.repartition(7), 3)  # documents are dealt out otherwise
    assert np.allclose(again.topicsMatrix().toArray(), fit.topicsMatrix().toArray(), rtol=1e-6)
    best = {frozenset(np.argsort(column)[-3:] // 3) for column in fit.topicsMatrix().toArray().T}
    assert best == {frozenset([0]), frozenset([1]), frozenset([2])}
    vectors.unpersist()


def test_lda_of_dense_vectors_and_without_words(spark):
    from pyspark.ml.linalg import Vectors

    sparse = spark.createDataFrame([(Vectors.sparse(3, {0: 2.0, 1: 1.0}),), (Vectors.sparse(3, {2: 4.0}),)], ["features"])
    dense = spark.createDataFrame([(Vectors.dense(2.0, 1.0, 0.0),), (Vectors.dense(0.0, 0.0, 4.0),)], ["features"])
    a, b = (topics.fit_lda(df, 2, passes=3).topicsMatrix().toArray() for df in (sparse, dense))
    assert np.allclose(a, b)
    empty = spark.createDataFrame([(Vectors.sparse(3, {}),)], ["features"])
    assert topics.fit_lda(empty, 2).topicsMatrix().toArray().shape == (3, 2)
    with pytest.raises(ValueError):
        topics.fit_lda(empty.limit(0), 2)
