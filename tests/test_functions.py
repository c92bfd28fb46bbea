import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions import dates, scores, text as tx


def one(spark, expr_of, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr_of(F.col("x"))).first()[0]


@pytest.mark.parametrize("value,want", [
    ("  a\t b\n\nc ", "a b c"), ("a  b", "a b"), ("a\x1cb", "a b"), ("", ""), (None, None),
    ("　", ""),
])
def test_normalise_whitespace(spark, value, want):
    assert one(spark, tx.normalise_whitespace, value) == want


@pytest.mark.parametrize("value,want", [("a b  c", 3), ("", 0), ("  ", 0), ("x", 1), ("a b", 2), (None, None)])
def test_word_count(spark, value, want):
    assert one(spark, tx.word_count, value) == want


def test_nonblank(spark):
    assert [one(spark, tx.is_nonblank, v) for v in ("a", " ", " ", "", None)] == [True, False, False, False, None]


def test_full_text_keeps_leading_stop_for_missing_title(spark):
    df = spark.createDataFrame([(None, "body"), ("t ", None), (" a", " b\n")], "a string, b string")
    got = [r[0] for r in df.select(tx.full_text(F.col("a"), F.col("b"))).collect()]
    assert got == [". body", "t .", "a. b"]


def test_char_length_counts_code_points_and_short_limit(spark):
    assert one(spark, tx.char_length, "é😀x") == 3
    assert one(spark, lambda c: tx.is_short(tx.char_length(c)), "x" * 19) is True
    assert one(spark, lambda c: tx.is_short(tx.char_length(c)), "x" * 20) is False


def test_snippets(spark):
    assert one(spark, lambda c: tx.snippet(c, 3), "abcdef") == "abc..."
    assert one(spark, lambda c: tx.snippet(c, 3, "when_cut"), "abc") == "abc"
    assert one(spark, lambda c: tx.snippet(c, 3, "when_cut"), "abcd") == "abc..."
    assert one(spark, lambda c: tx.snippet(c, 3, "never"), "abcd") == "abc"


def test_urls_and_letters(spark):
    assert one(spark, tx.strip_urls, "see http://a.b/c?d=1 or www.x.y now") == "see   or   now"
    assert one(spark, tx.alpha_only, "it's 5 stars!\n") == "it s   stars \n"


def test_tokenize_splits_joined_words(spark):
    assert one(spark, tx.tokenize, "i cannot gonna lemme cannotx") == ["i", "can", "not", "gon", "na", "lem", "me", "cannotx"]


@pytest.mark.parametrize("word,want", [
    ("prices", "price"), ("boxes", "box"), ("dishes", "dish"), ("glasses", "glass"), ("berries", "berry"),
    ("women", "woman"), ("glass", "glass"), ("bus", "bus"), ("this", "this"), ("cookies", "cookie"),
    ("loaves", "loaf"), ("eggs", "egg"), ("gas", "gas"),
])
def test_lemma_rules(spark, word, want):
    assert one(spark, tx.lemma, word) == want
    assert one(spark, lambda c: tx.lemmatize(F.array(c)), word) == [want]


def test_topic_tokens_drop_stop_words_before_and_after_lemmatising(spark):
    # "items" and "days" are no stop words themselves, but their lemmas are.
    got = one(spark, tx.topic_tokens, "The ITEMS were 2 days late; visit www.shop.com - soggy chips, ok! Chips")
    assert got == ["late", "visit", "soggy", "chip", "chip"]
    assert one(spark, tx.topic_tokens, None) == []


def test_topic_tokens_equal_the_step_by_step_chain(spark):
    texts = ["I cannot believe http://x.y the prices!! of ae ab cde", "", "Gonna need 12 boxes & dishes", "Ünï códe"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    words = K.stopword_set()
    chain = tx.drop_short_and_stop(tx.lemmatize(tx.drop_short_and_stop(
        tx.tokenize(tx.alpha_only(tx.strip_urls(F.lower("x")))), words)), words)
    for a, b in df.select(tx.topic_tokens(F.col("x")), chain).collect():
        assert a == b


def test_stopwords_take_brand_terms():
    assert "acme" in K.stopword_set(["acme"]) and "acme" not in K.stopword_set()
    assert {"the", "flavour", "not"} <= set(K.stopword_set())


def test_parse_timestamp(spark):
    parse = lambda c: dates.parse_timestamp(c).cast("timestamp_ntz")
    assert one(spark, parse, "2024-03-16T10:00:00.000+00:00") == dt.datetime(2024, 3, 16, 10)
    assert one(spark, parse, "2024-03-16T10:00:00Z") == dt.datetime(2024, 3, 16, 10)
    assert one(spark, parse, "rubbish") is None


@pytest.mark.parametrize("when,inside", [
    ("2023-01-01 00:00:00", True), ("2022-12-31 23:59:59", False), ("2026-04-23 00:00:00", True),
    ("2026-04-23 00:00:01", False)])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_window_is_inclusive(spark, when, inside, kind):
    assert one(spark, lambda c: dates.in_window(c.cast(kind)), when) is inside


def test_calendar_labels(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 2, 29, 23, 59),)], "t timestamp_ntz")
    t = F.col("t")
    got = df.select(dates.day(t), dates.month_label(t), dates.year(t), dates.month_start(t),
                    dates.quarter_start(t), dates.quarter_label(t)).first()
    assert tuple(got) == (dt.date(2024, 2, 29), "2024-02", 2024, dt.date(2024, 2, 1), dt.date(2024, 1, 1), "2024Q1")


@pytest.mark.parametrize("stars,want", [
    (None, None), (1.0, "negative"), (2.0, "negative"), (2.9, "negative"), (3.0, "neutral"), (3.5, "neutral"),
    (4.0, "positive"), (5.0, "positive")])
def test_rating_sentiment(spark, stars, want):
    assert one(spark, scores.rating_sentiment, stars, "double") == want


def test_numbers(spark):
    assert one(spark, scores.to_int, 2.5, "double") == 2 and one(spark, scores.to_int, -2.5, "double") == -2
    assert [one(spark, scores.number_or_zero, v) for v in ("1.5", "abc", None)] == [1.5, 0.0, 0.0]
    assert one(spark, lambda c: scores.null_default(c, "?"), None) == "?"
    assert one(spark, lambda c: scores.replace_literal(c, "-P"), "1-P2-P") == "12"
    assert one(spark, scores.percent_text, 0.1234, "double") == "12.3%"


def test_softmax_and_argmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0],), ([1000.0, 1000.0, -1000.0],)], "z array<double>")
    for z, p, i in df.select("z", scores.softmax(F.col("z")), scores.argmax(F.col("z"))).collect():
        e = [math.exp(x - max(z)) for x in z]
        assert p == pytest.approx([x / sum(e) for x in e]) and sum(p) == pytest.approx(1.0)
        assert i == z.index(max(z))  # the first maximum wins
    three = df.select(*scores.softmax3(*[F.get("z", F.lit(i)) for i in range(3)])).first()
    assert list(three) == pytest.approx([0.0900306, 0.6652410, 0.2447285], abs=1e-6)


def test_labels(spark):
    assert [one(spark, scores.label_score, v) for v in ("negative", "neutral", "positive", "odd", None)] == [-1, 0, 1, None, None]
    assert [one(spark, scores.label_of, v, "int") for v in (0, 2, 3)] == ["negative", "positive", None]
    name = lambda default: lambda c: scores.topic_name(c, {0: "A"}, default)
    assert one(spark, name(False), 7, "int") is None and one(spark, name(True), 7, "int") == "Topic 7"
    assert one(spark, name(True), 0, "int") == "A"


def test_confident_negative_at_the_threshold(spark):
    df = spark.createDataFrame([("negative", 0.8), ("negative", 0.81), ("positive", 0.9), (None, 0.9)], "p string, c double")
    count = lambda strict: df.filter(scores.is_confident_negative(F.col("p"), F.col("c"), strict=strict)).count()
    assert (count(False), count(True)) == (2, 1)


def test_patterns_run_only_on_texts_that_hold_their_words(spark):
    rows = ["see http://a.b/c now", "www.x cannot", "wannabe gonna gimme5", "a WWW. http", "plain", "", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string").coalesce(1)
    got = df.select(tx.strip_urls(F.col("t")), tx.split_joined(F.col("t")))
    want = df.select(F.regexp_replace("t", tx._URL, " "), F.regexp_replace("t", tx._JOINED, "$1 "))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert "contains" in got._jdf.queryExecution().toString().lower()
