"""Text expressions: whitespace, lengths, and the tokens used by the topic model."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from gleaner import constants as K

# Unicode white space plus the four separator controls that Python's \s also counts.
_SPACE = r"(?U)[\s\x1c-\x1f]+"
_WORD = r"(?U)[^\s\x1c-\x1f]+"
_URL = r"(?U)http\S+|www\.\S+"
# Words the tokeniser splits in two even without an apostrophe: can|not, gim|me, gon|na, ...
_JOINED_WORDS = ("cannot", "gimme", "gonna", "gotta", "lemme", "wanna")
_JOINED = r"\b(can(?=not\b)|gim(?=me\b)|gon(?=na\b)|got(?=ta\b)|lem(?=me\b)|wan(?=na\b))"


def normalise_whitespace(c: Column) -> Column:
    """Every run of white space becomes one space, ends stripped; null stays null."""
    return F.btrim(F.regexp_replace(c, _SPACE, " "))


def is_nonblank(c: Column) -> Column:
    """True when some non-white-space character is present (null gives null)."""
    return c.rlike(_WORD)


def full_text(title: Column, text: Column) -> Column:
    """Title and body joined by a full stop; a missing part counts as empty."""
    return normalise_whitespace(
        F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(text, F.lit(""))))


def char_length(c: Column) -> Column:
    return F.length(c)


def word_count(c: Column) -> Column:
    """Number of white-space separated words, 0 for an empty string."""
    return F.regexp_count(c, F.lit(_WORD))


def is_short(chars: Column, limit: int = K.SHORT_TEXT_CHARS) -> Column:
    return chars < limit


def snippet(c: Column, n: int, ellipsis: str = "always") -> Column:
    """First ``n`` characters for display; ``ellipsis`` is always, never or when_cut."""
    head = F.substring(c, 1, n)
    if ellipsis == "never":
        return head
    dotted = F.concat(head, F.lit("..."))
    return dotted if ellipsis == "always" else F.when(F.length(c) > n, dotted).otherwise(c)


def _where_held(c: Column, needles: Iterable[str], change: Callable[[Column], Column]) -> Column:
    """``change`` of the texts that hold a needle, the others as they are: a plain search costs less than a pattern.

    The one-element array computes ``c`` once.
    """
    def changed(x: Column) -> Column:
        held = reduce(lambda a, b: a | b, [F.contains(x, F.lit(n)) for n in needles])
        return F.when(held, change(x)).otherwise(x)

    return F.get(F.transform(F.array(c), changed), F.lit(0))


def strip_urls(c: Column) -> Column:
    return _where_held(c, ("http", "www."), lambda x: F.regexp_replace(x, _URL, " "))


def alpha_only(c: Column) -> Column:
    """Everything but a-z and white space becomes a space."""
    return F.regexp_replace(c, r"(?U)[^a-z\s\x1c-\x1f]", " ")


def split_joined(c: Column) -> Column:
    return _where_held(c, _JOINED_WORDS, lambda x: F.regexp_replace(x, _JOINED, "$1 "))


def tokenize(cleaned: Column) -> Column:
    """Words of a text that holds only a-z and white space."""
    return F.regexp_extract_all(split_joined(cleaned), F.lit("[a-z]+"), F.lit(0))


def drop_short_and_stop(tokens: Column, stopwords: Iterable[str], min_length: int = 3) -> Column:
    # A literal IN list of this size becomes a hash-set lookup.
    words = list(stopwords)
    return F.filter(tokens, lambda t: (F.length(t) >= min_length) & ~t.isin(words))


def lemma(token: Column) -> Column:
    """Noun lemma by rule: irregular plurals first, then the plural endings."""
    irregular = list(K.IRREGULAR_NOUNS.items())
    table = F.create_map(*[F.lit(x) for pair in irregular for x in pair])

    def without(n: int, tail: str = "") -> Column:
        stem = F.substring(token, F.lit(1), F.length(token) - n)
        return F.concat(stem, F.lit(tail)) if tail else stem

    return (
        F.when(token.isin([w for w, _ in irregular]), F.element_at(table, token))
        .when(token.rlike("[a-z]{2}ies$"), without(3, "y"))
        .when(token.rlike("(ss|x|z|ch|sh)es$"), without(2))
        .when(token.rlike("[a-z]{2}[^sui]s$"), without(1))
        .otherwise(token)
    )


def lemmatize(tokens: Column) -> Column:
    # Only words ending in s, or listed as irregular, can change.
    may_change = [w for w in K.IRREGULAR_NOUNS if not w.endswith("s")]
    return F.transform(
        tokens, lambda t: F.when(t.endswith("s") | t.isin(may_change), lemma(t)).otherwise(t))


def raw_tokens(text: Column) -> Column:
    """Lower-cased words of the whole text, URLs and non-letters removed; null gives []."""
    words = tokenize(strip_urls(F.lower(text)))
    return F.coalesce(words, F.array().cast("array<string>"))


def topic_tokens(text: Column, stopwords: Iterable[str] | None = None,
                 lemmatise: bool = True) -> Column:
    """Tokens for the topic model: one expression over the whole text, null gives [].

    Short words and stop words go both before and after lemmatising. The first pass uses the
    pattern ``[a-z]{3,}``, which matches exactly the letter runs of three or more.
    """
    words = K.stopword_set() if stopwords is None else list(stopwords)
    text = split_joined(strip_urls(F.lower(text)))
    long_words = F.regexp_extract_all(text, F.lit("[a-z]{3,}"), F.lit(0))
    kept = F.filter(long_words, lambda t: ~t.isin(words))
    if lemmatise:
        kept = drop_short_and_stop(lemmatize(kept), words)
    return F.coalesce(kept, F.array().cast("array<string>"))
