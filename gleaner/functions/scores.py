"""Rating, label and class-probability expressions, and small value helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gleaner import constants as K


def to_int(c: Column) -> Column:
    """Integer part, cut towards zero."""
    return c.cast("int")


def number_or_zero(c: Column) -> Column:
    """Numeric value of a string; bad or missing counts as 0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def null_default(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def replace_literal(c: Column, find: str, by: str = "") -> Column:
    return F.replace(c, F.lit(find), F.lit(by))


def percent_text(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100.0)


def rating_sentiment(rating: Column) -> Column:
    """1-2 negative, 3 neutral, more positive, after cutting to an integer; null stays null."""
    stars = to_int(rating)
    return (F.when(stars <= 2, "negative").when(stars == 3, "neutral")
            .when(stars.isNotNull(), "positive"))


def label_score(label: Column) -> Column:
    """-1, 0 or 1; unknown labels give null."""
    out = None
    for name, value in K.LABEL_SCORES.items():
        out = F.when(label == name, value) if out is None else out.when(label == name, value)
    return out


def softmax(logits: Column) -> Column:
    """Class probabilities of an array of logits, shifted by its maximum."""
    shifted = F.transform(logits, lambda z: F.exp(z - F.array_max(logits)))
    return F.transform(
        shifted, lambda e: e / F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x))


def softmax3(z0: Column, z1: Column, z2: Column) -> list[Column]:
    """The same for three columns; no arrays, so it stays in generated code."""
    top = F.greatest(z0, z1, z2)
    e = [F.exp(z - top) for z in (z0, z1, z2)]
    return [x / (e[0] + e[1] + e[2]) for x in e]


def argmax(values: Column) -> Column:
    """0-based index of the maximum; the first one wins a tie."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def argmax3(z0: Column, z1: Column, z2: Column) -> Column:
    top = F.greatest(z0, z1, z2)
    return F.when(z0 == top, 0).when(z1 == top, 1).when(z2 == top, 2)


def label_of(idx: Column, labels=K.LABELS) -> Column:
    """Label of a class index; an index without label gives null."""
    return F.get(F.array(*[F.lit(x) for x in labels]), idx)


def topic_name(topic: Column, names: dict[int, str], default: bool = False) -> Column:
    """Name of a topic id; unknown ids give null, or 'Topic k' when ``default`` is set."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]).cast("map<int,string>")
    name = F.try_element_at(table, topic.cast("int"))
    return F.coalesce(name, F.concat(F.lit("Topic "), topic.cast("string"))) if default else name


def confidence(p0: Column, p1: Column, p2: Column) -> Column:
    return F.greatest(p0, p1, p2)


def signed_score(p_negative: Column, p_positive: Column) -> Column:
    return p_positive - p_negative


def is_confident_negative(pred: Column, conf: Column, threshold: float = K.CONFIDENCE_THRESHOLD,
                          strict: bool = False) -> Column:
    return (pred == "negative") & ((conf > threshold) if strict else (conf >= threshold))
