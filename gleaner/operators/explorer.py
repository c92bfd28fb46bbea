"""Tables behind a topic explorer: sizes, term frequencies, saliency, relevance, distances.

phi is (topic, term_id, term, weight); theta is (doc key, topic, p). Both are long tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from gleaner import constants as K, schemas
from gleaner.operators.ranking import rank_rows, top_n_per_group
from gleaner.sources.tables import local_table


def topic_mass(theta: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """(topic, mass, proportion): expected number of tokens of each topic, and its share."""
    mass = (theta.join(lengths, key).groupBy("topic")
            .agg(F.sum(F.col("p") * F.col("doc_len")).alias("mass")))
    return mass.withColumn("proportion", F.col("mass") / mass.agg(F.sum("mass")).scalar())


def topic_mass_of(docs: DataFrame, theta: str = "theta", doc_len: str = "doc_len") -> DataFrame:
    """The same from one row per document, without a join."""
    spread = docs.select(F.posexplode(theta).alias("topic", "p"), F.col(doc_len).alias("doc_len"))
    mass = spread.groupBy("topic").agg(F.sum(F.col("p") * F.col("doc_len")).alias("mass"))
    return mass.withColumn("proportion", F.col("mass") / mass.agg(F.sum("mass")).scalar())


def topic_order(mass: DataFrame) -> DataFrame:
    """Display numbers 1..K by falling proportion."""
    return rank_rows(mass, [F.desc("proportion"), F.col("topic")], "display").select(
        "display", "topic", "proportion")


def topic_cards(order: DataFrame, labels: DataFrame) -> DataFrame:
    """(display, topic, title, description) for the topics of the order."""
    return order.join(labels, "topic", "left").select("display", "topic", "title", "description")


def term_frequency(phi: DataFrame, mass: DataFrame) -> DataFrame:
    """(topic, term, topic_freq): expected occurrences of each term in each topic."""
    return (phi.join(mass.select("topic", "mass", "proportion"), "topic")
            .withColumn("topic_freq", F.col("weight") * F.col("mass")))


def overall_frequency(freq: DataFrame) -> DataFrame:
    """(term, term_freq, p_term)."""
    terms = freq.groupBy("term").agg(F.sum("topic_freq").alias("term_freq"))
    return terms.withColumn("p_term", F.col("term_freq") / terms.agg(F.sum("term_freq")).scalar())


def saliency(freq: DataFrame, n: int = K.RELEVANT_TERMS) -> DataFrame:
    """Most salient terms: probability times how unevenly the term spreads over topics."""
    weights = freq.groupBy("term").agg(F.sum("weight").alias("_w"))
    share = F.col("weight") / F.col("_w")
    gain = F.when(share > 0, share * F.log(share / F.col("proportion"))).otherwise(0.0)
    distinct = (freq.join(weights, "term").groupBy("term").agg(F.sum(gain).alias("distinctiveness")))
    scored = distinct.join(overall_frequency(freq), "term").withColumn(
        "saliency", F.col("p_term") * F.col("distinctiveness"))
    return scored.orderBy(F.desc("saliency"), "term").limit(n)


def _relevance_at(lam) -> Column:
    return lam * F.col("logprob") + (1 - lam) * F.col("loglift")


def _lower_bounds(base: DataFrame, marks: list[float], n: int) -> DataFrame:
    """One map: topic -> for each interval between marks, a value its n-th best never falls below.

    Relevance is linear in lambda, so each of the n best terms at a mark stays, all over a
    neighbouring interval, at or above the smaller of its two end values.
    """
    at_marks = F.array(*[F.struct(F.lit(i).alias("m"), _relevance_at(F.lit(x)).alias("r")) for i, x in enumerate(marks)])
    best = top_n_per_group(base.select("topic", "term", "logprob", "loglift", F.inline(at_marks)),
                           ["topic", "m"], [F.desc("r"), F.col("term")], n)
    ends = F.array(*[F.struct(F.lit(j).alias("j"), F.least(_relevance_at(F.lit(x)), _relevance_at(F.lit(y))).alias("low"))
                     for j, (x, y) in enumerate(zip(marks, marks[1:]))])
    lows = (best.select("topic", "m", F.inline(ends)).filter((F.col("j") == F.col("m")) | (F.col("j") == F.col("m") - 1))
            .groupBy("topic", "m", "j").agg(F.count(F.lit(1)).alias("have"), F.min("low").alias("low"))
            .filter(F.col("have") == n))
    per_topic = lows.groupBy("topic").agg(F.array(*[
        F.max(F.when(F.col("j") == j, F.col("low"))) for j in range(len(marks) - 1)]).alias("bounds"))
    return per_topic.agg(F.map_from_entries(F.collect_list(F.struct("topic", "bounds"))))


def relevance(freq: DataFrame, lambdas=None, n: int = K.RELEVANT_TERMS,
              digits: int | None = None) -> DataFrame:
    """Top terms per topic and lambda: lambda*log(phi) + (1-lambda)*log(phi/p_term).

    Lambda runs over 0, 0.01 .. 1 unless given; its values are exploded in place. The grid is
    first solved at every tenth value, which bounds the values between from below: terms under the
    bound leave before the sort and cannot be among the best. ``digits`` rounds before ranking, so
    that equal terms tie and sort by name.
    """
    grid = [i / 100 for i in range(101)] if lambdas is None else sorted(float(x) for x in lambdas)
    marks = sorted({*grid[::10], grid[-1]})
    marks = marks if len(marks) > 1 else marks * 2
    base = freq.join(overall_frequency(freq), "term").filter(F.col("weight") > 0).select(
        "topic", "term", F.log("weight").alias("logprob"),
        F.log(F.col("weight") / F.col("p_term")).alias("loglift"))
    # The table is small but grows a hundredfold here: deal it out first, or it would sit in the
    # one partition that adaptive execution merged it into.
    parts = base.sparkSession.sparkContext.defaultParallelism
    steps = [(x, max(j for j, m in enumerate(marks[:-1]) if m <= x)) for x in grid]
    spread = base.repartition(parts, "term")
    bounds = F.try_element_at(_lower_bounds(base, marks, n).scalar(), F.col("topic"))
    spread = spread.withColumn("_bounds", bounds)
    scored = spread.select("*", F.inline(F.array(*[
        F.struct(F.lit(x).alias("lambda"), F.lit(j).alias("_j")) for x, j in steps])))
    scored = scored.withColumn("relevance", _relevance_at(F.col("lambda")))
    bound = F.get("_bounds", F.col("_j"))
    scored = scored.filter(bound.isNull() | (F.col("relevance") >= bound - 1e-6)).drop("_bounds")
    if digits is not None:
        unit = 10.0 ** digits
        scored = scored.withColumn("relevance", F.floor(F.col("relevance") * unit + 0.5) / unit)
    return top_n_per_group(scored.drop("_j"), ["topic", "lambda"], [F.desc("relevance"), F.col("term")], n, rank="rank")


def token_table(freq: DataFrame, min_count: float = 0.0) -> DataFrame:
    """Share of a term's occurrences that falls in each topic, for cells of at least ``min_count`` occurrences."""
    terms = freq.groupBy("term").agg(F.sum("topic_freq").alias("term_freq"))
    return (freq.filter(F.col("topic_freq") >= min_count).join(terms, "term")
            .select("topic", "term", (F.col("topic_freq") / F.col("term_freq")).alias("share")))


def topic_distance(phi: DataFrame, topics: int) -> DataFrame:
    """Jensen-Shannon divergence of every pair of the K topics.

    Each term carries its K weights in one array; the K(K-1)/2 topic pairs are summed map-side.
    """
    slots = F.array(*[F.coalesce(F.sum(F.when(F.col("topic") == t, F.col("weight"))), F.lit(0.0))
                      for t in range(topics)])
    per_term = phi.groupBy("term").agg(slots.alias("w"))
    pairs = F.array(*[F.struct(F.lit(a).alias("topic_a"), F.lit(b).alias("topic_b"))
                      for a in range(topics) for b in range(a + 1, topics)])
    spread = per_term.select("w", F.inline(pairs)).select(
        "topic_a", "topic_b", F.get("w", F.col("topic_a")).alias("p"), F.get("w", F.col("topic_b")).alias("q"))
    middle = (F.col("p") + F.col("q")) / 2

    def part(x):
        return F.when(x > 0, x * F.log(x / middle)).otherwise(0.0)

    return spread.groupBy("topic_a", "topic_b").agg(
        (F.sum(part(F.col("p")) + part(F.col("q"))) / 2).alias("js_divergence"))


def write_explorer(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON folder per table, for a viewer to load."""
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")


def gram_matrix(distance: np.ndarray) -> np.ndarray:
    """Inner products of points that have these distances, seen from their centre."""
    squared = distance * distance
    return -0.5 * (squared - squared.mean(axis=0) - squared.mean(axis=1)[:, None] + squared.mean())


def classical_scaling(gram: np.ndarray, axes: int = 2) -> np.ndarray:
    """Coordinates whose inner products come nearest to ``gram``: its leading eigenvectors times the roots of their
    eigenvalues. The largest coordinate of an axis is positive; an axis without extent is 0."""
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(-values, kind="stable")[:axes]
    out = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    largest = np.abs(out.round(9)).argmax(axis=0)
    out = out * np.where(out[largest, np.arange(out.shape[1])] < 0, -1, 1)
    return np.hstack([out, np.zeros((len(gram), axes - out.shape[1]))])


def topic_map(distance: DataFrame, order: DataFrame, k: int) -> DataFrame:
    """(topic, x, y, proportion): a plane in which near topics have similar words. ``distance`` as ``topic_distance`` gives it; the
    driver holds K x K numbers."""
    d = distance_matrix(distance, k)
    at = classical_scaling(gram_matrix(d))
    points = local_table(distance.sparkSession, [(t, float(x), float(y)) for t, (x, y) in enumerate(at)], schemas.struct(topic="int", x="double", y="double"))
    return points.join(order.select("topic", "proportion"), "topic")


def distance_matrix(distance: DataFrame, k: int) -> np.ndarray:
    """The K x K distances, 0 where the table has none."""
    d = np.zeros((k, k))
    for r in distance.collect():  # k * (k - 1) / 2 rows
        d[r["topic_a"], r["topic_b"]] = d[r["topic_b"], r["topic_a"]] = r["js_divergence"]
    return d
