"""Exact quantiles by counting bits, sample sketches, and the plane of topics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import explorer, sampling, selection
from gleaner.sources.tables import local_table
from gleaner import schemas


def test_quantiles_of_odd_numbers(spark):
    rng = np.random.default_rng(0)
    values = [float(x) for x in rng.normal(size=700) * 10.0 ** rng.integers(-300, 300, 700)] + [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308] + [2.5] * 300
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").repartition(4)
    shares = [0.0, 0.001, 0.25, 0.5, 0.7, 0.99, 1.0]
    got = selection.exact_quantiles(df, "v", shares)
    want = np.quantile(np.array(values), shares)
    assert np.allclose([got[q] for q in shares], want, rtol=1e-12)
    with_ends = selection.exact_quantiles(spark.createDataFrame([(math.inf,), (-math.inf,), (1.0,)], "v double"), "v", [0.0, 0.5, 1.0])
    assert with_ends == {0.0: -math.inf, 0.5: 1.0, 1.0: math.inf}


def test_quantiles_of_integers_and_of_nothing(spark):
    df = spark.createDataFrame([(i % 101,) for i in range(5000)], "n int")
    values = sorted(i % 101 for i in range(5000))
    assert selection.exact_quantiles(df, "n", [0.5, 0.99]) == {0.5: pytest.approx(np.quantile(values, 0.5)), 0.99: pytest.approx(np.quantile(values, 0.99))}
    assert selection.exact_quantiles(df.limit(0), "n", [0.5]) == {0.5: None}
    assert selection.clip_at_quantile(df, "n", 0.99).count() == sum(v <= np.quantile(values, 0.99) for v in values)
    assert selection.clip_at_quantile(df.limit(0), "n").collect() == []


def test_many_distinct_values_are_never_listed(spark):
    """No step of a pass holds more than 65,536 counts for each rank asked for."""
    df = spark.range(3_000_000).select((F.xxhash64("id") / 1e9).alias("v"))
    got = selection.exact_quantiles(df, "v", [0.5])[0.5]
    below = df.filter(F.col("v") <= got).count()
    assert abs(below - 1_500_000) <= 1


def test_sketches_of_drops_merge_to_the_sample(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("review_id"), (F.col("id") % 7 % 5).cast("double").alias("rating"), (F.col("id") % 3).alias("part"))
    rows = rows.unionByName(spark.createDataFrame([("null", None, 0), ("few", 9.0, 1)], rows.schema))
    for batch in (2, 0, 1, 1):  # one batch is repeated
        sampling.add_to_sketch(rows.filter(F.col("part") == batch), str(tmp_path), batch, F.col("review_id"), n=40)
    stored = spark.read.parquet(str(tmp_path))
    assert stored.count() <= 3 * 6 * 40
    got = sorted(map(tuple, sampling.read_sketch(spark, str(tmp_path), n=40).collect()))
    want = sorted(map(tuple, sampling.stratified_sample(rows, F.col("review_id"), 40).collect()))
    assert got == want and len(got) == 5 * 40 + 1


def test_topic_map_keeps_distances_of_a_plane(spark):
    points = np.array([[0, 0], [3, 0], [0, 4], [3, 4], [1, 1]], dtype=float)
    pairs = [(a, b, float(np.linalg.norm(points[a] - points[b]))) for a in range(5) for b in range(a + 1, 5)]
    distance = local_table(spark, pairs, schemas.struct(topic_a="int", topic_b="int", js_divergence="double"))
    order = local_table(spark, [(t, t / 10) for t in range(5)], schemas.struct(topic="int", proportion="double"))
    at = np.array([[r["x"], r["y"]] for r in explorer.topic_map(distance, order, 5).orderBy("topic").collect()])
    assert np.allclose(np.linalg.norm(at[:, None] - at[None], axis=2), np.linalg.norm(points[:, None] - points[None], axis=2))
    assert np.allclose(at.sum(axis=0), 0) and (at[np.abs(at).argmax(axis=0), [0, 1]] > 0).all()
    one = explorer.topic_map(distance.limit(0), order.limit(1), 1).collect()
    assert [(r["x"], r["y"]) for r in one] == [(0.0, 0.0)]
