"""Classification metrics. Everything follows from one small table of (truth, pred, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleaner import constants as K


def label_counts(df: DataFrame, truth: str = "rating_sentiment", pred: str = "pred") -> DataFrame:
    """Rows per (truth, prediction); the only pass over the data."""
    return (df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull())
            .groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def confusion(counts: DataFrame, labels: list[str] = K.LABELS) -> DataFrame:
    """All label pairs with count and percent of the truth row, zeros included."""
    cells = [(t, p) for t in labels for p in labels]
    sums = [F.coalesce(F.sum(F.when((F.col("truth") == t) & (F.col("pred") == p), F.col("n"))),
                       F.lit(0)).alias(f"c{i}") for i, (t, p) in enumerate(cells)]
    rows = {t: sum((F.col(f"c{i}") for i, (a, _) in enumerate(cells) if a == t), F.lit(0))
            for t in labels}
    entries = F.array(*[
        F.struct(F.lit(t).alias("truth"), F.lit(p).alias("pred"), F.col(f"c{i}").alias("n"),
                 F.try_divide(F.col(f"c{i}") * 100.0, rows[t]).alias("row_pct"))
        for i, (t, p) in enumerate(cells)])
    return counts.agg(*sums).select(F.inline(entries))


def accuracy(counts: DataFrame) -> DataFrame:
    hit = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0))
    return counts.agg((hit / F.sum("n")).alias("accuracy"))


def per_class(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every label seen on either side; 0 where undefined."""
    zero = F.lit(0).cast("bigint")
    same = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(zero)
    sides = counts.select(F.inline(F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), zero.alias("predicted"),
                 same.alias("hit")),
        F.struct(F.col("pred").alias("label"), zero.alias("support"), F.col("n").alias("predicted"),
                 zero.alias("hit")))))
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return sums.select(
        "label", ratio(F.col("hit"), F.col("predicted")).alias("precision"),
        ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(F.col("hit") * 2, F.col("support") + F.col("predicted")).alias("f1"), "support")


def f1_scores(counts: DataFrame) -> DataFrame:
    """Macro and support-weighted F1."""
    return per_class(counts).agg(
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def class_report(counts: DataFrame) -> DataFrame:
    """Per-class rows followed by accuracy, macro and weighted averages."""
    classes = per_class(counts)
    total = F.sum("support")
    macro = classes.agg(F.lit("macro avg").alias("label"), *[
        F.avg(c).alias(c) for c in ("precision", "recall", "f1")], total.alias("support"))
    weighted = classes.agg(F.lit("weighted avg").alias("label"), *[
        (F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in ("precision", "recall", "f1")],
        total.alias("support"))
    overall = counts.agg((F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0))
                          / F.sum("n")).alias("a"), F.sum("n").alias("support"))
    overall = overall.select(F.lit("accuracy").alias("label"), F.col("a").alias("precision"),
                             F.col("a").alias("recall"), F.col("a").alias("f1"), "support")
    return classes.unionByName(overall).unionByName(macro).unionByName(weighted)


def confidence_summary(scored: DataFrame, threshold: float = K.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Mean confidence and the number of negatives strictly above the threshold."""
    return scored.agg(
        F.avg("confidence").alias("mean_confidence"),
        F.count(F.when((F.col("pred") == "negative") & (F.col("confidence") > threshold), F.lit(1)))
        .alias("confident_negatives"))
