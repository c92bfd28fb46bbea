"""Exact quantiles without sorting and without a list of distinct values.

The bits of a double, with all bits of negative numbers and the sign of others turned over, order like the number. A value
of a given rank is found sixteen bits at a time: each pass counts the next sixteen bits of the numbers that share
the bits found so far, at most 65,536 counts per rank asked for, combined before they are shuffled.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import DataFrame, Window, functions as F

from gleaner.schemas import struct as columns
from gleaner.session import scratch_path
from gleaner.sources.sinks import write_stage
from gleaner.sources.tables import local_table

_DIGIT, _WORD = 16, 64
_SIGN = -(1 << 63)


def ordered_bits(column: str):
    """The bits of a number as a long whose unsigned order is the order of the numbers."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.col(column).cast("double")).cast("bigint")
    return F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(_SIGN)))


def number_of(bits: int) -> float:
    """The number that ``ordered_bits`` came from; ``bits`` is unsigned."""
    raw = bits ^ (1 << 63) if bits >> 63 else ~bits & ((1 << 64) - 1)
    return struct.unpack("<d", struct.pack("<Q", raw))[0]


def _stored_bits(df: DataFrame, column: str) -> DataFrame:
    there = F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))
    return write_stage(df.filter(there).select(ordered_bits(column).alias("bits")), scratch_path(df.sparkSession, "ordered-bits"))


def _search(bits: DataFrame, ranks: list[int]) -> dict[int, float]:
    """The values at some places (from 0) in the order of all."""
    found = {r: (0, r) for r in ranks}  # rank -> (bits so far, rank among the values that share them)
    for known in range(0, _WORD, _DIGIT):
        asked = sorted({(prefix, left) for prefix, left in found.values()})
        table = local_table(bits.sparkSession, asked, columns(prefix="bigint", left="bigint"))
        prefix = F.shiftrightunsigned("bits", _WORD - known) if known else F.lit(0).cast("bigint")
        digit = F.shiftrightunsigned("bits", _WORD - known - _DIGIT).bitwiseAND(F.lit((1 << _DIGIT) - 1))
        same = bits.select(prefix.alias("prefix"), digit.alias("digit")).filter(F.col("prefix").isin(sorted({p for p, _ in asked})))
        counts = same.groupBy("prefix", "digit").agg(F.count(F.lit(1)).alias("n"))
        running = F.sum("n").over(Window.partitionBy("prefix").orderBy("digit"))
        hit = counts.withColumn("to", running).join(table, "prefix").filter((F.col("left") < F.col("to")) & (F.col("left") >= F.col("to") - F.col("n")))
        step = {(r["prefix"], r["left"]): (r["prefix"] << _DIGIT | r["digit"], r["left"] - (r["to"] - r["n"])) for r in hit.collect()}  # one row per rank
        found = {r: step[at] for r, at in found.items() if at in step}
    return {r: number_of(b) for r, (b, _) in found.items()}


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> dict[float, float | None]:
    """Quantiles with linear interpolation between neighbours; None without values. Missing are null and not-a-number."""
    bits = _stored_bits(df, column)
    n = bits.count()
    if not n:
        return {q: None for q in shares}
    places = {q: (n - 1) * q for q in shares}
    values = _search(bits, sorted({r for p in places.values() for r in (math.floor(p), math.ceil(p))}))
    low = {q: values[math.floor(p)] for q, p in places.items()}
    return {q: low[q] + (values[math.ceil(p)] - low[q]) * (p - math.floor(p)) if p > math.floor(p) else low[q] for q, p in places.items()}


def clip_at_quantile(df: DataFrame, column: str, share: float = 0.99) -> DataFrame:
    """Rows up to and including the quantile."""
    bound = exact_quantiles(df, column, [share])[share]
    return df.filter(F.lit(False) if bound is None else F.col(column) <= bound)
