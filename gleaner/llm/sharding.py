"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at many places (virtual nodes) of a ring, every row at the place of its hashed id. A
row belongs to the shard at or after its place; rows that find their shard full go on clockwise to the
next one with room. The load is the number of rows, and the room is the same for all shards or differs by one,
so counts are at most one apart; a changed number of shards moves the rows of the new arcs and what
overflows, not all rows.

The ring has a fixed number of cells. Rows are counted per cell, cells are summed to the arcs between
neighbouring virtual nodes, and from those few sums the driver works out which stretch of an arc goes to which
shard. Rows find their place in the arc by a rank within their cell plus the sum of the cells before. A cell with very
many rows (a repeated id, or rows without an id and with equal texts) is ranked in salted groups, by prefix sums over their sizes.

Law ``rows``: counts of any two shards are at most one apart. Defined results: a null text has 16 bytes
and the checksum of an empty text; a row without an id stands at the hash of its text; rows that
repeat are rows of their own, equal ones interchangeable; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.llm.common import stage, text_hash

#: Cells of the ring, as a power of two: of 10^10 rows a cell holds some 40,000.
RING_BITS = 18
#: Places of a shard on the ring.
VIRTUAL_NODES = 128

#: Rows of a cell that are ranked together, at most; beyond also 1/MOST of all rows.
GROUP_ROWS, MOST = 2000, 20_000

LAW = "rows"


def ring(n_shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(last cell of an arc, shard) in clockwise order; the shard at a place does not depend on the number
    of shards. Of virtual nodes that meet in a cell the smallest shard stays."""
    places: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(virtual_nodes):
            cell = int.from_bytes(hashlib.sha256(f"{shard}/{v}".encode()).digest()[:8], "big") >> (64 - RING_BITS)
            places.setdefault(cell, shard)
    return sorted(places.items())


def stretches(arcs: list[tuple[int, int]], counts: list[int], n_shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, from rank, to rank, shard, first slot): where the rows of each arc go.

    Shards that take one row more are the first ones. Every shard first takes the rows of its own arcs, in
    clockwise order, up to its room; what is left of an arc goes clockwise from shard to shard, arcs
    taking turns step by step, until it has found room.
    """
    total = sum(counts)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    given = [0] * len(arcs)
    used = [0] * n_shards
    out = []
    open_arcs, step = [a for a in range(len(arcs)) if counts[a]], 0
    while open_arcs:
        still = []
        for a in open_arcs:
            shard = arcs[(a + step) % len(arcs)][1]
            n = min(counts[a] - given[a], room[shard] - used[shard])
            if n:
                out.append((a, given[a], given[a] + n, shard, used[shard]))
                given[a] += n
                used[shard] += n
            if given[a] < counts[a]:
                still.append(a)
        open_arcs, step = still, step + 1
    return out


def _place() -> Column:
    return F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.xxhash64(F.coalesce("text", F.lit(""))))


def _cells_of(arcs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(arc, its first cell, number of cells); the first arc also takes the cells after the last place."""
    size = 1 << RING_BITS
    return [(a, (arcs[a - 1][0] + 1) % size, (arcs[a][0] - arcs[a - 1][0] - 1) % size + 1) for a in range(len(arcs))]


def assign(docs: DataFrame, n_shards: int, virtual_nodes: int = VIRTUAL_NODES, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot (from 0 within the shard),
    grown_shard (null), and the columns named in ``carry``."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    cell = F.shiftrightunsigned("place", 64 - RING_BITS)
    # Stored without the texts, so that the number that deals rows to groups stays the same whoever reads it.
    rows = stage(docs.select("doc_id", *carry, text_hash().alias("text_hash"), (F.octet_length(text) + 16).cast("bigint").alias("size"),
                             F.crc32(text).alias("text_crc32"), _place().alias("place")).withColumn("cell", cell).withColumn(
        "row", F.monotonically_increasing_id()), "ring-rows")
    counts = stage(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "ring-counts")
    arcs = ring(n_shards, virtual_nodes)
    laid = spark.createDataFrame(_cells_of(arcs), "arc int, first bigint, n_cells int").select(
        "arc", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n_cells") - 1), lambda k: (F.col("first") + k) % (1 << RING_BITS))).alias("k", "cell"))
    before = Window.partitionBy("arc").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    cells = stage(laid.join(counts, "cell").withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "ring-cells")
    load = dict(cells.groupBy("arc").agg(F.sum("n").alias("n")).collect())  # at most one row per virtual node
    plan = stretches(arcs, [load.get(a, 0) for a in range(len(arcs))], n_shards)
    stretch = spark.createDataFrame(plan, "of int, low bigint, high bigint, shard int, slot bigint")
    most = max(GROUP_ROWS, sum(load.values()) // MOST)
    # Cells with more than 1/MOST of all rows: at most MOST.
    large = F.broadcast(counts.filter(F.col("n") > most).select("cell", (F.floor(F.col("n") / GROUP_ROWS) + 1).alias("groups")))
    dealt = rows.join(large, "cell", "left").withColumn(
        "of_cell", F.coalesce(F.pmod(F.xxhash64("row"), F.col("groups")), F.lit(0)).cast("bigint")).drop("groups")
    sizes = dealt.groupBy("cell", "of_cell").agg(F.count(F.lit(1)).alias("held"))
    earlier = F.sum("held").over(Window.partitionBy("cell").orderBy("of_cell").rowsBetween(Window.unboundedPreceding, -1))
    groups = sizes.withColumn("earlier", F.coalesce(earlier, F.lit(0))).join(
        cells.select("cell", "arc", "before"), "cell").withColumn("start", F.col("before") + F.col("earlier"))
    # A stretch is one of a few thousand, so an arc's list of them is short.
    routes = groups.join(stretch, (F.col("arc") == F.col("of")) & (F.col("low") < F.col("start") + F.col("held")) & (
        F.col("high") > F.col("start"))).groupBy("cell", "of_cell", "start").agg(
        F.collect_list(F.struct("low", "high", "shard", "slot")).alias("routes"))
    in_group = Window.partitionBy("cell", "of_cell").orderBy("place", "doc_id", "text_crc32", "size", "text_hash", "row")
    rank = F.col("start") + F.row_number().over(in_group) - 1
    return dealt.join(routes, ["cell", "of_cell"]).withColumn("rank", rank).withColumn(
        "to", F.get(F.filter("routes", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"])), F.lit(0))).select(
        "doc_id", *carry, "size", "text_crc32", F.lit(LAW).alias("law"), F.col("to.shard").alias("shard"),
        (F.col("to.slot") + F.col("rank") - F.col("to.low")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
