"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

``source_targets`` gives every source its target. Each document of a source then has the same expected
number of copies; its whole part is certain, its fraction is settled by pivotal rounding: two
documents with open fractions meet, a random one of them gains words (fraction times size) that the other
loses until one fraction is 0 or 1, and the other goes on. Expected copies stay as they are, and so does the
sum of the words of the two. Documents meet in groups of bounded size; what a group leaves open meets
again at the next level of a reduction tree, until one document is open per source and size class. At the
root these few (one per doubling of size) are settled together, so that the words of the source come as near
to its target as they can; their last choice is made for that, not drawn.

Documents of equal id, size and source are one entry with a count in the tree, however many they are: their expected
copies are added up, the whole part is certain and one fraction remains. So copies (or rows without an id) that make up
a third of a table are neither a hot bucket nor a hot list. Where the rows themselves are asked for, those of an entry with
very many rows are counted by their content and get their copies by prefix sums over salted groups.

Random numbers are hashes of ids, sizes and the seed: reruns agree, whatever the partitioning.

Defined results: a null or wordless text has size 0, is settled like a document of one word and takes no
words; a null source is a source of its own, last in order; rows that repeat a document are documents of
their own (those of equal id and size are interchangeable); a source without words has target 0; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.llm.common import stage

#: Documents that meet in one group, about; every level of the tree leaves one of these open.
GROUP = 64
#: Partial choices kept at the root.
BEAM = 64
#: Weights of the sources in order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Rows of one entry that a task handles in one list or window, at least; beyond also 1/MOST of all rows.
CHUNK, MOST = 2000, 20_000
#: Fractions nearer than this to a whole number are whole.
_EPS = 1e-9

_DONE = "array<struct<doc_id:bigint,size:bigint,m:bigint,extra:int>>"


def word_count(text: str = "text") -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, share: float = 1.5, limit: float = 2.0,
                   weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``source``, ``source_size``, ``n_docs``, ``target`` from ``source`` and ``size``.

    Sources in the order of their code points, null last, weigh as given in turn and share ``share`` times
    all sizes; a target stops at ``limit`` times its source's size and the excess is shared again by
    weight. With the sources in the order of limit over weight, those that stop are the first ones: the
    level up to which all others fill follows from running sums. One row per source is ordered.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", limit * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rest_words = share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rest_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = F.greatest(F.lit(0.0), rest_words / rest_weight)
    return per.withColumn("level", level).withColumn("full", F.col("most") <= F.col("level") * F.col("weight")).withColumn(
        # The first source that does not fill sets the level of all after it.
        "shared", F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(
            order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).select(
        "source", "source_size", "n_docs", F.least(F.col("most"), F.coalesce("shared", F.lit(float("inf"))) * F.col("weight")).alias("target"))


def _meet(open_docs: str, seed: int) -> Column:
    """Pivotal rounding along an array of (key, doc_id, size, m, p) in order: struct of ``left`` (the document
    still open, or null) and ``done``."""
    nobody = F.lit(None).cast("struct<key:bigint,doc_id:bigint,size:bigint,m:bigint,p:double>")
    settled = lambda d, extra: F.array(F.struct(d["doc_id"].alias("doc_id"), d["size"].alias("size"), d["m"].alias("m"), extra.cast("int").alias("extra")))
    is_open = lambda p: (p > _EPS) & (p < 1 - _EPS)
    words = lambda d: F.greatest(d["size"], F.lit(1)).cast("double")

    def step(acc: Column, b: Column) -> Column:
        a = acc["left"]
        wa, wb = words(a), words(b)
        up = F.least((1 - a["p"]) * wa, b["p"] * wb)      # words that may go from b to a
        down = F.least(a["p"] * wa, (1 - b["p"]) * wb)    # and from a to b
        u = F.pmod(F.xxhash64(a["key"], b["key"], a["size"], b["size"], F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        gain = F.when(u * (up + down) < down, up).otherwise(-down)
        moved = F.struct(acc["done"].alias("done"), a.alias("a"), b.alias("b"),
                         (a["p"] + gain / wa).alias("pa"), (b["p"] - gain / wb).alias("pb"))

        def after(m: Column) -> Column:
            with_p = lambda d, p: F.struct(d["key"].alias("key"), d["doc_id"].alias("doc_id"), d["size"].alias("size"), d["m"].alias("m"), p.alias("p"))
            left = F.when(is_open(m["pa"]), with_p(m["a"], m["pa"])).when(is_open(m["pb"]), with_p(m["b"], m["pb"])).otherwise(nobody)
            none = F.array().cast(_DONE)
            done = F.concat(m["done"], F.when(is_open(m["pa"]), none).otherwise(settled(m["a"], F.round(m["pa"]))),
                            F.when(is_open(m["pb"]), none).otherwise(settled(m["b"], F.round(m["pb"]))))
            return F.struct(left.alias("left"), done.alias("done"))

        paired = F.get(F.transform(F.array(moved), after), F.lit(0))  # the moved pair is worked out once
        return F.when(a.isNull(), F.struct(b.alias("left"), acc["done"].alias("done"))).otherwise(paired)

    return F.aggregate(open_docs, F.struct(nobody.alias("left"), F.array().cast(_DONE).alias("done")), step)


def _root(open_docs: str, owed: str) -> Column:
    """Settle the last open documents of a source, largest first, so that the words taken come as near as can
    be to the words owed: a beam of partial choices, those kept that the remaining sizes can still
    even out. Array of settled documents."""
    state = "array<struct<off:double,owed:double,picks:array<int>>>"

    def step(acc: Column, d: Column) -> Column:
        rest = acc["rest"] - d["size"]
        choice = lambda s, extra: F.struct((s["owed"] - extra * d["size"]).alias("owed"), F.concat(
            s["picks"], F.array(F.lit(extra))).alias("picks"))
        both = F.flatten(F.transform(acc["states"], lambda s: F.array(choice(s, 0), choice(s, 1))))
        # How far the words still owed are beyond what is left to give, then how far from its middle.
        scored = F.transform(both, lambda s: F.struct(
            (F.greatest(F.lit(0.0), -s["owed"], s["owed"] - rest) * 1e6 + F.abs(s["owed"] - rest / 2)).alias("off"),
            s["owed"].alias("owed"), s["picks"].alias("picks")))
        return F.struct(rest.alias("rest"), F.slice(F.array_sort(scored), 1, BEAM).cast(state).alias("states"))

    total = F.aggregate(open_docs, F.lit(0).cast("bigint"), lambda n, d: n + d["size"])
    first = F.array(F.struct(F.lit(0.0).alias("off"), F.col(owed).cast("double").alias("owed"), F.array().cast("array<int>").alias("picks"))).cast(state)
    best = F.aggregate(open_docs, F.struct(total.alias("rest"), first.alias("states")), step,
                       lambda acc: F.get(acc["states"], F.lit(0))["picks"])
    return F.zip_with(open_docs, best, lambda d, extra: F.struct(
        d["doc_id"].alias("doc_id"), d["size"].alias("size"), d["m"].alias("m"), extra.alias("extra")))


def _entries(docs: DataFrame, share: float, limit: float, seed: int) -> DataFrame:
    """doc_id, size, source, source_size, target, m, sure, extra: of the ``m`` documents of equal id, size and source each is
    taken ``sure`` times, and ``extra`` of them once more."""
    # A size class holds sizes within a factor of two.
    sizes = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"))
    entries = stage(sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")).withColumn(
        "class", F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int")), "mix-entries")
    targets = source_targets(entries.select("source", (F.col("size") * F.col("m")).alias("size")), share, limit)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sure = F.floor(F.col("rate") + _EPS)
    cells = entries.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n"))
    cells = stage(cells.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).withColumn(
        "rate", rate).withColumn("sure", sure.cast("int")).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("sure"))).select(
        F.col("source").alias("of"), F.col("class").alias("in"), "n", "source_size", "target", "sure", "p"), "targets")
    in_cell = F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("in"))
    whole = F.floor(F.col("m") * F.col("p") + _EPS)
    plan = entries.join(cells, in_cell).withColumn("p", F.col("m") * F.col("p") - whole)
    is_open = F.col("p") > _EPS
    extras = [plan.filter(~is_open).select("doc_id", "size", "m", "source", "class", F.lit(0).alias("extra"))]
    rows = plan.filter(is_open).select(
        "source", "class", "n", F.xxhash64("doc_id", "size", F.lit(seed)).alias("key"), "doc_id", "size", "m", "p")
    most = cells.filter(is_open).agg(F.max("n")).first()[0] or 1
    for level in range(max(1, math.ceil(math.log(most, GROUP)))):
        groups = F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP ** (level + 1)))
        met = stage(rows.withColumn("bucket", F.pmod(F.xxhash64("key", "size", F.lit(level)), groups)).groupBy(
            "source", "class", "n", "bucket").agg(
            F.array_sort(F.collect_list(F.struct("key", "doc_id", "size", "m", "p"))).alias("open")).select(
            "source", "class", "n", _meet("open", seed + level).alias("met")), "met")
        extras.append(met.select("source", "class", F.explode("met.done").alias("d")).select(
            "d.doc_id", "d.size", "d.m", "source", "class", "d.extra"))
        rows = met.filter("met.left IS NOT NULL").select("source", "class", "n", "met.left.*")
    root = rows.groupBy("source").agg(
        F.sort_array(F.collect_list(F.struct("size", "key", "class", "doc_id", "m", "p")), asc=False).alias("open"),
        F.sum(F.col("size") * F.col("p")).alias("owed"))
    extras.append(root.select("source", F.explode(_root("open", "owed")).alias("d")).select(
        "d.doc_id", "d.size", "d.m", "source", F.floor(F.log2(F.greatest("d.size", F.lit(1)))).cast("int").alias("class"), "d.extra"))
    every = extras[0]
    for part in extras[1:]:
        every = every.unionByName(part)
    return every.join(cells, in_cell).select(
        "doc_id", "size", "source", "source_size", "target", "m", "sure", (whole + F.col("extra")).alias("extra"))


def _repeated(rows: DataFrame, n: str) -> DataFrame:
    """Each row ``n`` times, without the column. Large numbers are cut into parts that are dealt out first."""
    def times(df: DataFrame) -> DataFrame:
        return df.withColumn("repeat_", F.explode(F.sequence(F.lit(1), F.col(n)))).drop("repeat_", n)

    few = rows.filter((F.col(n) > 0) & (F.col(n) <= CHUNK))
    many = rows.filter(F.col(n) > CHUNK).withColumn("part_", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(n) - 1) / CHUNK))))
    many = many.withColumn(n, F.least(F.lit(CHUNK).cast("bigint"), F.col(n) - F.col("part_") * CHUNK)).repartition("part_").drop("part_")
    return times(few).unionByName(times(many))


def mix(docs: DataFrame, share: float = 1.5, limit: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken (copies times size)."""
    kinds = F.array(F.struct((F.col("sure") + 1).alias("copies"), F.col("extra").alias("n")),
                    F.struct(F.col("sure").alias("copies"), (F.col("m") - F.col("extra")).alias("n")))
    found = _entries(docs, share, limit, seed).withColumn("kind", F.explode(kinds)).select(
        "doc_id", "size", "source", "source_size", "target", F.col("kind.copies").alias("copies"), F.col("kind.n").alias("repeats"))
    return _repeated(found, "repeats").withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, share: float = 1.5, limit: float = 2.0, seed: int = 17) -> DataFrame:
    """``docs`` with every row as often as the mix takes it (not at all, once or more), same columns."""
    spare = next(f"mix{i}_" for i in range(len(docs.columns) + 1) if not any(c.startswith(f"mix{i}_") for c in docs.columns))
    keys = {"doc_id": F.col("doc_id").cast("bigint"), "size": word_count(), "source": F.col("source").cast("string")}
    mine = [f"{spare}{k}" for k in keys]
    rows = docs.select("*", *(c.alias(f"{spare}{k}") for k, c in keys.items())).withColumn(f"{spare}key", F.xxhash64(*mine))
    picks = stage(_entries(docs, share, limit, seed).select(
        *(F.col(k).alias(f"pick_{k}") for k in keys), "m", "sure", "extra").withColumn(
        "pick", F.xxhash64(*(f"pick_{k}" for k in keys))), "mix-picks")
    limit_rows = F.greatest(F.lit(CHUNK), F.floor(picks.agg(F.sum("m") / MOST).scalar()))
    is_large = F.col("m") > limit_rows
    large = F.broadcast(picks.filter(is_large))  # each holds more than 1/MOST of all rows, so there are at most MOST
    met = F.col(f"{spare}key") == F.col("pick")
    for k in keys:
        met = met & F.col(f"{spare}{k}").eqNullSafe(F.col(f"pick_{k}"))
    # Rows of equal id, size and source share out the copies of these.
    names = [f"{spare}key", *mine]
    turn = F.row_number().over(Window.partitionBy(*names).orderBy(*names))
    few = rows.join(large.select("pick", *(f"pick_{k}" for k in keys)), met, "left_anti").join(picks.filter(~is_large), met)
    few = few.withColumn(f"{spare}n", F.col("sure") + F.when(turn <= F.col("extra"), 1).otherwise(0))
    many = _large(rows.join(large, met), docs.columns, f"{spare}n")
    return _repeated(few.select(*docs.columns, F.col(f"{spare}n").cast("bigint").alias(f"{spare}n")).unionByName(many), f"{spare}n")


def _large(rows: DataFrame, columns: list[str], out: str) -> DataFrame:
    """The distinct rows of entries with very many rows, and how often each is taken. Equal rows are counted before they
    are shuffled; the rest is ranked by content in salted groups, whose sizes say where each group's ranks start."""
    kept = ["pick", "m", "sure", "extra"]
    content = stage(rows.groupBy(*columns, *kept).agg(F.count(F.lit(1)).alias("rows_")).withColumn(
        "hash_", F.xxhash64(*columns)).withColumn("salt_", F.pmod("hash_", F.floor(F.col("m") / CHUNK) + 1)), "mix-large")
    sums = content.groupBy("pick", "salt_").agg(F.sum("rows_").alias("held_"))
    before = F.sum("held_").over(Window.partitionBy("pick").orderBy("salt_").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("pick").alias("of_"), F.col("salt_").alias("in_"), F.coalesce(before, F.lit(0)).alias("before_"))
    so_far = F.sum("rows_").over(Window.partitionBy("pick", "salt_").orderBy("hash_", *columns).rowsBetween(Window.unboundedPreceding, 0))
    ranked = content.withColumn("so_far_", so_far).join(sums, (F.col("pick") == F.col("of_")) & (F.col("salt_") == F.col("in_")))
    first = F.col("before_") + F.col("so_far_") - F.col("rows_")
    extra = F.greatest(F.lit(0), F.least(F.col("rows_"), F.col("extra") - first))
    return ranked.select(*columns, (F.col("rows_") * F.col("sure") + extra).cast("bigint").alias(out))
