"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A document's size is its number of words. Source weights repeat a pattern over the sources in code point order (null last); all sources
together get ``share`` of all sizes, none more than ``most`` times its own size, what is over goes to the others by weight. To begin with, each document of a
source has the same fractional number of copies, target / size of the source. Whole copies are kept; the fractions are
rounded by the pivotal method: of two rows, one hands mass to the other at random until one of them is 0 or 1, so that the sum never
changes. Rows are dealt to blocks of about ``block`` rows of like size (so that words, not only rows, come near the target);
a block is folded in one task and leaves one unsettled row; those go up a tree of blocks until a source has one row left.
Long rows are settled first: what those of a step took too much or too little goes to the probabilities of the shorter ones, so that the last
error of a source is that of a few short rows.

A source of any size is many blocks, and no step sees more than a block. Random numbers come from hashes of the row, so reruns agree.

Defined cases: null or blank text has size 0 (and is copied like others, adding no words). Null keys and sources are kept; null is a source of its own. Repeated
rows (equal key, source and text) share a block entry and their copies are spread evenly. Without words all targets are 0. Rows without words keep the probability that is left for them (none, or 1 where words are still due). Extra
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage_table


def size_of(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """sizes: (source, source_size), one row a source. Adds weight and target.

    With caps most * size and sources ordered by cap / weight, all before some place get their cap and all from there
    the same level times their weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", kinds[(F.row_number().over(by_name) - 1) % len(weights)]).withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("place", F.row_number().over(order))
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("place", "level"))).over(everything)
    rows = rows.withColumn("first", first)
    target = F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("cap")).otherwise(F.least("cap", F.col("first.level") * F.col("weight")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _unit(h: Column, level: int, seed: int) -> Column:
    """A number from 0 to below 1 made from a hash."""
    return F.xxhash64(h, F.lit(level), F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def _fold(items: Column, level: int, seed: int) -> Column:
    """Pivotal rounding of an array of (…, h, p): the row left over, its mass, and the settled rows with their rounded part."""
    start = F.struct(items[0].alias("item"), items[0]["p"].alias("mass"), F.slice(F.transform(items, lambda x: F.struct(x.alias("item"), F.lit(0).alias("up"))), 1, 0).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["mass"] + x["p"]
        u, full = _unit(x["h"], level, seed), total >= 1
        # below 1 one row takes all the mass; from 1 on one row becomes 1 and the other keeps the rest
        passes = F.when(full, u * (2 - total) < 1 - x["p"]).otherwise(u * total < x["p"])
        settled = F.struct(F.when(passes, acc["item"]).otherwise(x).alias("item"), full.cast("int").alias("up"))
        return F.struct(F.when(passes, x).otherwise(acc["item"]).alias("item"), (total - full.cast("double")).alias("mass"), F.array_append(acc["done"], settled).alias("done"))

    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, step)


def _rounded(items: DataFrame, most_blocks: int, block: int, seed: int) -> DataFrame:
    """(source, k, size, m, c): all rows of (source, at, item) with their whole copies c, blocks folded up a tree until a source has one row left."""
    settled, level = None, 0
    while True:
        folded = items.groupBy("source", "at").agg(_fold(F.sort_array(F.collect_list("item")), level, seed).alias("f")).select("source", "at", "f.*")
        folded = stage_table(folded, "level")
        done = folded.select("source", F.inline("done"))
        settled = done if settled is None else settled.union(done)
        if most_blocks <= 1:
            break
        most_blocks, level = -(-most_blocks // block), level + 1
        item = F.struct(F.col("at").alias("order"), *[F.col(f"item.{c}").alias(c) for c in ("h", "k", "size", "m", "whole")], F.col("mass").alias("p"))
        items = folded.select("source", F.floor(F.col("at") / block).alias("at"), item.alias("item"))
    last = folded.select("source", "item", (_unit(F.col("item.h"), level + 1, seed) < F.col("mass")).cast("int").alias("up"))
    return settled.union(last).select("source", F.col("item.k").alias("k"), F.col("item.size").alias("size"), F.col("item.m").alias("m"), (F.col("item.whole") + F.col("up")).alias("c"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0, block: int = 256, seed: int = 20, steps: tuple[int, ...] = (4096, 512, 64, 0)) -> DataFrame:
    """One row for each row: key, source, size, source_size, target, copies, taken."""
    rows = docs.select(F.col(key).alias("k"), F.col(source).alias("source"), size_of(text).alias("size"), F.xxhash64(F.col(key).cast("string"), F.col(source), F.col(text)).alias("h"))
    step = F.coalesce(*[F.when(F.col("size") >= least, i) for i, least in enumerate(steps)])
    rows = stage_table(rows.groupBy("k", "source", "size", "h").agg(F.count("*").alias("m")), "sizes").withColumns({"step": step, "bin": F.floor(F.log2(F.col("size") + 1) * 4).cast("int")})
    bins = rows.groupBy("source", "step", "bin").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("m")).alias("words"))
    bins = bins.withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
    before = Window.partitionBy("source", "step").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = stage_table(bins.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0))), "bins")
    targets = stage_table(source_targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most), "targets")
    most_blocks = {r["step"]: r["b"] for r in bins.groupBy("source", "step").agg(F.sum("blocks").alias("b")).groupBy("step").agg(F.max("b").alias("b")).collect()}

    # what each source has still to take, and the words of the rows that it can take them from
    state = targets.select("source", F.col("target").alias("due"), F.col("source_size").cast("double").alias("rest"))
    settled = None
    for i in sorted(most_blocks):
        f = F.when(F.col("rest") > 0, F.least(F.greatest(F.col("due") / F.col("rest"), F.lit(0.0)), F.lit(float(most)))).otherwise(F.when(F.col("due") > 0, 1.0).otherwise(0.0))
        own = bins.where(F.col("step") == i)
        places = own.join(state, own["source"].eqNullSafe(state["source"])).select(own["source"].alias("s"), F.col("bin").alias("b"), "blocks", "first", f.alias("f"))
        mass, part = F.col("m") * F.col("f"), rows.where(F.col("step") == i)
        items = part.join(places, part["source"].eqNullSafe(places["s"]) & (part["bin"] == places["b"])).select(
            "source", (F.col("first") + F.pmod("h", "blocks")).alias("at"), F.struct((-F.col("size")).alias("order"), "h", "k", "size", "m", F.floor(mass).alias("whole"), (mass - F.floor(mass)).alias("p")).alias("item")
        )
        done = _rounded(items, most_blocks[i], block, seed + i)
        settled = done if settled is None else settled.union(done)
        took = done.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("c") * F.col("size")).alias("took"), F.sum(F.col("m") * F.col("size")).alias("had"))
        state = state.join(took, state["source"].eqNullSafe(took["s"]), "left").select("source", (F.col("due") - F.coalesce("took", F.lit(0))).alias("due"), (F.col("rest") - F.coalesce("had", F.lit(0))).alias("rest"))
        if i != max(most_blocks):
            state = stage_table(state, "due")
    if settled is None:
        settled = docs.sparkSession.createDataFrame([], f"source {docs.schema[source].dataType.simpleString()}, k {docs.schema[key].dataType.simpleString()}, size bigint, m bigint, c bigint")
    each = settled.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    copies = F.floor(F.col("c") / F.col("m")) + (F.col("i") < F.col("c") % F.col("m")).cast("long")
    each = each.select("k", "source", "size", copies.alias("copies"))
    out = each.join(targets, each["source"].eqNullSafe(targets["source"]))
    return out.select(F.col("k").alias(key), each["source"].alias(source), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
