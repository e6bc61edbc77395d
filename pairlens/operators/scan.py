"""Running values of a long series in two levels: blocks side by side, then their summaries along the series.

A series is cut into blocks of ``block_rows`` rows. A block is one task's work and leaves one summary: for y[t] = a * y[t-1] + b[t] the affine map
y -> A y + B over the whole block, for running products, sums and maxima their value over it. Summaries, one row for each block, are put together along the series, and
each block starts from what came before it. Nothing is forgotten, however slow the decay, and no task has more rows of a series than a block and the summaries.

This takes a shuffle and a written table more than windows over a whole series do; operators take ``block_rows`` to go this way.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEY, TS
from ..sources.shared import staged
from .recurrence import Recurrence, linear_recurrence

BLOCK, INDEX = "block_id", "bar_idx"


@dataclass(frozen=True)
class Scan:
    """name = the running value over column. kind: affine (name = decay * (name, one row before) + column, from 0), product, sum or max.

    A NULL input changes nothing, and counts as 0 in an affine one. A decay may be a column that is constant in a series, between least and most.
    """

    name: str
    kind: str
    column: str
    decay: float | str = 1.0
    least: float | None = None
    most: float | None = None


def numbered(df: DataFrame, keys: Sequence[str] = (KEY,), order: str = TS, block_rows: int = 100_000) -> DataFrame:
    """Adds bar_idx (from 0 in each series), n_bars and block_id without a series in one task.

    Range partitions of (keys, order), as many as the rows fill, are sorted and numbered in place; counts of the earlier ones, a row for each series and partition, are added up.
    """
    n = max(1, -(-df.count() // block_rows))
    # the borders of ranges are drawn anew each time they are run: written once, so that counts and rows see the same
    cut = staged(df.repartitionByRange(n, *keys, order).withColumn("__p", F.spark_partition_id()), "ranges")
    by = Window.partitionBy(*keys)
    counts = cut.groupBy(*keys, "__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(by.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*keys, "__p", before.alias("__before"), F.sum("__n").over(by).alias("n_bars"))
    own = F.row_number().over(Window.partitionBy(*keys, "__p").orderBy(order)) - 1
    rows = cut.withColumn("__own", own).join(counts, [*keys, "__p"]).withColumn(INDEX, (F.col("__before") + F.col("__own")).cast("long"))
    return rows.drop("__p", "__own", "__before").withColumn(BLOCK, F.floor(F.col(INDEX) / block_rows))


def _inside(rows: DataFrame, scans: Sequence[Scan], keys: Sequence[str]) -> DataFrame:
    """Adds each scan's value inside its block, as if nothing came before."""
    w = Window.partitionBy(*keys, BLOCK).orderBy(INDEX).rowsBetween(Window.unboundedPreceding, 0)
    made = {}
    for s in scans:
        x = F.col(s.column)
        if s.kind == "product":
            made[s.name] = F.product(F.coalesce(x, F.lit(1.0))).over(w)
        elif s.kind == "sum":
            made[s.name] = F.sum(F.coalesce(x, F.lit(0.0))).over(w)
        elif s.kind == "max":
            made[s.name] = F.max(x).over(w)
        elif s.kind != "affine":
            raise ValueError(f"{s.kind} is no scan")
    rows = rows.withColumns(made) if made else rows
    for s in scans:
        if s.kind == "affine":
            rows = linear_recurrence(rows, [Recurrence(s.name, s.decay, s.column, s.least, s.most)], (*keys, BLOCK), INDEX)
    return rows


def _power(s: Scan, n: Column) -> Column:
    return F.pow(F.lit(s.decay) if isinstance(s.decay, float) else F.col(s.decay), n)


def _carried(ends: DataFrame, scans: Sequence[Scan], keys: Sequence[str]) -> DataFrame:
    """(keys, block_id, __c_name): what reaches each block, from the blocks' ends (keys, block_id, __e_name, and __m_name, an affine map's factor)."""
    w = Window.partitionBy(*keys).orderBy(BLOCK)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    affine = [s for s in scans if s.kind == "affine"]
    if affine:
        # maps are composed by doubling: after each step a row holds that of twice as many blocks
        most = ends.agg(F.max(BLOCK)).first()[0] or 0
        for k in range(math.ceil(math.log2(most + 1)) if most else 0):
            now = {}
            for s in affine:
                m, e = F.col(f"__m_{s.name}"), F.col(f"__e_{s.name}")
                now |= {f"__e_{s.name}": e + m * F.coalesce(F.lag(e, 2**k).over(w), F.lit(0.0)), f"__m_{s.name}": m * F.coalesce(F.lag(m, 2**k).over(w), F.lit(1.0))}
            ends = ends.withColumns(now)
    total = {"product": lambda c: F.product(c).over(before), "sum": lambda c: F.sum(c).over(before), "max": lambda c: F.max(c).over(before), "affine": lambda c: F.lag(c).over(w)}
    return ends.select(*keys, BLOCK, *[total[s.kind](F.col(f"__e_{s.name}")).alias(f"__c_{s.name}") for s in scans])


def scan(rows: DataFrame, scans: Sequence[Scan], keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Adds a column for each scan to numbered rows."""
    inside = staged(_inside(rows, scans, keys), "inside")
    last = lambda c: F.max_by(c, INDEX)
    of = lambda s: F.lit(s.decay) if isinstance(s.decay, float) else F.col(s.decay)
    ends = inside.groupBy(*keys, BLOCK).agg(
        *[last(s.name).alias(f"__e_{s.name}") for s in scans], *[F.pow(F.max(of(s)), F.count("*").cast("double")).alias(f"__m_{s.name}") for s in scans if s.kind == "affine"], F.min(INDEX).alias("__first")
    )
    both = inside.join(_carried(ends, scans, keys).join(ends.select(*keys, BLOCK, "__first"), [*keys, BLOCK]), [*keys, BLOCK])
    done = {}
    for s in scans:
        x, c = F.col(s.name), F.col(f"__c_{s.name}")
        if s.kind == "product":
            done[s.name] = x * F.coalesce(c, F.lit(1.0))
        elif s.kind == "sum":
            done[s.name] = x + F.coalesce(c, F.lit(0.0))
        elif s.kind == "max":
            done[s.name] = F.greatest(x, c)
        else:
            done[s.name] = x + _power(s, (F.col(INDEX) - F.col("__first") + 1).cast("double")) * F.coalesce(c, F.lit(0.0))
    return both.withColumns(done).select(*inside.columns)
