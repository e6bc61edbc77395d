"""Linear recurrences y[t] = a * y[t-1] + b[t] over the rows of a series, as windows.

Rows are cut into blocks. Inside a block, y without what came before is a^j times the running sum of b * a^-j. The block is as long as a^-j can be without
overflow, so the decay over a whole block is tiny: what goes into a block is the last value of the block before, and of as many earlier
ones as still matter to a double (none, for usual spans). Each of these is a running window over the same partitioning: no join, and no step
that is sequential over a series.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEY, TS

#: exp of this is far below the largest double; the square of a price times it still is.
_LOG_LIMIT = 500.0
_MOST_BLOCK = 1 << 16
#: A decay to exp(-_FORGOTTEN) is nothing to a double.
_FORGOTTEN, _MOST_EARLIER = 42.0, 20


@dataclass(frozen=True)
class Recurrence:
    """name = decay * (name, one row before) + input. decay: a number, or a column that is constant in a series and between least and most."""

    name: str
    decay: float | str
    input: str
    least: float | None = None
    most: float | None = None

    def bounds(self) -> tuple[float, float]:
        return (self.decay, self.decay) if isinstance(self.decay, float) else (self.least, self.most)


def block_rows(recurrences: list[Recurrence]) -> int:
    least = min(r.bounds()[0] for r in recurrences)
    return max(2, min(_MOST_BLOCK, int(_LOG_LIMIT / -math.log(least)))) if 0 < least < 1 else _MOST_BLOCK


def _power(decay: float | str, n: Column) -> Column:
    return F.pow(F.lit(decay) if isinstance(decay, float) else F.col(decay), n)


def linear_recurrence(df: DataFrame, recurrences: list[Recurrence], keys: tuple[str, ...] = (KEY,), order: str = TS, block: int | None = None) -> DataFrame:
    """Adds a column for each recurrence. A NULL input counts as 0."""
    most = max(r.bounds()[1] for r in recurrences)
    # at most _MOST_EARLIER blocks before the last are looked back on
    size = max(block or block_rows(recurrences), math.ceil(_FORGOTTEN / (_MOST_EARLIER * -math.log(most))) if 0 < most < 1 else 2)
    if size > block_rows(recurrences):
        raise ValueError(f"decays from {min(r.bounds()[0] for r in recurrences)} to {most} lie too far apart for one call")
    w = Window.partitionBy(*keys).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__i", F.row_number().over(w) - 1).withColumns({"__block": F.floor(F.col("__i") / size), "__at": (F.col("__i") % size).cast("double")})
    inside = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__y_{r.name}": F.sum(F.coalesce(F.col(r.input), F.lit(0.0)) * _power(r.decay, -F.col("__at"))).over(inside) * _power(r.decay, F.col("__at")) for r in recurrences})
    is_end = F.col("__at") == size - 1
    rows = rows.withColumns({f"__e_{r.name}": F.when(is_end, F.col(f"__y_{r.name}")) for r in recurrences})
    earlier = math.ceil(_FORGOTTEN / (size * -math.log(most))) - 1 if 0 < most < 1 else 0
    for _ in range(earlier):
        rows = rows.withColumns({f"__e_{r.name}": F.when(is_end, F.col(f"__y_{r.name}") + _power(r.decay, F.lit(float(size))) * F.coalesce(F.last(f"__e_{r.name}", ignorenulls=True).over(before), F.lit(0.0))) for r in recurrences})
    out = {r.name: F.col(f"__y_{r.name}") + _power(r.decay, F.col("__at") + 1) * F.coalesce(F.last(f"__e_{r.name}", ignorenulls=True).over(before), F.lit(0.0)) for r in recurrences}
    return rows.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def ema(df: DataFrame, specs: dict[str, tuple[str, int]], keys: tuple[str, ...] = (KEY,), order: str = TS, block: int | None = None) -> DataFrame:
    """Exponential moving averages {name: (column, span)}: recursive, seeded with the first value."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1
    parts, temp = [], {}
    for name, (column, span) in specs.items():
        alpha = 2.0 / (span + 1)
        temp[f"__in_{name}"] = F.when(first, F.col(column)).otherwise(F.col(column) * alpha)
        parts.append(Recurrence(name, 1.0 - alpha, f"__in_{name}"))
    return linear_recurrence(df.withColumns(temp), parts, keys, order, block).drop(*temp)


def ewm_std(df: DataFrame, specs: dict[str, tuple[str, int]], keys: tuple[str, ...] = (KEY,), order: str = TS, block: int | None = None) -> DataFrame:
    """Unbiased exponentially weighted deviations {name: (column, span)} with all weights normalised. NULL inputs must lead only."""
    parts, temp = [], {}
    for name, (column, span) in specs.items():
        a, x = 1.0 - 2.0 / (span + 1), F.col(column)
        for k, (value, decay) in enumerate(((F.when(x.isNotNull(), 1.0), a), (x, a), (x * x, a), (F.when(x.isNotNull(), 1.0), a * a))):
            temp[f"__i{k}_{name}"] = value
            parts.append(Recurrence(f"__s{k}_{name}", decay, f"__i{k}_{name}"))
    out = linear_recurrence(df.withColumns(temp), parts, keys, order, block)
    made = {}
    for name in specs:
        s0, s1, s2, q = (F.col(f"__s{k}_{name}") for k in range(4))
        variance = (F.try_divide(s2, s0) - F.pow(F.try_divide(s1, s0), 2.0)) * F.try_divide(s0 * s0, s0 * s0 - q)
        made[name] = F.when(s0 * s0 - q > 1e-12, F.sqrt(F.greatest(variance, F.lit(0.0))))
    return out.select(*df.columns, *[c.alias(n) for n, c in made.items()])
