"""Column helpers with one place each for missing values, guarded frames, clipping and ranks.

Missing values are NULL everywhere, never NaN; a division by zero is NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY, TS = "series_id", "ts"


def over_series(*more: str, order: str = TS) -> WindowSpec:
    """Rows of a series (and of further keys) in time order: the one window specification that all operators share."""
    return Window.partitionBy(KEY, *more).orderBy(order)


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = [c for c, t in df.dtypes if t in ("double", "float") and (columns is None or c in columns)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names}) if names else df


def require_columns(df: DataFrame, columns: Sequence[str], caller: str) -> None:
    """ValueError with all names that are not there; looks at the schema only."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{caller}: missing columns {missing}")


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a NULL or NaN in the columns (all, if none are named)."""
    return df.dropna("any", subset=list(columns) if columns else None)


def forward_fill(x: str | Column, w: WindowSpec, limit: int = 3) -> Column:
    """The last value of this row and at most limit rows before it."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(-limit, 0))


def rolling(agg: Callable[[Column], Column], x: Column, size: int, w: WindowSpec, min_periods: int | None = None) -> Column:
    """agg over the last size rows; NULL until the frame holds min_periods values (size, if not given)."""
    frame = w.rowsBetween(-(size - 1), 0)
    return F.when(F.count(x).over(frame) >= (size if min_periods is None else min_periods), agg(x).over(frame))


def change(x: Column, n: int, w: WindowSpec) -> Column:
    """Relative change over n rows."""
    return F.try_divide(x, F.lag(x, n).over(w)) - 1


def forward_change(x: Column, n: int, w: WindowSpec) -> Column:
    return F.try_divide(F.lead(x, n).over(w), x) - 1


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """NULL stays NULL, unlike with greatest and least."""
    y = x if low is None else F.greatest(F.lit(float(low)), x)
    y = y if high is None else F.least(F.lit(float(high)), y)
    return F.when(x.isNotNull(), y)


def zscore(x: Column, size: int, w: WindowSpec) -> Column:
    return F.try_divide(x - rolling(F.avg, x, size, w), rolling(F.stddev_samp, x, size, w))


def soft_zscore(x: Column, w: WindowSpec, size: int = 60) -> Column:
    """From half a window on, with the deviation held above 1e-9."""
    half = size // 2
    return (x - rolling(F.avg, x, size, w, half)) / clip(rolling(F.stddev_samp, x, size, w, half), 1e-9)


def average_rank(x: str, keys: Sequence[str]) -> Column:
    """Rank among the rows of the keys; ties share the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2


def correlation(x: str, y: str) -> Column:
    """Pearson's; NULL for a constant."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def bar_index(df: DataFrame) -> DataFrame:
    """bar_idx (from 0) and n_bars of each series."""
    everything = Window.partitionBy(KEY)
    return df.withColumns({"bar_idx": (F.row_number().over(over_series()) - 1).cast("long"), "n_bars": F.count("*").over(everything)})
