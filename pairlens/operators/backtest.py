"""Backtests without look-ahead, walk-forward windows, metrics, rank correlations and the decay of alpha.

A position depends only on the row before, so a fold's profit and loss is a lag over its rows; nothing is sequential.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import KEY, TS, average_rank, bar_index, correlation, forward_change, over_series
from ..sources.shared import staged
from .features import halo_blocks
from .scan import BLOCK, INDEX, Scan, numbered, scan
from .signals import available_signals, position_size, rule_signal

METRICS = ["sharpe", "cagr", "max_drawdown", "hit_rate", "calmar"]


def apply_costs(returns: Column, switched: Column, spread: float | Column = 0.0002, slippage: float | Column = 0.0001) -> Column:
    return returns - switched * (F.lit(spread) + F.lit(slippage) if not isinstance(spread, Column) else spread + slippage)


def trade(df: DataFrame, keys: Sequence[str] = (), signal_col: str | None = None, spread: float | Column = 0.0002, slippage: float | Column = 0.0001, block_rows: int | None = None) -> DataFrame:
    """All rows of each fold (series and keys): signal, size, switched, daily_return, capital; the last two are NULL on the first row.

    The first row only gives the price before; on the second the position is still flat and is set at its close. A switch is paid
    on the row where the new signal is seen. signal_col trades a column of 'a' and 'b' in place of the rule. With block_rows a fold of any length is
    traded in blocks of so many rows, each seeing the last row of the one before, and capital and peak are scans over blocks (peak and drawdown are then there too).
    """
    df = df.withColumn("signal", F.col(signal_col) if signal_col else rule_signal())
    df = df.withColumn("size", position_size(F.col("signal")))
    if block_rows is None:
        w = over_series(*keys)
        df = paid(df.withColumn("bar_no", F.row_number().over(w) - 1), w, spread, slippage)
        return df.withColumn("capital", growth("daily_return", w))
    by = (KEY, *keys)
    own = [c for c in (INDEX, "n_bars") if c in df.columns]
    blocks = halo_blocks(numbered(df.withColumnsRenamed({c: f"__{c}" for c in own}), by, TS, block_rows).drop(BLOCK), block_rows, 1)
    rows = paid(blocks.withColumn("bar_no", F.col(INDEX)), Window.partitionBy(*by, BLOCK).orderBy(INDEX), spread, slippage).where("not is_halo").drop("is_halo")
    rows = scan(rows.withColumn("__growth", 1 + F.col("daily_return")), [Scan("capital", "product", "__growth")], by)
    rows = rows.withColumn("capital", F.when(F.col("daily_return").isNotNull(), F.col("capital")))
    rows = scan(rows, [Scan("peak", "max", "capital")], by).withColumn("drawdown", fall())
    return rows.drop("__growth", INDEX, "n_bars", BLOCK).withColumnsRenamed({f"__{c}": c for c in own})


def fall() -> Column:
    return F.try_divide(F.col("capital") - F.col("peak"), F.col("peak"))


def paid(df: DataFrame, w: WindowSpec, spread: float | Column, slippage: float | Column) -> DataFrame:
    """gross, held_size, switched and daily_return, from rows with bar_no whose window holds the row before."""
    held = F.col("bar_no") >= 2
    leg = lambda c: F.try_divide(F.col(c), F.lag(c).over(w)) - 1
    df = df.withColumns(
        {
            "gross": F.when(held, F.when(F.lag("signal").over(w) == "a", leg("a_close")).otherwise(leg("b_close"))).otherwise(0.0),
            "held_size": F.when(held, F.lag("size").over(w)).otherwise(0.0),
            "switched": F.when(held & (F.col("signal") != F.lag("signal").over(w)), 1).otherwise(0),
        }
    )
    net = apply_costs(F.col("held_size") * F.col("gross"), F.col("switched"), spread, slippage)
    return df.withColumn("daily_return", F.when(F.col("bar_no") >= 1, net))


def growth(returns: str, w: WindowSpec) -> Column:
    """Running product of 1 + returns; NULL before the first return."""
    return F.when(F.col(returns).isNotNull(), F.product(1 + F.col(returns)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def run_folds(df: DataFrame, keys: Sequence[str] = (), **options) -> DataFrame:
    """The traded rows of each fold: those after its first."""
    return trade(df, keys, **options).where("bar_no >= 1")


def drawdowns(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    if {"peak", "drawdown"} <= set(curve.columns):
        return curve
    peak = F.max("capital").over(over_series(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return curve.withColumn("peak", peak).withColumn("drawdown", fall())


def metrics(curve: DataFrame, keys: Sequence[str] = (), per_year: int = 252) -> DataFrame:
    """METRICS, final_capital, total_return and n_turns of each fold, rounded to 4 places (the last three are not)."""
    r, n = F.col("daily_return"), F.count("*")
    growth = F.try_divide(F.max_by("capital", TS), F.min_by("capital", TS))
    out = drawdowns(curve, keys).groupBy(KEY, *keys).agg(
        F.coalesce(F.try_divide(F.avg(r), F.stddev_samp(r)) * F.sqrt(F.lit(float(per_year))), F.lit(0.0)).alias("sharpe"),
        F.when(n < 2, 0.0).when(growth <= 0, -1.0).otherwise(F.pow(growth, F.lit(float(per_year)) / n) - 1).alias("cagr"),
        F.min("drawdown").alias("max_drawdown"),
        F.coalesce(F.avg(F.when(r != 0, (r > 0).cast("double"))), F.lit(0.0)).alias("hit_rate"),
        F.max_by("capital", TS).alias("final_capital"),
        F.sum("switched").alias("n_turns"),
    )
    out = out.withColumn("calmar", F.coalesce(F.try_divide(F.col("cagr"), F.abs("max_drawdown")), F.lit(0.0)))
    return out.select(KEY, *keys, *[F.round(m, 4).alias(m) for m in METRICS], "final_capital", (F.col("final_capital") - 1).alias("total_return"), F.col("n_turns").cast("long").alias("n_turns"))


def compute_metrics(returns: DataFrame, keys: Sequence[str] = (), column: str = "daily_return", changes: str | None = None, spread: float = 0.0002, slippage: float = 0.0001, per_year: int = 252) -> DataFrame:
    """Metrics of given returns of each series and keys. changes: a 0/1 column of position changes, which are paid for before the curve is built."""
    w = over_series(*keys)
    net = F.col(column) if changes is None else apply_costs(F.col(column), F.col(changes), spread, slippage)
    rows = returns.where(F.col(column).isNotNull()).withColumns({"daily_return": net, "switched": F.coalesce(F.col(changes), F.lit(0)) if changes else F.lit(0)})
    return metrics(rows.withColumn("capital", growth("daily_return", w)), keys, per_year)


def backtest(df: DataFrame, **costs) -> DataFrame:
    """The frame with signal, size, switched, capital and daily_return; the last two are NULL on each series' first row."""
    return trade(df, **costs).drop("bar_no", "gross", "held_size")


def cost_sweep(df: DataFrame, grid: Sequence[tuple[float, float]]) -> DataFrame:
    """Metrics for each (spread, slippage) of a short list, as rows of one job."""
    settings = F.array(*[F.struct(F.lit(float(a)).alias("spread"), F.lit(float(b)).alias("slippage")) for a, b in grid])
    wide = df.select("*", F.inline(settings))
    return metrics(run_folds(wide, ["spread", "slippage"], spread=F.col("spread"), slippage=F.col("slippage")), ["spread", "slippage"])


def rolling_windows(df: DataFrame, size: int | Column = 60, step: int | Column = 20, purge: int | Column = 5) -> DataFrame:
    """A row for each bar and window that holds it. Window k starts at row k * (step + purge) and must fit in the series. A size or step may be a column."""
    i, n = F.col("bar_idx"), F.col("n_bars")
    size, step, purge = (x if isinstance(x, Column) else F.lit(x) for x in (size, step, purge))
    stride = step + purge
    low = F.greatest(F.lit(0).cast("long"), F.ceil((i - size + 1) / stride))
    high = F.least(F.floor(i / stride), F.floor((n - size) / stride))
    rows = df if {"bar_idx", "n_bars"} <= set(df.columns) else bar_index(df)
    return rows.withColumns({"__low": low, "__high": high}).where("__high >= __low").withColumn("window_idx", F.explode(F.sequence("__low", "__high"))).drop("__low", "__high")


def window_sweep(df: DataFrame, grid: Sequence[tuple[int, int]], purge: int = 5, **costs) -> DataFrame:
    """Means of the window metrics for each (window, step) of a short list, as rows of one job."""
    settings = F.array(*[F.struct(F.lit(a).alias("window"), F.lit(b).alias("step")) for a, b in grid])
    folds = rolling_windows(bar_index(df).select("*", F.inline(settings)), F.col("window"), F.col("step"), purge)
    each = metrics(run_folds(folds, ["window", "step", "window_idx"], **costs), ["window", "step", "window_idx"])
    return each.groupBy(KEY, "window", "step").agg(F.count("*").alias("n_windows"), *[F.avg(m).alias(m) for m in METRICS])


def anchored_folds(df: DataFrame, n_splits: int = 5, purge: int = 20, least: int = 30) -> DataFrame:
    """fold (from 1) of each bar. Test folds of max(n / (splits + 1), least) rows follow one another after the purge; those that overrun the series are left out."""
    rows = df if {"bar_idx", "n_bars"} <= set(df.columns) else bar_index(df)
    rows = rows.withColumn("__size", F.greatest(F.floor(F.col("n_bars") / (n_splits + 1)), F.lit(least)))
    fold = F.floor((F.col("bar_idx") - purge) / F.col("__size"))
    rows = rows.withColumn("fold", fold.cast("long"))
    fits = F.col("fold").between(1, n_splits) & ((F.col("fold") + 1) * F.col("__size") + purge <= F.col("n_bars"))
    return rows.where(fits).drop("__size")


def fold_spans(folds: DataFrame, key: str) -> DataFrame:
    return folds.groupBy(KEY, key).agg(F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts"), F.count("*").alias("n_bars"))


def anchored_curve(df: DataFrame, n_splits: int = 5, purge: int = 20, **costs) -> DataFrame:
    """The traded rows of all anchored test folds of at least 10 bars one after the other; capital starts at 1 in each."""
    folds = anchored_folds(df, n_splits, purge)
    whole = folds.withColumn("__n", F.count("*").over(Window.partitionBy(KEY, "fold"))).where("__n >= 10").drop("__n")
    return run_folds(whole, ["fold"], **costs)


def walk_forward_anchored(df: DataFrame, n_splits: int = 5, purge: int = 20, block_rows: int | None = None, **costs) -> DataFrame:
    """Metrics and span of each anchored test fold of at least 10 bars. With block_rows bars are numbered, and folds traded, in blocks."""
    if block_rows is not None:
        df, costs = numbered(df, (KEY,), TS, block_rows).drop(BLOCK), costs | {"block_rows": block_rows}
    folds = anchored_folds(df, n_splits, purge)
    return fold_spans(folds, "fold").where("n_bars >= 10").join(metrics(run_folds(folds, ["fold"], **costs), ["fold"]), [KEY, "fold"])


def fold_means(folds: DataFrame) -> DataFrame:
    return folds.groupBy(KEY).agg(*[F.avg(m).alias(m) for m in METRICS], F.count("*").alias("n_folds"))


def information_coefficients(folds: DataFrame, signals: Sequence[str], key: str = "window_idx", least: int = 10) -> DataFrame:
    """Spearman correlation of each signal with the negative change ahead (column fwd) in each window, and their mean.

    NULL below least complete pairs, and for a constant. Single ones are rounded to 6 places, the mean is of unrounded ones.
    """
    long = folds.select(KEY, key, (-F.col("fwd")).alias("y"), F.inline(F.array(*[F.struct(F.lit(s).alias("signal_name"), F.col(s).alias("x")) for s in signals]))).where("x is not null and y is not null")
    by = [KEY, key, "signal_name"]
    ranked = long.select(*by, average_rank("x", by).alias("rx"), average_rank("y", by).alias("ry"))
    each = ranked.groupBy(*by).agg(F.when(F.count("*") >= least, correlation("rx", "ry")).alias("ic"))
    return each.groupBy(KEY, key).agg(*[F.round(F.max(F.when(F.col("signal_name") == s, F.col("ic"))), 6).alias(f"ic_{s}") for s in signals], F.avg("ic").alias("ic_composite"))


def walk_forward_rolling(df: DataFrame, size: int = 60, step: int = 20, purge: int = 5, ahead: int = 5, signals: Sequence[str] | None = None, block_rows: int | None = None, **costs) -> DataFrame:
    """Metrics, span and information coefficients of each rolling window. Changes ahead are of the whole series.

    Windows are groups of their own; with block_rows bars are numbered, and meet the bars ahead of them, without a series in one task.
    """
    signals = list(signals or available_signals(df))
    needed = [KEY, TS, "ratio", "a_close", "b_close", "ratio_zscore_30", "ratio_slope", "a_vol_20", "b_vol_20", *signals, *([costs["signal_col"]] if costs.get("signal_col") else [])]
    if block_rows is None:
        df = df.withColumn("fwd", forward_change(F.col("ratio"), ahead, over_series())).select(*dict.fromkeys(needed), "fwd")
    else:
        rows = numbered(df.select(*dict.fromkeys(needed)), (KEY,), TS, block_rows).drop(BLOCK)
        later = rows.select(KEY, (F.col(INDEX) - ahead).alias(INDEX), F.col("ratio").alias("__later"))
        df = rows.join(later, [KEY, INDEX], "left").withColumn("fwd", F.try_divide("__later", "ratio") - 1).drop("__later")
    folds = rolling_windows(df, size, step, purge)
    # spans, metrics and coefficients start from the windows
    folds = staged(folds, "windows")
    out = fold_spans(folds, "window_idx").join(metrics(run_folds(folds, ["window_idx"], **costs), ["window_idx"]), [KEY, "window_idx"])
    return out.join(information_coefficients(folds, signals), [KEY, "window_idx"], "left")


def summary(folds: DataFrame) -> DataFrame:
    """mean, std, min, max of each metric over windows, rounded to 4; share of windows above zero for two of them."""
    names = [*METRICS, "ic_composite"]
    long = folds.select(KEY, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in names])))
    positive = F.when(F.first("metric").isin("sharpe", "ic_composite"), F.avg(F.coalesce(F.col("v") > 0, F.lit(False)).cast("double")))
    aggs = {"mean": F.avg("v"), "std": F.stddev_samp("v"), "min": F.min("v"), "max": F.max("v"), "pct_positive_windows": positive}
    return long.groupBy(KEY, "metric").agg(*[F.round(c, 4).alias(n) for n, c in aggs.items()])


def alpha_curve(folds: DataFrame) -> DataFrame:
    """The windows with normalized_alpha: the composite coefficient over that of the first window, without its sign."""
    first = F.first("ic_composite").over(Window.partitionBy(KEY).orderBy("window_idx").rowsBetween(Window.unboundedPreceding, 0))
    return folds.withColumn("normalized_alpha", F.try_divide(F.col("ic_composite"), F.abs(first)))


def ic_statistics(folds: DataFrame) -> DataFrame:
    x = F.col("ic_composite")
    return folds.groupBy(KEY).agg(F.avg(x).alias("ic_mean"), F.stddev_samp(x).alias("ic_std"), F.min(x).alias("ic_min"), F.max(x).alias("ic_max"), F.avg("sharpe").alias("mean_sharpe"), F.avg("hit_rate").alias("mean_hit_rate"), F.count("*").alias("n_windows"))


def decay_grid(low: float = 1e-3, high: float = 5.0, n: int = 60) -> list[float]:
    """Decay rates: none, and equal steps of their logarithm."""
    return [0.0, *(low * (high / low) ** (k / (n - 1)) for k in range(n))]


def fit_decay(curve: DataFrame, value: str = "ic_composite", t: str = "window_idx", step_days: float = 20, stride_days: float | None = None, refinements: int = 3, least: int = 4) -> DataFrame:
    """value = a * exp(-b t) + c with b >= 0 by least squares: for each b of a grid the rest is linear regression, the best b is refined.

    Without decay (b = 0) the curve is its mean, its half-life infinite. alpha_initial is a + c, the curve at its start. Half-lives in
    days take step_days a window, in the classic form the step alone; stride_days (step and purge) is the true distance of windows.
    The grid is a short literal array, so candidates are rows beside the points; each round is one aggregation. Fewer than least
    points: NULLs and fit_success false.
    """
    points = curve.where(F.col(value).isNotNull()).select(KEY, F.col(t).cast("double").alias("t"), F.col(value).alias("y"))
    enough = curve.groupBy(KEY).agg(F.count(value).alias("n_points"))

    def best(rows: DataFrame) -> DataFrame:
        flat, x = F.col("b") == 0, F.exp(-F.col("b") * F.col("t"))
        fits = rows.withColumn("x", x).groupBy(KEY, "b").agg(
            F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("c"), (F.regr_syy("y", "x") * (1 - F.regr_r2("y", "x"))).alias("sse"), F.avg("y").alias("mean"), F.regr_syy("y", "y").alias("spread")
        )
        fits = fits.select(KEY, "b", F.when(flat, 0.0).otherwise(F.col("a")).alias("a"), F.when(flat, F.col("mean")).otherwise(F.col("c")).alias("c"), F.when(flat, F.col("spread")).otherwise(F.col("sse")).alias("sse"))
        return fits.where("a is not null and sse is not null").groupBy(KEY).agg(F.min(F.struct("sse", "b", "a", "c")).alias("fit")).select(KEY, "fit.*")

    grid = decay_grid()
    found = best(points.withColumn("b", F.explode(F.array(*map(F.lit, grid)))))
    for near in refining(grid[2] / grid[1], refinements):
        rates = found.select(KEY, F.explode(F.transform(F.array(*map(F.lit, near)), lambda x: F.col("b") * x)).alias("b")).distinct()
        found = best(points.join(rates, KEY))
    out = enough.join(found, KEY, "left")
    ok = (F.col("n_points") >= least) & F.col("b").isNotNull()
    half = F.when(F.col("b") > 1e-9, F.log(F.lit(2.0)) / F.col("b")).otherwise(F.lit(float("inf")))
    shown = {"alpha_initial": (F.col("a") + F.col("c"), 6), "alpha_floor": (F.col("c"), 6), "decay_rate": (F.col("b"), 6), "half_life_windows": (half, 2), "half_life_days": (half * float(stride_days or step_days), 1)}
    # rounding is for finite numbers
    rounded = lambda x, n: F.when(F.abs(x) < float("inf"), F.round(x, n)).otherwise(x)
    return out.select(KEY, *[F.when(ok, rounded(x, n)).alias(name) for name, (x, n) in shown.items()], F.when(ok, F.col("sse")).alias("sse"), ok.alias("fit_success"))


def refining(ratio: float, rounds: int) -> list[list[float]]:
    """Factors around the best rate so far, from one step of the last grid below it to one above."""
    return [[ratio ** ((k / 8 - 1) / 8**r) for k in range(17)] for r in range(rounds)]
