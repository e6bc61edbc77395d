"""Ratio, momentum and volatility features of two-leg bars. Leg a is the numerator, leg b the denominator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import KEY, TS, change, clip, drop_incomplete, over_series, rolling, zscore
from ..sources.shared import staged
from .recurrence import ema, ewm_std

#: Rows after which averages of spans up to 30 hold nothing of what came before: (29 / 31) ** 800 is below 1e-23.
FORGOTTEN = 800

RATIO = ["ratio", "ratio_zscore_30", "ratio_zscore_90", "ratio_slope", "a_ret_5", "a_ret_20", "b_ret_5", "b_ret_20", "a_vol_20", "b_vol_20", "vol_ratio"]
MOMENTUM = ["a_ema_slope", "b_ema_slope", "ratio_ema_slope", "a_macd", "a_macd_signal", "a_macd_hist", "b_macd", "b_macd_signal", "b_macd_hist", "a_breakout", "b_breakout", "rel_strength_5", "rel_strength_20"]
VOLATILITY = ["a_vol_5", "b_vol_5", "a_vol_60", "b_vol_60", "a_atr_14", "b_atr_14", "a_atr_pct", "b_atr_pct", "vol_ratio_5", "vol_ratio_60", "a_cond_vol", "b_cond_vol", "cond_vol_ratio"]


def with_ratio(bars: DataFrame) -> DataFrame:
    return bars.withColumn("ratio", F.try_divide("a_close", "b_close"))


def with_returns(df: DataFrame) -> DataFrame:
    w = over_series()
    return df.withColumns({f"{leg}_ret_1": change(F.col(f"{leg}_close"), 1, w) for leg in "ab"})


def ratio_features(bars: DataFrame) -> DataFrame:
    """RATIO; vol_ratio is a over b."""
    w, df = over_series(), with_returns(with_ratio(bars))
    r = F.col("ratio")
    df = df.withColumns(
        {"ratio_zscore_30": zscore(r, 30, w), "ratio_zscore_90": zscore(r, 90, w), "ratio_slope": r - F.lag(r, 5).over(w)}
        | {f"{leg}_ret_{n}": change(F.col(f"{leg}_close"), n, w) for leg in "ab" for n in (5, 20)}
        | {f"{leg}_vol_20": rolling(F.stddev_samp, F.col(f"{leg}_ret_1"), 20, w) for leg in "ab"}
    )
    return df.withColumn("vol_ratio", F.try_divide("a_vol_20", "b_vol_20"))


def breakout(x: Column, size: int = 20) -> Column:
    """Place of the last value in the range of the last size rows, 0 to 1."""
    w = over_series()
    low, high = rolling(F.min, x, size, w), rolling(F.max, x, size, w)
    return (x - low) / clip(high - low, 1e-9)


def momentum_features(df: DataFrame) -> DataFrame:
    """MOMENTUM, from bars with ratio and the 5- and 20-row returns."""
    spans = {f"__{leg}_{n}": (c, n) for leg, c in (("a", "a_close"), ("b", "b_close"), ("r", "ratio")) for n in ((10, 30) if leg == "r" else (10, 30, 12, 26))}
    df = ema(df, spans)
    df = df.withColumns({f"{name}_ema_slope": F.col(f"__{k}_10") - F.col(f"__{k}_30") for name, k in (("a", "a"), ("b", "b"), ("ratio", "r"))} | {f"{leg}_macd": F.col(f"__{leg}_12") - F.col(f"__{leg}_26") for leg in "ab"}).drop(*spans)
    df = ema(df, {f"{leg}_macd_signal": (f"{leg}_macd", 9) for leg in "ab"})
    return df.withColumns(
        {f"{leg}_macd_hist": F.col(f"{leg}_macd") - F.col(f"{leg}_macd_signal") for leg in "ab"} | {f"{leg}_breakout": breakout(F.col(f"{leg}_close")) for leg in "ab"} | {f"rel_strength_{n}": F.col(f"a_ret_{n}") - F.col(f"b_ret_{n}") for n in (5, 20)}
    )


def volatility_features(df: DataFrame, conditional: bool = True) -> DataFrame:
    """VOLATILITY; vol_ratio_5, vol_ratio_60 and cond_vol_ratio are b over a. The conditional volatility is the exponentially weighted one."""
    w = over_series()
    moves = {f"__{leg}_move": F.abs(F.col(f"{leg}_close") - F.lag(f"{leg}_close", 1).over(w)) for leg in "ab"}
    df = df.withColumns(moves)
    df = df.withColumns({f"{leg}_vol_{n}": rolling(F.stddev_samp, F.col(f"{leg}_ret_1"), n, w) for leg in "ab" for n in (5, 60)} | {f"{leg}_atr_14": rolling(F.avg, F.col(f"__{leg}_move"), 14, w) for leg in "ab"}).drop(*moves)
    df = df.withColumns({f"{leg}_atr_pct": F.try_divide(f"{leg}_atr_14", f"{leg}_close") for leg in "ab"} | {f"vol_ratio_{n}": F.try_divide(f"b_vol_{n}", f"a_vol_{n}") for n in (5, 60)})
    if conditional:
        df = ewm_std(df, {f"{leg}_cond_vol": (f"{leg}_ret_1", 20) for leg in "ab"}).withColumn("cond_vol_ratio", F.try_divide("b_cond_vol", "a_cond_vol"))
    return df


def all_features(bars: DataFrame) -> DataFrame:
    """All features on all rows, those before the windows fill with NULLs."""
    return volatility_features(momentum_features(ratio_features(bars)))


def feature_frame(bars: DataFrame, staged: bool = False) -> DataFrame:
    """All features, complete rows only. staged drops incomplete rows after each of the three groups, which starts later averages later."""
    if not staged:
        return drop_incomplete(all_features(bars))
    df = drop_incomplete(momentum_features(drop_incomplete(ratio_features(bars))))
    return drop_incomplete(volatility_features(with_returns(df)))


def ratio_band(df: DataFrame, size: int = 30) -> DataFrame:
    """Mean of the ratio and one deviation around it."""
    w, r = over_series(), F.col("ratio")
    mean, dev = rolling(F.avg, r, size, w), rolling(F.stddev_samp, r, size, w)
    return df.withColumns({"band_mid": mean, "band_low": mean - dev, "band_high": mean + dev})


def halo_blocks(df: DataFrame, block_rows: int, halo: int) -> DataFrame:
    """For a series too long for one task: rows with bar_idx get a block, and the last halo rows of each block are copied to the next.

    Windows by (series_id, block_id) then see what a bounded frame of at most halo rows before needs; keep rows where is_halo is false.
    """
    if not 0 <= halo <= block_rows:
        raise ValueError(f"a halo of {halo} rows needs blocks of at least as many, not {block_rows}")
    block = F.floor(F.col("bar_idx") / block_rows)
    copies = F.when((F.col("bar_idx") % block_rows >= block_rows - halo) & (halo > 0), F.array(block, block + 1)).otherwise(F.array(block))
    return df.withColumn("block_id", F.explode(copies)).withColumn("is_halo", F.col("block_id") != block)


def long_bar_index(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """bar_idx without a series in one task: range partitions of (series, time), and counts of the earlier ones.

    The partitions are sorted and numbered in place; only their counts by series are added up.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the borders of a range partitioning are drawn anew each time it runs: written once, so that counts and rows see the same
    cut = staged(df.repartitionByRange(n, KEY, TS).withColumn("__p", F.spark_partition_id()), "ranges")
    counts = cut.groupBy(KEY, "__p").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(KEY).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy(KEY, "__p").orderBy(TS)) - 1
    return cut.withColumn("__own", own).join(before, [KEY, "__p"]).withColumn("bar_idx", F.col("__before") + F.col("__own")).drop("__p", "__own", "__before")


def blockwise(df: DataFrame, operator: Callable[[DataFrame, WindowSpec], DataFrame], halo: int, block_rows: int = 100_000) -> DataFrame:
    """operator(rows, window of a block) on series cut into blocks with the last halo rows before each, which go afterwards.

    Exact for frames of at most halo rows; averages that forget (spans up to 30) are exact to a double with FORGOTTEN.
    """
    blocks = halo_blocks(long_bar_index(df), max(block_rows, halo), halo)
    return operator(blocks, Window.partitionBy(KEY, "block_id").orderBy(TS)).where("not is_halo").drop("bar_idx", "block_id", "is_halo")


def long_series_features(bars: DataFrame, block_rows: int = 100_000) -> DataFrame:
    """feature_frame for series too long for one task: each block with its halo is a series of its own."""

    def features(rows: DataFrame, _: WindowSpec) -> DataFrame:
        named = rows.withColumns({"__series": F.col(KEY), KEY: F.concat_ws("#", KEY, "block_id")})
        # rows of a later block that are complete are those past its halo, as it is longer than any frame
        return feature_frame(named).withColumn(KEY, F.col("__series")).drop("__series")

    return blockwise(bars, features, FORGOTTEN, block_rows)
