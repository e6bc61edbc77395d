"""Rule signal, position size, and three strategy signals weighted by regime. Sides: 'a' or 'b' is the leg to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEY, TS, clip, forward_change, over_series, require_columns, rolling, soft_zscore

#: Confidence multiplier of each strategy in each regime; 1.0 for any other.
REGIME_WEIGHTS = {
    "mean_reversion": {"crisis": 1.5, "range_bound": 1.3, "risk_on": 0.8, "trending": 0.4},
    "momentum": {"trending": 1.5, "risk_on": 1.2, "crisis": 0.7, "range_bound": 0.4},
    "breakout": {"trending": 1.4, "risk_on": 1.1, "crisis": 0.8, "range_bound": 0.3},
}
SIGNALS = ["mr_signal", "mom_signal", "bo_signal"]
STRATEGY = [f"{p}_{k}" for p in ("mr", "mom", "bo") for k in ("signal", "confidence")]
CLASSES = {0: "BUY_A", 1: "HOLD", 2: "BUY_B"}


def rule_signal(z: str = "ratio_zscore_30", slope: str = "ratio_slope", z_limit: float = 1.0, slope_limit: float = 0.5) -> Column:
    """Reversion while the ratio is stretched and hardly moves, else with the trend. NULLs fall through to b."""
    calm = F.abs(slope) < slope_limit
    return F.when((F.col(z) > z_limit) & calm, "b").when((F.col(z) < -z_limit) & calm, "a").when(F.col(slope) > 0, "a").otherwise("b")


def position_size(signal: Column, target: float = 0.01, most: float = 1.0) -> Column:
    """Target volatility over the held leg's 20-row volatility, at most most; most if that is NULL or not positive."""
    vol = F.when(signal == "a", F.col("a_vol_20")).otherwise(F.col("b_vol_20"))
    return F.when(vol.isNull() | (vol <= 0), float(most)).otherwise(F.least(F.try_divide(F.lit(float(target)), vol), F.lit(float(most))))


def regime_weight(strategy: str, regime: str = "regime") -> Column:
    weights = F.create_map(*[F.lit(x) for pair in REGIME_WEIGHTS[strategy].items() for x in pair])
    return F.coalesce(F.try_element_at(weights, F.col(regime)), F.lit(1.0))


def mean_reversion_signals(df: DataFrame) -> DataFrame:
    require_columns(df, ["ratio_zscore_30", "ratio_zscore_90", "ratio_slope", "regime"], "mean_reversion_signals")
    z = F.col("ratio_zscore_30")
    same = lambda other: F.coalesce(F.signum(z) == F.signum(other), F.lit(False))
    raw = F.abs(z) / 3 * F.when(same("ratio_zscore_90"), 1.3).otherwise(0.85) * F.when(same("ratio_slope"), 0.7).otherwise(1.0)
    return df.withColumns({"mr_signal": F.tanh(z * 0.8), "mr_confidence": clip(raw * regime_weight("mean_reversion"), 0, 1)})


def momentum_signals(df: DataFrame) -> DataFrame:
    require_columns(df, ["ratio_ema_slope", "rel_strength_20", "a_macd_hist", "b_ema_slope", "regime"], "momentum_signals")
    w = over_series()
    score = soft_zscore(F.col("ratio_ema_slope"), w) * -0.35 - soft_zscore(F.col("rel_strength_20"), w) * 0.30 - soft_zscore(F.col("a_macd_hist"), w) * 0.20 + soft_zscore(F.col("b_ema_slope"), w) * 0.15
    df = df.withColumn("__score", score)
    return df.withColumns({"mom_signal": F.tanh("__score"), "mom_confidence": clip(F.abs("__score") / 3 * regime_weight("momentum"), 0, 1)}).drop("__score")


def breakout_signals(df: DataFrame) -> DataFrame:
    require_columns(df, ["a_breakout", "b_breakout", "a_vol_5", "a_vol_20", "a_atr_pct", "regime"], "breakout_signals")
    apart = (F.col("b_breakout") - 0.5) * 2.0 - (F.col("a_breakout") - 0.5) * 2.0
    pace = clip(F.col("a_vol_5") / clip(F.col("a_vol_20"), 1e-9), 0.5, 2.5)
    df = df.withColumns({"__raw": F.abs(apart) * pace * clip(F.col("a_atr_pct"), 1e-9), "bo_signal": F.tanh(apart * pace)})
    most = clip(rolling(F.max, F.col("__raw"), 60, over_series(), 10), 1e-9)
    return df.withColumn("bo_confidence", clip(clip(F.col("__raw") / most, 0, 1) * regime_weight("breakout"), 0, 1)).drop("__raw")


def strategy_signals(df: DataFrame) -> DataFrame:
    """STRATEGY: the three signals (-1 to 1) and confidences (0 to 1)."""
    return df.transform(mean_reversion_signals).transform(momentum_signals).transform(breakout_signals)


def available_signals(df: DataFrame, fallback: str = "ratio_zscore_30") -> list[str]:
    found = [c for c in SIGNALS if c in df.columns] or [c for c in [fallback] if c in df.columns]
    if not found:
        raise ValueError(f"none of {SIGNALS} or {fallback} is there")
    return found


def latest(df: DataFrame, n: int = 1) -> DataFrame:
    """The last n rows of each series."""
    back = Window.partitionBy(KEY).orderBy(F.desc(TS))
    return df.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= n).drop("__back")


def sub_signals(df: DataFrame, edge: float = 0.1) -> DataFrame:
    """One row for each series' last bar and strategy: signal, direction, confidence."""
    names = {"mr": "Mean Reversion", "mom": "Momentum", "bo": "Breakout"}
    each = F.array(*[F.struct(F.lit(label).alias("model"), F.col(f"{p}_signal").alias("signal"), F.col(f"{p}_confidence").alias("confidence")) for p, label in names.items() if f"{p}_signal" in df.columns])
    out = latest(df).select(KEY, TS, F.inline(each))
    return out.withColumn("direction", F.when(F.col("signal") > edge, CLASSES[2]).when(F.col("signal") < -edge, CLASSES[0]).otherwise(CLASSES[1]))


def target_labels(df: DataFrame, ahead: int = 5, sigmas: float = 0.30, tail: str = "hold", fit_upto: float | None = None) -> DataFrame:
    """label 0 (a gains), 1 (hold), 2 (b gains) by the ratio's change over the next rows, against a share of its deviation.

    The deviation is over all rows of the series; fit_upto takes only the first such share of them. tail: the last rows,
    without a change ahead, are 'hold' or 'drop' (NULL label).
    """
    w, everything = over_series(), Window.partitionBy(KEY)
    df = df.withColumn("fwd", forward_change(F.col("ratio"), ahead, w))
    known = F.col("fwd") if fit_upto is None else F.when(F.row_number().over(w) + ahead <= F.count("*").over(everything) * fit_upto, F.col("fwd"))
    df = df.withColumn("threshold", F.stddev_samp(known).over(everything) * sigmas)
    label = F.when(F.col("fwd") > F.col("threshold"), 0).when(F.col("fwd") < -F.col("threshold"), 2).otherwise(1)
    return df.withColumn("label", label if tail == "hold" else F.when(F.col("fwd").isNotNull(), label))


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair])
    return df.groupBy(KEY, label).agg(F.count("*").alias("n")).withColumn("class_name", names[F.col(label)])


def accuracy(df: DataFrame, predicted: str = "predicted", label: str = "label") -> DataFrame:
    """Share of right predictions overall (class NULL) and by true class. Rows without a label are left out, classes without rows are not listed."""
    right = F.avg((F.col(predicted) == F.col(label)).cast("double")).alias("accuracy")
    known = df.where(F.col(label).isNotNull() & F.col(KEY).isNotNull())
    return known.rollup(KEY, label).agg(right, F.count("*").alias("n"), F.grouping_id().alias("__set")).where("__set < 2").drop("__set")


def signal_counts(df: DataFrame) -> DataFrame:
    """Rows of each series on which all signals that are there have a value, and those on which each has."""
    found = [c for c in SIGNALS if c in df.columns]
    every = F.lit(True)
    for c in found:
        every = every & F.col(c).isNotNull()
    return df.groupBy(KEY).agg(F.count("*").alias("n_rows"), F.count(F.when(every, 1)).alias("n_all"), *[F.count(c).alias(f"n_{c}") for c in found])


def train_test_split(df: DataFrame, share: float = 0.8) -> DataFrame:
    """is_train: the first share of each series' rows, in time order."""
    return df.withColumn("is_train", F.row_number().over(over_series()) <= F.floor(F.count("*").over(Window.partitionBy(KEY)) * share))
