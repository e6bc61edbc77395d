"""One query for each operator, over the given tables. Times go out as text, whole numbers as long, other numbers rounded."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import KEY, TS, drop_incomplete, over_series, soft_zscore, zscore
from ..operators import backtest as bt
from ..operators import boosting, ensemble, features, garch, regimes, signals
from ..operators.recurrence import ewm_std
from ..operators.scan import Scan, numbered, scan
from ..sources import bars as src
from ..sources.shared import shared_folder, staged
from ..streaming import bars as streams
from .pipeline import Config, analysis, pipeline, write_analysis

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
COSTS = [(0.0, 0.0), (0.0002, 0.0001), (0.001, 0.0005)]
WINDOWS = [(60, 20), (90, 30), (120, 20)]
DECAY = ["alpha_initial", "decay_rate", "alpha_floor", "half_life_windows", "half_life_days"]
IC_SIGNALS = ["mr_signal", "mom_signal", "bo_signal"]


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def day(c: str = TS) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def hour(c: str = TS) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm")


def out(df: DataFrame, *keys, places: int = 6, **columns) -> DataFrame:
    """Keys as they are, doubles rounded, integers as long."""
    kinds = dict(df.dtypes)
    picked = [(F.round(k, places) + 0.0).alias(k) if kinds.get(k) == "double" else F.col(k).cast("long").alias(k) if kinds.get(k) in ("int", "smallint", "tinyint") else F.col(k) for k in keys]
    return df.select(*[v.alias(k) for k, v in columns.items()], *picked)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.bars_from_lineitem(spark, sf_dir)


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rule and the backtest need, complete rows."""
    return drop_incomplete(features.ratio_features(bars(spark, sf_dir)))


def signal_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.strategy_signals(regimes.rule_regime(features.feature_frame(bars(spark, sf_dir))))


@query
def pair_bars(spark, sf_dir):
    return out(bars(spark, sf_dir).transform(features.with_ratio), KEY, "a_close", "b_close", "ratio", day=day())


@query
def lookback_scan(spark, sf_dir):
    return out(src.between(bars(spark, sf_dir), "1996-01-01 00:00:00", "1998-01-01 00:00:00"), KEY, "a_close", "b_close", day=day())


def pair_summary(pairs: DataFrame) -> DataFrame:
    pairs = features.with_ratio(pairs)
    return out(pairs.groupBy(KEY).agg(F.count("*").alias("n_bars"), F.avg("ratio").alias("mean_ratio"), F.stddev_samp("ratio").alias("std_ratio"), F.min(day()).alias("first_day"), F.max(day()).alias("last_day")), KEY, "n_bars", "mean_ratio", "std_ratio", "first_day", "last_day")


@query
def pair_universe(spark, sf_dir):
    return pair_summary(src.pair_universe(src.quotes_from_orders(spark, sf_dir)))


@query
def pair_universe_blocks(spark, sf_dir):
    """The same with instruments in three buckets, each two of them a key."""
    return pair_summary(src.pair_universe(src.quotes_from_orders(spark, sf_dir), 3))


@query
def macro_merge(spark, sf_dir):
    return out(src.macro_from_events(spark, sf_dir), "index", "yield_long", "yield_short", "yield_curve_slope", hour=hour())


@query
def forward_fill_limit(spark, sf_dir):
    e = src.read_table(spark, sf_dir, "events").select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias(TS), "event_type", "value")
    sparse = e.groupBy(TS).agg(F.round(F.max(F.when(F.col("event_type") == "signup", F.col("value"))), 6).alias("x")).withColumns({KEY: F.lit("signup"), "filled": F.col("x")})
    return out(src.filled_forward(sparse, ["filled"], 3), "x", "filled", hour=hour())


@query
def zscore_30_90(spark, sf_dir):
    df, w = features.with_ratio(bars(spark, sf_dir)), over_series()
    return out(df.select(KEY, TS, *[zscore(F.col("ratio"), n, w).alias(f"z{n}") for n in (30, 90)]), KEY, "z30", "z90", day=day())


@query
def roll_z_60(spark, sf_dir):
    return out(features.with_ratio(bars(spark, sf_dir)).withColumn("z60", soft_zscore(F.col("ratio"), over_series())), KEY, "z60", day=day())


@query
def ret_vol_features(spark, sf_dir):
    df = features.volatility_features(features.ratio_features(bars(spark, sf_dir)), conditional=False)
    return out(df, KEY, "ratio_slope", "a_ret_1", "a_ret_5", "a_ret_20", "b_ret_1", "b_ret_5", "b_ret_20", "a_vol_5", "a_vol_20", "a_vol_60", "b_vol_5", "b_vol_20", "b_vol_60", "a_atr_14", "b_atr_14", "a_atr_pct", "b_atr_pct", "vol_ratio", "vol_ratio_5", "vol_ratio_60", places=4, day=day())


@query
def ema_features(spark, sf_dir):
    return out(features.momentum_features(features.ratio_features(bars(spark, sf_dir))), KEY, "a_ema_slope", "b_ema_slope", "ratio_ema_slope", "rel_strength_5", "rel_strength_20", places=4, day=day())


@query
def macd(spark, sf_dir):
    return out(features.momentum_features(features.ratio_features(bars(spark, sf_dir))), KEY, "a_macd", "a_macd_signal", "a_macd_hist", "b_macd", "b_macd_signal", "b_macd_hist", places=4, day=day())


@query
def ewma_vol(spark, sf_dir):
    df = ewm_std(features.with_returns(bars(spark, sf_dir)), {"a_cond_vol": ("a_ret_1", 20), "b_cond_vol": ("b_ret_1", 20)})
    return out(df, KEY, "a_cond_vol", "b_cond_vol", day=day())


@query
def breakout(spark, sf_dir):
    df = bars(spark, sf_dir)
    return out(df.select(KEY, TS, *[features.breakout(F.col(f"{leg}_close")).alias(f"{leg}_breakout") for leg in "ab"]), KEY, "a_breakout", "b_breakout", day=day())


@query
def ratio_band(spark, sf_dir):
    return out(features.ratio_band(features.with_ratio(bars(spark, sf_dir))), KEY, "ratio", "band_mid", "band_low", "band_high", day=day())


@query
def halo_zscore(spark, sf_dir):
    """The 90-row score through blocks of 256 rows with copied edges."""
    df = features.blockwise(features.with_ratio(bars(spark, sf_dir)), lambda rows, w: rows.withColumns({"z90": zscore(F.col("ratio"), 90, w), "at": F.col("bar_idx")}), 89, 256)
    return out(df, KEY, "z90", bar_idx=F.col("at"), day=day())


@query
def long_series(spark, sf_dir):
    """All features through blocks of a thousand rows, for series too long for one task."""
    df = features.long_series_features(bars(spark, sf_dir), 1000)
    return out(df, KEY, "ratio_zscore_30", "ratio_zscore_90", "ratio_ema_slope", "a_macd_hist", "a_vol_60", "b_atr_pct", places=4, day=day())


@query
def feature_frame(spark, sf_dir):
    """Complete rows with all features, and how many the staged form leaves."""
    b = bars(spark, sf_dir)
    count = lambda df, name: df.groupBy(KEY).agg(F.count("*").alias(name), F.min(day()).alias(f"{name}_from"))
    return out(count(features.feature_frame(b), "n_single").join(count(features.feature_frame(b, staged=True), "n_staged"), KEY), KEY, "n_single", "n_single_from", "n_staged", "n_staged_from")


@query
def rule_signal(spark, sf_dir):
    return out(frame(spark, sf_dir).withColumn("signal", signals.rule_signal()), KEY, "signal", "ratio_zscore_30", "ratio_slope", day=day())


@query
def position_size(spark, sf_dir):
    return out(frame(spark, sf_dir).withColumn("size", signals.position_size(signals.rule_signal())), KEY, "size", day=day())


@query
def backtest_curve(spark, sf_dir):
    return out(bt.drawdowns(bt.run_folds(frame(spark, sf_dir))), KEY, "signal", "switched", "daily_return", "capital", "drawdown", day=day())


@query
def long_backtest(spark, sf_dir):
    """backtest_curve for series too long for one task: blocks of 250 bars, capital and peak by scans over blocks."""
    df = bt.trade(frame(spark, sf_dir), block_rows=250).where("bar_no >= 1")
    return out(df, KEY, "signal", "switched", "daily_return", "capital", "drawdown", day=day())


@query
def long_averages(spark, sf_dir):
    """Moving averages of spans 10 to 199 (decays to 0.99) over blocks of 300 bars, with nothing forgotten between them."""
    rows = numbered(features.with_ratio(bars(spark, sf_dir)), block_rows=300)
    spans, x = {"ema_10": 10, "ema_99": 99, "ema_199": 199}, F.col("ratio")
    # a scan starts from 0, an average from its first value
    rows = rows.withColumns({f"in_{n}": F.when(F.col("bar_idx") == 0, x).otherwise(x * (2 / (span + 1))) for n, span in spans.items()})
    return out(scan(rows, [Scan(n, "affine", f"in_{n}", 1 - 2 / (span + 1)) for n, span in spans.items()]), KEY, *spans, places=4, day=day())


@query
def long_walk_forward(spark, sf_dir):
    """wf_rolling's metrics and the anchored folds, with bars numbered and folds traded in blocks of 150 bars."""
    df = frame(spark, sf_dir)
    rolling, anchored = bt.walk_forward_rolling(df, block_rows=150), bt.walk_forward_anchored(df, block_rows=150)
    pick = lambda d, kind, number, *more: d.select(KEY, F.lit(kind).alias("kind"), F.col(number).cast("long").alias("number"), "first_ts", "last_ts", "n_bars", *bt.METRICS, *more)
    both = pick(rolling, "rolling", "window_idx", "ic_composite").union(pick(anchored, "anchored", "fold", F.lit(None).cast("double")))
    return out(both, KEY, "kind", "number", "n_bars", *bt.METRICS, "ic_composite", first_day=day("first_ts"), last_day=day("last_ts"))


@query
def backtest_columns(spark, sf_dir):
    return out(bt.backtest(frame(spark, sf_dir)), KEY, "ratio", "capital", "daily_return", day=day())


@query
def backtest_metrics(spark, sf_dir):
    return out(bt.metrics(bt.run_folds(frame(spark, sf_dir))), KEY, *bt.METRICS, "final_capital", "total_return", "n_turns")


@query
def cost_sweep(spark, sf_dir):
    return out(bt.cost_sweep(frame(spark, sf_dir), COSTS), KEY, "spread", "slippage", *bt.METRICS, "final_capital", "n_turns")


@query
def window_sweep(spark, sf_dir):
    return out(bt.window_sweep(frame(spark, sf_dir), WINDOWS), KEY, "window", "step", "n_windows", *bt.METRICS, places=5)


@query
def given_returns(spark, sf_dir):
    """Metrics of the ratio's daily change as a return, with a cost wherever the rule's side changes."""
    df, w = frame(spark, sf_dir).withColumn("signal", signals.rule_signal()), over_series()
    df = df.select(KEY, TS, (F.col("ratio") / F.lag("ratio").over(w) - 1).alias("gain"), F.coalesce(F.col("signal") != F.lag("signal").over(w), F.lit(False)).cast("int").alias("changed"))
    return out(bt.compute_metrics(df, column="gain", changes="changed"), KEY, *bt.METRICS, "final_capital", "n_turns")


@query
def anchored_curve(spark, sf_dir):
    return out(bt.anchored_curve(frame(spark, sf_dir)), KEY, "fold", "daily_return", "capital", day=day())


@query
def wf_anchored(spark, sf_dir):
    df = bt.walk_forward_anchored(frame(spark, sf_dir))
    return out(df, KEY, "fold", "n_bars", *bt.METRICS, first_day=day("first_ts"), last_day=day("last_ts"))


@query
def wf_anchored_means(spark, sf_dir):
    return out(bt.fold_means(bt.walk_forward_anchored(frame(spark, sf_dir))), KEY, "n_folds", *bt.METRICS)


@query
def wf_rolling(spark, sf_dir):
    df = bt.walk_forward_rolling(signal_frame(spark, sf_dir))
    return out(df, KEY, "window_idx", "n_bars", *bt.METRICS, *[f"ic_{s}" for s in IC_SIGNALS], "ic_composite", first_day=day("first_ts"), last_day=day("last_ts"))


@query
def wf_summary(spark, sf_dir):
    return out(bt.summary(bt.walk_forward_rolling(frame(spark, sf_dir))), KEY, "metric", "mean", "std", "min", "max", "pct_positive_windows", places=3)


@query
def ic_by_window(spark, sf_dir):
    df = frame(spark, sf_dir).withColumn("fwd", signals.forward_change(F.col("ratio"), 5, over_series()))
    return out(bt.information_coefficients(bt.rolling_windows(df), ["ratio_zscore_30", "ratio_slope"]), KEY, "window_idx", "ic_ratio_zscore_30", "ic_ratio_slope", "ic_composite")


@query
def ic_stats(spark, sf_dir):
    return out(bt.ic_statistics(bt.walk_forward_rolling(frame(spark, sf_dir))), KEY, "ic_mean", "ic_std", "ic_min", "ic_max", "mean_sharpe", "mean_hit_rate", "n_windows", places=5)


@query
def alpha_decay(spark, sf_dir):
    return out(bt.alpha_curve(bt.walk_forward_rolling(frame(spark, sf_dir))), KEY, "window_idx", "ic_composite", "normalized_alpha", "sharpe", "hit_rate", places=5)


@query
def decay_fit(spark, sf_dir):
    return out(bt.fit_decay(bt.walk_forward_rolling(frame(spark, sf_dir))), KEY, *DECAY, "sse", "fit_success", places=4)


@query
def strategy_signals(spark, sf_dir):
    return out(signal_frame(spark, sf_dir), KEY, "regime", *signals.STRATEGY, day=day())


@query
def signal_counts(spark, sf_dir):
    return out(signals.signal_counts(signal_frame(spark, sf_dir)), KEY, "n_rows", "n_all", *[f"n_{s}" for s in IC_SIGNALS])


@query
def sub_signal_latest(spark, sf_dir):
    return out(signals.sub_signals(signal_frame(spark, sf_dir)), KEY, "model", "signal", "direction", "confidence", day=day())


@query
def latest_rows(spark, sf_dir):
    return out(signals.latest(frame(spark, sf_dir), 5), KEY, "ratio", "ratio_zscore_30", day=day())


@query
def target_labels(spark, sf_dir):
    return out(signals.target_labels(frame(spark, sf_dir)), KEY, "fwd", "threshold", "label", day=day())


@query
def class_distribution(spark, sf_dir):
    return out(signals.class_distribution(signals.target_labels(frame(spark, sf_dir))), KEY, "label", "n", "class_name")


def rule_prediction(df: DataFrame) -> DataFrame:
    return signals.target_labels(df).withColumn("predicted", F.when(F.col("ratio_zscore_30") > 1, 2).when(F.col("ratio_zscore_30") < -1, 0).otherwise(1))


@query
def accuracy_by_class(spark, sf_dir):
    """Of a rule prediction on the last fifth of each series."""
    df = signals.train_test_split(rule_prediction(frame(spark, sf_dir))).where("not is_train")
    return out(signals.accuracy(df), KEY, "label", "accuracy", "n")


@query
def train_test_split(spark, sf_dir):
    df = signals.train_test_split(frame(spark, sf_dir))
    return out(df.groupBy(KEY, "is_train").agg(F.count("*").alias("n"), F.min(day()).alias("first_day"), F.max(day()).alias("last_day")), KEY, "is_train", "n", "first_day", "last_day")


@query
def regime_stats(spark, sf_dir):
    return out(regimes.regime_statistics(regimes.rule_regime(features.ratio_features(bars(spark, sf_dir)))), KEY, "regime", "days", "share", "mean_ratio", "mean_vol")


@query
def regime_share(spark, sf_dir):
    return out(regimes.regime_shares(regimes.rule_regime(features.ratio_features(bars(spark, sf_dir)))), KEY, *[f"share_{r}" for r in regimes.REGIMES], day=day())


@query
def regime_transitions(spark, sf_dir):
    return out(regimes.regime_transitions(regimes.rule_regime(features.ratio_features(bars(spark, sf_dir)))), KEY, "from_regime", "to_regime", "n", "probability")


@query
def missing_regimes(spark, sf_dir):
    """Rows before the first score have no regime: weight 1, and the code of a quiet market."""
    df = regimes.rule_regime(features.ratio_features(bars(spark, sf_dir)))
    return out(df.withColumns({"weight": signals.regime_weight("momentum"), "code": regimes.encoded()}), KEY, "regime", "weight", "code", day=day())


@query
def regime_bands(spark, sf_dir):
    df = regimes.regime_bands(regimes.rule_regime(features.ratio_features(bars(spark, sf_dir))))
    return out(df, KEY, "regime", "n_bars", start_day=day("band_start"), end_day=day("band_end"))


def plain_contributions(df: DataFrame) -> DataFrame:
    """Given columns in place of attributions."""
    return df.select(KEY, TS, *[F.col(c).alias(f"shap_{c}") for c in ("ratio_zscore_30", "ratio_zscore_90", "ratio_slope", "a_ret_5", "b_ret_5", "a_vol_20", "vol_ratio")])


@query
def top_columns(spark, sf_dir):
    """Mean absolute values of given columns; ``top_features`` is the same of attributions."""
    return out(ensemble.top_features(plain_contributions(frame(spark, sf_dir)), 5), "feature", "importance")


@query
def latest_columns(spark, sf_dir):
    return out(ensemble.latest_contributions(plain_contributions(frame(spark, sf_dir)), 4), KEY, "feature", "value", "place")


def predictions(spark: SparkSession, sf_dir: str, attribute: bool = True) -> DataFrame:
    df = staged(signal_frame(spark, sf_dir), "signals")
    return ensemble.predict(df, ensemble.fit(df), attribute).where("predicted is not null")


@query
def top_features(spark, sf_dir):
    return out(ensemble.top_features(predictions(spark, sf_dir)), "feature", "importance")


@query
def latest_top_contributions(spark, sf_dir):
    return out(ensemble.latest_contributions(predictions(spark, sf_dir)), KEY, "feature", "value", "place")


@query
def versioned_stages(spark, sf_dir):
    """A stage reads what the one before wrote and writes a version of its own, more columns in each."""
    path = shared_folder(spark, "stages")
    src.write_stage(bars(spark, sf_dir), f"{path}/v0", partition_by=None)
    src.write_stage(features.with_ratio(src.read_first_available(spark, [f"{path}/v1", f"{path}/v0"])), f"{path}/v1", partition_by=None)
    both = src.read_first_available(spark, [f"{path}/v1", f"{path}/v0"])
    return out(both.withColumn("slope", F.col("ratio") - F.lag("ratio", 5).over(over_series())), KEY, "ratio", "slope", day=day())


@query
def stream_latest(spark, sf_dir):
    """The latest bar of each series, kept by merging one batch after the other."""
    path, folder = shared_folder(spark, "bars"), shared_folder(spark, "latest")
    src.write_stage(bars(spark, sf_dir).repartitionByRange(3, TS), path, partition_by=None)
    stream = spark.readStream.schema(src.BARS).option("maxFilesPerTrigger", 1).parquet(path)
    streams.upsert_latest(stream, folder).awaitTermination()
    return out(streams.latest_version(spark, folder, src.BARS), KEY, "a_close", "b_close", day=day())


@query
def csv_stage(spark, sf_dir):
    """Bars written as CSV and read again by schema, from the first path of a list that is there."""
    path = shared_folder(spark, "bars-csv")
    src.write_stage(bars(spark, sf_dir).withColumn(TS, F.date_format(TS, "yyyy-MM-dd HH:mm:ss")), path, "csv", partition_by=None)
    return out(src.read_first_available(spark, [path + "-enriched", path], src.BARS, "csv"), KEY, "a_close", "b_close", day=day())


@query
def gmm_regimes(spark, sf_dir):
    df = regimes.fit_and_label(features.feature_frame(bars(spark, sf_dir)), model="gmm")
    return out(df, KEY, "regime_state", "regime", day=day())


@query
def hmm_regimes(spark, sf_dir):
    df = regimes.fit_and_label(features.feature_frame(bars(spark, sf_dir)), model="hmm")
    return out(df, KEY, "regime_state", "regime", day=day())


@query
def hmm_holds(spark, sf_dir):
    """What labels must hold: every complete row has one, a state has one name, and the crisis is not the calmest state."""
    df = regimes.fit_and_label(features.feature_frame(bars(spark, sf_dir)), model="hmm")
    per_state = df.groupBy("regime_state").agg(F.count_distinct("regime").alias("names"), F.avg("a_atr_pct").alias("vol"), F.first("regime").alias("name"))
    whole = per_state.agg((F.max("names") == 1).alias("one_name"), (F.max_by("name", -F.col("vol")) != "crisis").alias("crisis_moves"), (F.count("*") <= 4).alias("few_states"))
    n = df.groupBy(KEY).agg(F.count("regime").alias("n_labelled"))
    return out(n.join(F.broadcast(whole)), KEY, "n_labelled", "one_name", "crisis_moves", "few_states")


@query
def hmm_tables(spark, sf_dir):
    """State means and move probabilities of a model that saw the first four fifths of each series."""
    df = staged(features.feature_frame(bars(spark, sf_dir)), "features")
    means, moves = regimes.model_tables(spark, regimes.hmm_fit(regimes.fit_rows(df, 0.8)))
    named = moves.select(F.lit("move").alias("kind"), F.col("from_regime").alias("regime"), F.concat_ws(":", "to_state", "to_regime").alias("name"), F.col("probability").alias("value"))
    return out(named.union(means.select(F.lit("mean"), "regime", "feature", "mean")), "kind", "regime", "name", "value")


#: A two-state model that SQL can follow: start, move, centres and covariances over two features.
FIXED_HMM = {"start": [0.6, 0.4], "move": [[0.9, 0.1], [0.2, 0.8]], "centre": [[-1.0, -0.5], [1.0, 0.5]], "covariance": [[[1.0, 0.3], [0.3, 1.0]], [[0.8, -0.1], [-0.1, 1.2]]]}
HMM_FEATURES = ["ratio_zscore_30", "ratio_zscore_90"]


def fixed_hmm() -> regimes.HiddenMarkov:
    return regimes.HiddenMarkov(HMM_FEATURES, np.zeros(2), np.ones(2), **{k: np.array(v) for k, v in FIXED_HMM.items()})


@query
def hmm_round(spark, sf_dir):
    """One round of Baum-Welch from a fixed model, over blocks of 500 rows: the log likelihood, and the parameters it leads to."""
    m = regimes.hmm_fit(frame(spark, sf_dir), initial=[fixed_hmm()], max_iter=1, block_rows=500)
    rows = [("log_likelihood", 0, 0, 0, m.log_likelihood), *[("start", i, 0, 0, m.start[i]) for i in range(2)], *[("move", i, j, 0, m.move[i, j]) for i in range(2) for j in range(2)]]
    rows += [("centre", i, a, 0, m.centre[i, a]) for i in range(2) for a in range(2)] + [("covariance", i, a, b, m.covariance[i, a, b]) for i in range(2) for a in range(2) for b in range(a, 2)]
    return out(spark.createDataFrame([(*r[:4], float(r[4])) for r in rows], "name string, i long, j long, k long, value double"), "name", "i", "j", "k", "value", places=5)


@query
def hmm_path(spark, sf_dir):
    """The likeliest states under the fixed model, over blocks of 500 rows."""
    return out(regimes.hmm_states(frame(spark, sf_dir), fixed_hmm(), block_rows=500), KEY, "regime_state", day=day())


@query
def boosted_stumps(spark, sf_dir):
    """One round of joint boosting by single splits (quarter borders, all rows and columns) on rule labels, and each row's class and confidence."""
    df, names = signals.target_labels(frame(spark, sf_dir)), ["ratio_zscore_30", "ratio_slope", "a_ret_5", "b_ret_5"]
    model = boosting.fit(df, names, rounds=1, depth=1, rate=0.5, row_share=1.0, column_share=1.0, bins=4, error=0.0)
    got = ensemble.predict(df, model, attribute=False)
    return out(got, KEY, "label", "predicted", "ensemble_confidence", "margin", "base", day=day())


@query
def garch_vol(spark, sf_dir):
    df = garch.with_garch(features.with_returns(bars(spark, sf_dir)))
    return out(df, KEY, "a_garch_vol", "b_garch_vol", "garch_vol_ratio", day=day())


@query
def garch_coarse(spark, sf_dir):
    """The likeliest candidate of the coarse grid for each leg."""
    rows = staged(garch.centred(features.with_returns(bars(spark, sf_dir)), ["a_ret_1", "b_ret_1"]), "returns")
    return out(garch.fit_legs(rows, 0), KEY, "leg", "alpha", "beta", "ll", places=4)


@query
def garch_fitted(spark, sf_dir):
    """The likeliest candidate of each leg after two finer grids."""
    rows = staged(garch.centred(features.with_returns(bars(spark, sf_dir)), ["a_ret_1", "b_ret_1"]), "returns")
    fits = garch.fit_legs(rows)
    return fits.select(KEY, "leg", *[F.round(c, n).alias(c) for c, n in (("alpha", 5), ("beta", 5), ("ll", 3))])


@query
def garch_likelihood(spark, sf_dir):
    """The likelihood over mean, omega, alpha and beta, from the finer grids on."""
    rows = staged(garch.centred(features.with_returns(bars(spark, sf_dir)), ["a_ret_1", "b_ret_1"]), "returns")
    return out(garch.likelihood_fit(rows), KEY, "leg", "shift", "omega", "alpha", "beta", "ll", places=4)


@query
def garch_gain(spark, sf_dir):
    """What the fit must hold for each series: parameters in range, no candidate of the coarse grid likelier, the variances' start at the mean square."""
    rows = staged(garch.centred(features.with_returns(bars(spark, sf_dir)), ["a_ret_1", "b_ret_1"]), "returns")
    best, coarse = garch.fit_legs(rows), garch.fit_legs(rows, 0).select(KEY, "leg", F.col("ll").alias("ll0"))
    sure = (F.col("ll") >= F.col("ll0") - 1e-9) & (F.col("alpha") > 0) & (F.col("beta") > 0) & (F.col("alpha") + F.col("beta") < 1)
    return out(best.join(coarse, [KEY, "leg"]).withColumn("holds", sure), KEY, "leg", "target", "holds")


@query
def ensemble_predict(spark, sf_dir):
    return out(predictions(spark, sf_dir, attribute=False), KEY, "predicted", "ensemble_signal", "ensemble_confidence", day=day())


@query
def shap_values(spark, sf_dir):
    return out(predictions(spark, sf_dir), KEY, "predicted", "margin", "base", *[f"shap_{f}" for f in ensemble.FEATURES], day=day())


@query
def shap_sums(spark, sf_dir):
    """What attributions must hold on each row: with the base they sum to the margin, and the confidence is that of the largest of three classes."""
    df = predictions(spark, sf_dir)
    total = F.col("base")
    for f in ensemble.FEATURES:
        total = total + F.col(f"shap_{f}")
    df = df.select(KEY, TS, (F.abs(total - F.col("margin")) < 1e-9).alias("adds_up"), (F.col("ensemble_confidence").between(1 / 3 - 1e-9, 1) & F.col("predicted").isin(0, 1, 2)).alias("in_range"))
    return out(df, KEY, "adds_up", "in_range", day=day())


@query
def whole_pipeline(spark, sf_dir):
    """Bars to metrics with rule regimes and exponentially weighted volatility."""
    return out(pipeline(bars(spark, sf_dir), Config(regime_model="rule"))[1], KEY, *bt.METRICS, "final_capital", "n_turns")


@query
def whole_pipeline_models(spark, sf_dir):
    """The same with hidden Markov regimes, GARCH volatility and the ensemble at their classic sizes; the rule's metrics do not depend on them, the frame does."""
    df, metrics = pipeline(bars(spark, sf_dir), Config(regime_model="hmm", vol_model="garch", ensemble_trees=300))
    got = df.groupBy(KEY).agg(F.count("regime").alias("n_regimes"), F.count("daily_return").alias("n_returns"), (F.count("ensemble_signal") > 0).alias("predicted"))
    return out(metrics.join(got, KEY), KEY, *bt.METRICS, "final_capital", "n_turns", "n_regimes", "n_returns", "predicted")


@query
def whole_analysis(spark, sf_dir):
    """All results of the analysis written as stages and read again; the decay fit beside the rows of each."""
    results, folder = analysis(frame(spark, sf_dir)), shared_folder(spark, "analysis")
    write_analysis(results, folder)
    stages = {name: spark.read.parquet(f"{folder}/{name}") for name in results}
    got = stages["decay_fit"]
    for name in ("folds", "decay_curve", "summary", "anchored", "anchored_curve"):
        got = got.join(stages[name].groupBy(KEY).agg(F.count("*").alias(f"n_{name}")), KEY)
    return out(got, KEY, *DECAY, "fit_success", *[f"n_{n}" for n in ("folds", "decay_curve", "summary", "anchored", "anchored_curve")], places=4)


@query
def stream_bars(spark, sf_dir):
    got = streams.run_available(streams.stream_bars(streams.event_stream(spark, f"{sf_dir}/events*.parquet"), "click", "view"), "bars")
    return out(got, KEY, "a_close", "b_close", hour=hour())


@query
def stream_features(spark, sf_dir):
    """Features with state over a stream of daily bars that were written as files."""
    path = shared_folder(spark, "bars")
    src.write_stage(bars(spark, sf_dir), path, partition_by=None)
    stream = spark.readStream.schema(src.BARS).parquet(path)
    got = streams.run_available(streams.incremental_features(stream), "features")
    return out(got, KEY, "ratio", "ema_slope", "zscore_30", "zscore_90", "signal", day=day())


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
