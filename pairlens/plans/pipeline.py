"""The whole chain from bars to metrics, and the walk-forward analysis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.columns import KEY, TS, drop_incomplete
from ..operators import backtest, ensemble, features, garch, regimes, signals
from ..sources.bars import write_stage
from ..sources.shared import staged


@dataclass(frozen=True)
class Config:
    spread: float = 0.0002
    slippage: float = 0.0001
    regime_model: str = "none"  # none, rule, gmm, hmm
    vol_model: str = "ewma"  # ewma, garch (variance targeting on grids), garch_ml (likelihood over all parameters)
    fit_upto: float | None = None  # share of each series' rows that models and thresholds may look at; None: all
    ensemble_trees: int = 0  # 0: no ensemble; 300 in the classic form
    window: int = 60
    step: int = 20
    purge: int = 5
    stride_days: float | None = None  # days between windows for half-lives; None: the step alone, as in the classic form
    n_splits: int = 5
    anchored_purge: int = 20


def signal_frame(bars: DataFrame, config: Config = Config()) -> DataFrame:
    """Features, regimes and strategy signals of complete rows. Conditional volatility is fitted to all returns, before incomplete rows go."""
    if config.vol_model in ("garch", "garch_ml"):
        # several models look at what follows: computed once
        df = staged(garch_features(bars, steps=8 if config.vol_model == "garch_ml" else 0), "features")
    else:
        df = features.feature_frame(bars)
    df = regimes.rule_regime(df) if config.regime_model == "rule" else regimes.fit_and_label(df, model=config.regime_model, fit_upto=config.fit_upto)
    return signals.strategy_signals(df)


def garch_features(bars: DataFrame, steps: int = 0) -> DataFrame:
    """feature_frame with GARCH volatility in the place of the weighted one, which is kept as *_ewm_vol."""
    df = garch.with_garch(features.all_features(bars), steps=steps)
    df = df.withColumnsRenamed({"a_cond_vol": "a_ewm_vol", "b_cond_vol": "b_ewm_vol", "cond_vol_ratio": "ewm_vol_ratio"})
    return drop_incomplete(df.withColumnsRenamed({"a_garch_vol": "a_cond_vol", "b_garch_vol": "b_cond_vol", "garch_vol_ratio": "cond_vol_ratio"}))


def pipeline(bars: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(frame with predictions and the backtest's columns, metrics of each series)."""
    df = signal_frame(bars, config)
    if config.ensemble_trees:
        df = ensemble.fit_and_predict(df, n_trees=config.ensemble_trees, fit_upto=config.fit_upto)
    costs = {"spread": config.spread, "slippage": config.slippage}
    if config.regime_model in ("gmm", "hmm") or config.ensemble_trees:
        df = staged(df, "predicted")  # models are not run again for the second result
    return backtest.backtest(df, **costs), backtest.metrics(backtest.run_folds(df, **costs))


def analysis(df: DataFrame, config: Config = Config()) -> dict[str, DataFrame]:
    """Rolling windows, written once, and what follows from them (curve, fit, statistics, summary), and the anchored folds with their curve."""
    costs = {"spread": config.spread, "slippage": config.slippage}
    folds = staged(backtest.walk_forward_rolling(df, config.window, config.step, config.purge, **costs), "folds")
    if folds.isEmpty():
        raise ValueError("no window fits: make the window or the step smaller")
    return {
        "folds": folds,
        "decay_curve": backtest.alpha_curve(folds),
        "decay_fit": backtest.fit_decay(folds, step_days=config.step, stride_days=config.stride_days),
        "ic_statistics": backtest.ic_statistics(folds),
        "summary": backtest.summary(folds),
        "anchored": backtest.walk_forward_anchored(df, config.n_splits, config.anchored_purge, **costs),
        "anchored_curve": backtest.anchored_curve(df, config.n_splits, config.anchored_purge, **costs).select(KEY, "fold", TS, "capital", "daily_return"),
    }


def write_analysis(results: dict[str, DataFrame], folder: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Each result of the analysis as a stage of its own below folder."""
    for name, df in results.items():
        write_stage(df, f"{folder}/{name}", fmt, partition_by=None, mode=mode)
