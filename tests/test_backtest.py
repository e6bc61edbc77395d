import datetime as dt

import numpy as np
import pandas as pd
import pytest
from panels import panel, sequential_backtest
from pyspark.sql import functions as F

from pairlens.operators import backtest as bt
from pairlens.operators import features as f
from pairlens.operators import signals as s


@pytest.fixture(scope="module")
def frame(spark):
    df = f.feature_frame(spark.createDataFrame(panel(300, ("x", "y")))).persist()
    yield df
    df.unpersist()


def test_lag_form_equals_trading_row_by_row(frame):
    out = bt.run_folds(frame).orderBy("series_id", "ts").toPandas()
    for key, part in frame.orderBy("series_id", "ts").toPandas().groupby("series_id"):
        want, mine = sequential_backtest(part), out[out.series_id == key]
        np.testing.assert_allclose(mine.capital, want.capital, rtol=1e-12)
        np.testing.assert_array_equal(mine.switched, want.switched)


def test_metrics(frame):
    got = bt.metrics(bt.run_folds(frame)).orderBy("series_id").toPandas().iloc[0]
    want = sequential_backtest(frame.where("series_id = 'x'").orderBy("ts").toPandas())
    r, c = want.daily_return, want.capital
    assert got.sharpe == pytest.approx(r.mean() / r.std() * np.sqrt(252), abs=1e-4)
    assert got.cagr == pytest.approx((c.iloc[-1] / c.iloc[0]) ** (252 / len(c)) - 1, abs=1e-4)
    assert got.max_drawdown == pytest.approx((c / c.cummax() - 1).min(), abs=1e-4)
    assert got.hit_rate == pytest.approx((r[r != 0] > 0).mean(), abs=1e-4)
    assert got.n_turns == want.switched.sum() and got.max_drawdown <= 0


def test_anchored_folds_stop_at_the_end(spark):
    p = pd.DataFrame({"series_id": "s", "ts": pd.date_range("2020-01-01", periods=415), "a_close": 1.0, "b_close": 1.0})
    folds = bt.anchored_folds(spark.createDataFrame(p)).groupBy("fold").agg(F.min("bar_idx").alias("lo"), F.count("*").alias("n")).orderBy("fold").collect()
    assert [(r.fold, r.lo, r.n) for r in folds] == [(k, k * 69 + 20, 69) for k in (1, 2, 3, 4)]


def test_rolling_windows_equal_the_loop(spark):
    p = pd.DataFrame({"series_id": "s", "ts": pd.date_range("2020-01-01", periods=415), "a_close": 1.0, "b_close": 1.0})
    got = bt.rolling_windows(spark.createDataFrame(p)).groupBy("window_idx").agg(F.min("bar_idx").alias("lo"), F.max("bar_idx").alias("hi"), F.count("*").alias("n")).orderBy("window_idx").collect()
    assert [(r.lo, r.hi, r.n) for r in got] == [(25 * k, 25 * k + 59, 60) for k in range(15)]
    assert bt.rolling_windows(spark.createDataFrame(p.head(59))).count() == 0


def test_rank_correlation_equals_pandas(frame):
    df = frame.withColumn("fwd", s.forward_change(F.col("ratio"), 5, bt.over_series()))
    got = bt.information_coefficients(bt.rolling_windows(df), ["ratio_zscore_30"]).where("series_id = 'x'").orderBy("window_idx").toPandas()
    p = df.where("series_id = 'x'").orderBy("ts").toPandas()
    for r in got.itertuples():
        part = p.iloc[25 * r.window_idx : 25 * r.window_idx + 60].dropna(subset=["fwd"])
        assert r.ic_ratio_zscore_30 == pytest.approx(part.ratio_zscore_30.rank().corr((-part.fwd).rank()), abs=1e-6)


def test_planted_decay_is_found(spark):
    rng = np.random.default_rng(5)
    rows = [("s", k, float(0.6 * np.exp(-0.25 * k) + 0.1 + rng.normal(0, 0.01))) for k in range(15)] + [("short", k, 0.1) for k in range(3)]
    got = bt.fit_decay(spark.createDataFrame(rows, "series_id string, window_idx int, ic_composite double")).toPandas().set_index("series_id")
    assert got.alpha_initial["s"] == pytest.approx(0.7, abs=0.06) and got.decay_rate["s"] == pytest.approx(0.25, abs=0.05) and got.alpha_floor["s"] == pytest.approx(0.1, abs=0.04)
    assert not got.fit_success["short"] and np.isnan(got.alpha_initial["short"])


def test_decay_by_hand(spark):
    """Without noise: 0.6 exp(-k / 4) + 0.1 starts at 0.7 and halves in 4 ln 2 = 2.77 windows; a constant does not decay; a rising curve falls towards its end."""
    rows = [("clean", k, float(0.6 * np.exp(-0.25 * k) + 0.1)) for k in range(15)] + [("flat", k, 0.25) for k in range(6)] + [("gap", k, None if k == 3 else float(-0.5 * np.exp(-0.4 * k) + 0.3)) for k in range(12)]
    df = spark.createDataFrame(rows, "series_id string, window_idx int, ic_composite double")
    got = bt.fit_decay(df).toPandas().set_index("series_id")
    assert got.loc["clean", ["alpha_initial", "alpha_floor", "decay_rate"]].tolist() == pytest.approx([0.7, 0.1, 0.25], abs=2e-4)
    assert got.half_life_windows["clean"] == pytest.approx(2.77, abs=0.011) and got.half_life_days["clean"] == pytest.approx(55.5, abs=0.15)
    assert got.loc["flat", ["alpha_initial", "alpha_floor", "decay_rate"]].tolist() == [0.25, 0.25, 0.0] and np.isinf(got.half_life_windows["flat"]) and np.isinf(got.half_life_days["flat"]) and got.fit_success["flat"]
    assert got.loc["gap", ["alpha_initial", "alpha_floor", "decay_rate"]].tolist() == pytest.approx([-0.2, 0.3, 0.4], abs=1e-3)
    true_days = bt.fit_decay(df, stride_days=25).toPandas().set_index("series_id").half_life_days["clean"]
    assert true_days == pytest.approx(69.3, abs=0.2)


def test_backtest_keeps_the_first_row(frame):
    out = bt.backtest(frame)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and out.where("daily_return is null and capital is null").count() == 2 and out.count() == frame.count()


def test_metrics_of_given_returns(frame):
    traded = bt.run_folds(frame, spread=0.0, slippage=0.0)
    by_hand = bt.metrics(bt.run_folds(frame)).orderBy("series_id").collect()
    paid = bt.compute_metrics(traded.select("series_id", "ts", "daily_return", "switched"), changes="switched").orderBy("series_id").collect()
    assert [r.asDict() for r in paid] == [pytest.approx(r.asDict()) for r in by_hand]
    free = bt.compute_metrics(traded.select("series_id", "ts", "daily_return")).first()
    assert free.n_turns == 0 and free.final_capital > paid[0].final_capital


def test_anchored_curve_and_sweep(frame):
    curve = bt.anchored_curve(frame)
    folds = {(r.series_id, r.fold): r.n_bars for r in bt.walk_forward_anchored(frame).collect()}
    assert {(r.series_id, r.fold): r.n for r in curve.groupBy("series_id", "fold").agg(F.count("*").alias("n")).collect()} == {k: n - 1 for k, n in folds.items()}
    swept = {(r.series_id, r.window, r.step): r for r in bt.window_sweep(frame, [(60, 20), (100, 10)]).collect()}
    one = bt.metrics(bt.run_folds(bt.rolling_windows(frame, 100, 10), ["window_idx"]), ["window_idx"]).where("series_id = 'x'").toPandas()
    assert swept["x", 100, 10].n_windows == len(one) and swept["x", 100, 10].sharpe == pytest.approx(one.sharpe.mean())


def test_accuracy_leaves_out_rows_without_a_label(spark):
    df = spark.createDataFrame([("s", 0, 0), ("s", 0, 1), ("s", None, 1), ("s", 2, 2)], "series_id string, label int, predicted int")
    got = {(r.series_id, r.label): (r.accuracy, r.n) for r in s.accuracy(df).collect()}
    assert got == {("s", None): (pytest.approx(2 / 3), 3), ("s", 0): (0.5, 2), ("s", 2): (1.0, 1)}


def test_counts_of_signals(spark):
    df = spark.createDataFrame([("s", 0.1, None, 0.2), ("s", 0.1, 0.3, 0.2)], "series_id string, mr_signal double, mom_signal double, bo_signal double")
    assert s.signal_counts(df).first().asDict() == {"series_id": "s", "n_rows": 2, "n_all": 1, "n_mr_signal": 2, "n_mom_signal": 1, "n_bo_signal": 2}


def test_signals_stay_in_range(frame):
    df = s.strategy_signals(frame.withColumn("regime", F.lit("trending"))).toPandas()
    for p in ("mr", "mom", "bo"):
        assert df[f"{p}_signal"].dropna().between(-1, 1).all() and df[f"{p}_confidence"].dropna().between(0, 1).all()
    assert df.mom_signal.isna().sum() == 2 * 29 and df.bo_confidence.isna().sum() == 2 * 9


def test_missing_scores_fall_through(spark):
    rows = [(None, None), (None, 0.4), (2.0, None), (2.0, 0.1), (-2.0, 0.1), (-2.0, 0.9)]
    df = spark.createDataFrame(rows, "ratio_zscore_30 double, ratio_slope double")
    assert [r[0] for r in df.select(s.rule_signal()).collect()] == ["b", "a", "b", "b", "a", "a"]


def test_labels(spark):
    p = panel(100)
    df = f.with_ratio(spark.createDataFrame(p))
    hold, drop = (s.target_labels(df, tail=t).orderBy("ts").toPandas() for t in ("hold", "drop"))
    r = p.a_close / p.b_close
    fwd = r.shift(-5) / r - 1
    want = np.where(fwd > fwd.std() * 0.3, 0, np.where(fwd < -fwd.std() * 0.3, 2, 1))
    np.testing.assert_array_equal(hold.label, want)
    assert drop.label.isna().sum() == 5 and (hold.label.tail(5) == 1).all()


def test_weight_of_unknown_regime_is_one(spark):
    df = spark.createDataFrame([("crisis",), ("other",), (None,)], "regime string")
    assert [r[0] for r in df.select(s.regime_weight("momentum")).collect()] == [0.7, 1.0, 1.0]


def test_constant_prices(spark):
    p = pd.DataFrame({"series_id": "s", "ts": [dt.datetime(2020, 1, k) for k in range(1, 6)], "a_close": 1.0, "b_close": 1.0, "ratio_zscore_30": 0.0, "ratio_slope": 0.0, "a_vol_20": 0.0, "b_vol_20": 0.0})
    got = bt.metrics(bt.run_folds(spark.createDataFrame(p))).first()
    assert (got.sharpe, got.cagr, got.hit_rate, got.calmar) == (0, 0, 0, 0)
