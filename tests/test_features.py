import numpy as np
import pandas as pd
import pytest
from panels import flat, panel
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlens.functions import columns as C
from pairlens.operators import features as f
from pairlens.operators.recurrence import Recurrence, ema, ewm_std, linear_recurrence


def got(df, *cols):
    return df.orderBy("series_id", "ts").select("series_id", "ts", *cols).toPandas()


def test_rolling_scores_equal_pandas(spark):
    p = panel()
    out = got(f.ratio_features(spark.createDataFrame(p)), "ratio_zscore_30", "ratio_zscore_90", "ratio_slope", "a_ret_5", "a_vol_20", "vol_ratio")
    r = p.a_close / p.b_close
    for n in (30, 90):
        np.testing.assert_allclose(out[f"ratio_zscore_{n}"].astype(float), (r - r.rolling(n).mean()) / r.rolling(n).std(), rtol=1e-9)
    np.testing.assert_allclose(out.ratio_slope.astype(float), r.diff(5), rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(out.a_vol_20.astype(float), p.a_close.pct_change().rolling(20).std(), rtol=1e-9)
    np.testing.assert_allclose(out.vol_ratio.astype(float), p.a_close.pct_change().rolling(20).std() / p.b_close.pct_change().rolling(20).std(), rtol=1e-9)


@pytest.mark.parametrize("n,full", [(29, 0), (30, 1), (91, 62)])
def test_warm_up_edges(spark, n, full):
    out = got(f.ratio_features(spark.createDataFrame(panel(n))), "ratio_zscore_30")
    assert out.ratio_zscore_30.notna().sum() == full


@pytest.mark.parametrize("block", [None, 32, 50])
def test_averages_do_not_depend_on_the_block(spark, block):
    p = panel(300, ("x", "y"))
    out = got(ema(spark.createDataFrame(p), {"e10": ("a_close", 10), "e30": ("a_close", 30)}, block=block), "e10", "e30")
    for n in (10, 30):
        want = p.groupby("series_id").a_close.transform(lambda s, n=n: s.ewm(span=n, adjust=False).mean())
        np.testing.assert_allclose(out[f"e{n}"], want, rtol=1e-10)


def test_weighted_deviation_equals_pandas(spark):
    p = panel(200)
    out = got(ewm_std(f.with_returns(spark.createDataFrame(p)), {"v": ("a_ret_1", 20)}), "v")
    np.testing.assert_allclose(out.v.astype(float), p.a_close.pct_change().ewm(span=20).std(), rtol=1e-7)


def test_recurrence_with_a_column_decay(spark):
    p = panel(400).assign(d=0.98, x=1.0)
    out = got(linear_recurrence(spark.createDataFrame(p), [Recurrence("y", "d", "x", 0.2, 0.98)]), "y")
    np.testing.assert_allclose(out.y, (1 - 0.98 ** np.arange(1, 401)) / 0.02, rtol=1e-10)


def test_macd_breakout_and_volatility(spark):
    p = panel(200)
    df = f.volatility_features(f.momentum_features(f.ratio_features(spark.createDataFrame(p))))
    out = got(df, "a_macd_hist", "b_breakout", "a_atr_14", "vol_ratio_5", "rel_strength_20")
    e = lambda n: p.a_close.ewm(span=n, adjust=False).mean()
    m = e(12) - e(26)
    np.testing.assert_allclose(out.a_macd_hist, m - m.ewm(span=9, adjust=False).mean(), rtol=1e-8, atol=1e-10)
    low, high = p.b_close.rolling(20).min(), p.b_close.rolling(20).max()
    np.testing.assert_allclose(out.b_breakout.astype(float), (p.b_close - low) / (high - low), rtol=1e-9)
    np.testing.assert_allclose(out.a_atr_14.astype(float), p.a_close.diff().abs().rolling(14).mean(), rtol=1e-9)
    assert out.vol_ratio_5.astype(float).iloc[50] == pytest.approx(p.b_close.pct_change().rolling(5).std()[50] / p.a_close.pct_change().rolling(5).std()[50])


def test_constant_legs_give_nulls_not_errors(spark):
    out = got(f.volatility_features(f.momentum_features(f.ratio_features(spark.createDataFrame(flat())))), "ratio_zscore_30", "vol_ratio", "a_breakout")
    assert out.ratio_zscore_30.isna().all() and out.vol_ratio.isna().all()
    assert (out.a_breakout.dropna() == 0).all()


def test_single_and_staged_drop(spark):
    df = spark.createDataFrame(panel(200))
    assert f.feature_frame(df).count() == 111
    assert f.feature_frame(df, staged=True).count() == 111 - 19 - 60


def test_series_do_not_touch_each_other_and_order_does_not_matter(spark):
    p = panel(150, ("x", "y"))
    both = got(f.feature_frame(spark.createDataFrame(p.sample(frac=1, random_state=3))), "a_macd_hist", "ratio_zscore_90")
    alone = got(f.feature_frame(spark.createDataFrame(p[p.series_id == "y"])), "a_macd_hist", "ratio_zscore_90")
    pd.testing.assert_frame_equal(both[both.series_id == "y"].reset_index(drop=True), alone)


def test_no_look_ahead(spark):
    p = panel(180)
    changed = p.copy()
    changed.loc[150:, ["a_close", "b_close"]] *= 3
    a, b = (got(f.feature_frame(spark.createDataFrame(x)), "a_macd_hist", "ratio_zscore_90", "a_cond_vol") for x in (p, changed))
    cut = p.ts[150]
    pd.testing.assert_frame_equal(a[a.ts < cut], b[b.ts < cut])


def test_halo_blocks_equal_plain_windows(spark):
    df = f.with_ratio(spark.createDataFrame(panel(400, ("x", "y"))))
    plain = got(df.withColumn("z", C.zscore(F.col("ratio"), 90, C.over_series())), "z")
    cut = f.halo_blocks(f.long_bar_index(df, 3), 120, 89)
    w = Window.partitionBy("series_id", "block_id").orderBy("ts")
    split = got(cut.withColumn("z", C.zscore(F.col("ratio"), 90, w)).where(~F.col("is_halo")), "z")
    pd.testing.assert_frame_equal(plain, split)


def test_forward_fill_is_limited(spark):
    x = [1.0, None, None, 2.0, None, None, None, None, 3.0]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(x)], "series_id string, ts int, x double")
    out = df.select("ts", C.forward_fill("x", C.over_series(), 3).alias("y")).orderBy("ts").toPandas().y
    assert [None if np.isnan(v) else v for v in out] == [1, 1, 1, 2, 2, 2, 2, None, 3]


def test_null_handling_helpers(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (2.0, None), (3.0, 3.0)], "x double, y double")
    assert C.nan_to_null(df).where("x is null").count() == 1
    assert C.drop_incomplete(df).count() == 1
    assert df.select(C.clip(F.col("y"), 0, 1).alias("c")).where("c is null").count() == 1
    with pytest.raises(ValueError, match="missing"):
        C.require_columns(df, ["x", "z"], "here")


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, float(k)) for k in range(5)], "x double, y double")
    assert df.agg(C.correlation("x", "y")).first()[0] is None


def test_long_series_in_blocks_equal_whole_ones(spark):
    df = spark.createDataFrame(panel(2600, ("x", "y")))
    got = f.long_series_features(df, 900).orderBy("series_id", "ts").toPandas()
    want = f.feature_frame(df).orderBy("series_id", "ts").toPandas()
    assert len(got) == len(want) and set(want.columns) == set(got.columns)
    for c in want.columns.drop(["series_id", "ts"]):
        np.testing.assert_allclose(got[c], want[c], rtol=1e-7, atol=1e-9)
    with pytest.raises(ValueError):
        f.halo_blocks(df.withColumn("bar_idx", F.lit(0)), 10, 20)
