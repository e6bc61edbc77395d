"""Long series in blocks against plain windows and plain Python."""

import numpy as np
import pandas as pd
import pytest
from panels import panel
from pyspark.sql import functions as F

from pairlens.operators import backtest as bt
from pairlens.operators import features as f
from pairlens.operators.scan import BLOCK, INDEX, Scan, numbered, scan


def long_frame(spark, n=1500):
    return f.ratio_features(spark.createDataFrame(panel(n, ("x", "y")))).dropna()


def test_numbers_and_blocks(spark):
    p = panel(700, ("x",)).sample(frac=1, random_state=1)
    p = pd.concat([p, panel(1, ("z",)), panel(256, ("y",))])
    got = numbered(spark.createDataFrame(p), block_rows=256).orderBy("series_id", "ts").toPandas()
    for s, own in got.groupby("series_id"):
        assert own[INDEX].tolist() == list(range(len(own))) and (own.n_bars == len(own)).all() and (own[BLOCK] == own[INDEX] // 256).all()
    assert len(got) == 957


@pytest.mark.parametrize("block", [1, 7, 256, 5000])
def test_scans_equal_row_by_row(spark, block):
    rng = np.random.default_rng(block)
    n = 60 if block == 1 else 600
    p = pd.DataFrame({"series_id": np.repeat(["a", "b"], [n, n // 3]), "ts": pd.date_range("2020-01-01", periods=n + n // 3), "x": rng.normal(size=n + n // 3), "g": rng.uniform(0.9, 1.1, n + n // 3)})
    p["keep"] = np.where(p.series_id == "a", 0.98, 0.5)
    p.loc[rng.choice(len(p), 9, replace=False), "x"] = np.nan
    df = numbered(spark.createDataFrame(p).withColumn("x", F.when(~F.isnan("x"), F.col("x"))), block_rows=block)
    scans = [Scan("slow", "affine", "x", 0.999), Scan("mid", "affine", "x", 0.98), Scan("own", "affine", "x", "keep", 0.5, 0.98), Scan("grown", "product", "g"), Scan("total", "sum", "x"), Scan("top", "max", "x")]
    got = scan(df, scans).orderBy("series_id", INDEX).toPandas()
    for s, own in got.groupby("series_id"):
        given = p[p.series_id == s]
        y = dict.fromkeys(("slow", "mid", "own", "grown", "total", "top"))
        want = {k: [] for k in y}
        y |= {"slow": 0.0, "mid": 0.0, "own": 0.0, "grown": 1.0, "total": 0.0}
        for x, g, keep in zip(given.x, given.g, given.keep):
            x0 = 0.0 if np.isnan(x) else x
            y["slow"], y["mid"], y["own"] = 0.999 * y["slow"] + x0, 0.98 * y["mid"] + x0, keep * y["own"] + x0
            y["grown"], y["total"] = y["grown"] * g, y["total"] + x0
            y["top"] = y["top"] if np.isnan(x) else x if y["top"] is None else max(x, y["top"])
            for k in want:
                want[k].append(np.nan if y[k] is None else y[k])
        for k, v in want.items():
            np.testing.assert_allclose(own[k].astype(float), v, rtol=1e-9, atol=1e-12)
    with pytest.raises(ValueError):
        scan(df, [Scan("u", "median", "x")])


@pytest.mark.parametrize("signal", [None, "side"])
def test_long_backtests_equal_windows(spark, signal):
    df = long_frame(spark).withColumn("side", F.when(F.col("ratio_slope") > 0, "b").otherwise("a"))
    want = bt.drawdowns(bt.trade(df, signal_col=signal).where("bar_no >= 1")).orderBy("series_id", "ts").toPandas()
    blocks = bt.trade(df, signal_col=signal, block_rows=256)
    got = blocks.where("bar_no >= 1").orderBy("series_id", "ts").toPandas()
    for c in ("capital", "drawdown", "daily_return", "peak", "switched"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-10, atol=1e-13)
    assert (got.signal == want.signal).all() and blocks.where("capital is null").count() == 2
    a, b = (bt.metrics(bt.run_folds(df, signal_col=signal, block_rows=k)).orderBy("series_id").toPandas() for k in (None, 256))
    pd.testing.assert_frame_equal(a, b)


def test_long_walk_forward_equals_windows(spark):
    df = long_frame(spark, 700)
    for run in (bt.walk_forward_rolling, bt.walk_forward_anchored):
        a, b = (run(df, block_rows=k) for k in (None, 64))
        assert sorted(a.columns) == sorted(b.columns)
        names = sorted(a.columns)
        a, b = (x.select(*names).orderBy("series_id", "first_ts").toPandas() for x in (a, b))
        pd.testing.assert_frame_equal(a, b)


def test_no_group_has_more_than_a_block(spark):
    """What windows and scans group by: a series and block, with one row of the block before."""
    df = numbered(long_frame(spark), block_rows=100)
    sizes = df.groupBy("series_id", BLOCK).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] == 100 and sizes[1] >= 28
    plan = bt.trade(long_frame(spark), block_rows=100)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(series_id" not in plan or all(BLOCK in part[:90] for part in plan.split("windowspecdefinition(")[1:])
