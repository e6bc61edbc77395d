"""Hand-made and random panels, and the plain pandas versions of features that tests compare with."""

import numpy as np
import pandas as pd


def panel(n=260, series=("s1",), seed=1):
    rng = np.random.default_rng(seed)
    parts = []
    for s in series:
        a, b = (100 * np.exp(np.cumsum(rng.normal(0, 0.02, n))) for _ in range(2))
        parts.append(pd.DataFrame({"series_id": s, "ts": pd.date_range("2020-01-01", periods=n, freq="D"), "a_close": a, "b_close": b * 0.5}))
    return pd.concat(parts, ignore_index=True)


def flat(n=40):
    return pd.DataFrame({"series_id": "flat", "ts": pd.date_range("2020-01-01", periods=n, freq="D"), "a_close": 2.0, "b_close": 1.0})


def sequential_backtest(df, cost=0.0003):
    """One row after the other, as one would trade."""
    capital, position, size, out = 1.0, None, 0.0, []
    rows = df.to_dict("records")
    for before, now in zip(rows, rows[1:]):
        gross = now[f"{position}_close"] / before[f"{position}_close"] - 1 if position else 0.0
        z, slope = now["ratio_zscore_30"], now["ratio_slope"]
        side = "b" if z > 1 and abs(slope) < 0.5 else "a" if z < -1 and abs(slope) < 0.5 else "a" if slope > 0 else "b"
        switched = position is not None and side != position
        ret = size * gross - switched * cost
        capital *= 1 + ret
        out.append((now["ts"], capital, ret, int(switched)))
        vol = now[f"{side}_vol_20"]
        position, size = side, 1.0 if not vol > 0 else min(0.01 / vol, 1.0)
    return pd.DataFrame(out, columns=["ts", "capital", "daily_return", "switched"])
