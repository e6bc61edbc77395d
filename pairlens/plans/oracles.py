"""The queries' equivalents in SQL, written independently: averages by recursion, positions by lag, windows by joins."""

from __future__ import annotations

from ..operators.backtest import decay_grid, refining
from ..operators.garch import COARSE
from .queries import COSTS, FIXED_HMM, IC_SIGNALS, WINDOWS

BARS = """bars AS (
  SELECT l_linestatus AS series_id, CAST(l_shipdate AS TIMESTAMP) AS ts,
    floor(avg(CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) END) * 1e6 + 0.5) / 1e6 AS a_close,
    floor(avg(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) END) * 1e6 + 0.5) / 1e6 AS b_close
  FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) = 2)"""


def guard(agg: str, x: str, n: int, least: int | None = None) -> str:
    frame = f"OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {least or n} THEN {agg}({x}) {frame} END"


W = "OVER (PARTITION BY series_id ORDER BY ts)"
RAW = f"""raw AS (
  SELECT *, a_close / b_close AS ratio, a_close / lag(a_close) {W} - 1 AS a_ret_1, b_close / lag(b_close) {W} - 1 AS b_ret_1,
    abs(a_close - lag(a_close) {W}) AS a_move, abs(b_close - lag(b_close) {W}) AS b_move FROM bars)"""


def _legs(template: str) -> str:
    return ", ".join(template.replace("@", leg) for leg in "ab")


FEAT = f"""feat AS (
  SELECT *, (ratio - {guard("avg", "ratio", 30)}) / nullif({guard("stddev_samp", "ratio", 30)}, 0) AS ratio_zscore_30,
    (ratio - {guard("avg", "ratio", 90)}) / nullif({guard("stddev_samp", "ratio", 90)}, 0) AS ratio_zscore_90,
    ratio - lag(ratio, 5) {W} AS ratio_slope,
    {_legs(f"@_close / lag(@_close, 5) {W} - 1 AS @_ret_5, @_close / lag(@_close, 20) {W} - 1 AS @_ret_20")},
    {_legs(f"{guard('stddev_samp', '@_ret_1', 5)} AS @_vol_5, {guard('stddev_samp', '@_ret_1', 20)} AS @_vol_20, {guard('stddev_samp', '@_ret_1', 60)} AS @_vol_60")},
    {_legs(f"{guard('avg', '@_move', 14)} AS @_atr_14")},
    {_legs(f"(@_close - {guard('min', '@_close', 20)}) / greatest({guard('max', '@_close', 20)} - {guard('min', '@_close', 20)}, 1e-9) AS @_breakout")}
  FROM raw)"""
MORE = """more AS (
  SELECT *, a_vol_20 / nullif(b_vol_20, 0) AS vol_ratio, b_vol_5 / nullif(a_vol_5, 0) AS vol_ratio_5, b_vol_60 / nullif(a_vol_60, 0) AS vol_ratio_60,
    a_atr_14 / a_close AS a_atr_pct, b_atr_14 / b_close AS b_atr_pct, a_ret_5 - b_ret_5 AS rel_strength_5, a_ret_20 - b_ret_20 AS rel_strength_20 FROM feat)"""
_NEXT = {f"{k}{n}": f"e.{k}{n} + (n.{c} - e.{k}{n}) * {2 / (n + 1)!r}" for k, c in (("a", "a_close"), ("b", "b_close"), ("r", "ratio")) for n in ((10, 30) if k == "r" else (10, 12, 26, 30))}
_SIG = {f"{k}9": f"e.{k}9 + (({_NEXT[f'{k}12']}) - ({_NEXT[f'{k}26']}) - e.{k}9) * 0.2" for k in "ab"}
EMA = f"""num AS (SELECT *, row_number() {W} - 1 AS i FROM raw),
ema AS (
  SELECT series_id, i, {", ".join(f"{ {'a': 'a_close', 'b': 'b_close', 'r': 'ratio'}[k[0]]} AS {k}" for k in _NEXT)}, CAST(0 AS DOUBLE) AS {" , CAST(0 AS DOUBLE) AS ".join(_SIG)} FROM num WHERE i = 0
  UNION ALL
  SELECT n.series_id, n.i, {", ".join(_NEXT.values())}, {", ".join(_SIG.values())} FROM ema e JOIN num n ON n.series_id = e.series_id AND n.i = e.i + 1),
emas AS (
  SELECT m.*, a10 - a30 AS a_ema_slope, b10 - b30 AS b_ema_slope, r10 - r30 AS ratio_ema_slope, a12 - a26 AS a_macd, b12 - b26 AS b_macd, a9 AS a_macd_signal, b9 AS b_macd_signal, a12 - a26 - a9 AS a_macd_hist, b12 - b26 - b9 AS b_macd_hist
  FROM (SELECT *, row_number() {W} - 1 AS i FROM more) m JOIN ema USING (series_id, i))"""
RULE = f"CASE WHEN ratio_zscore_30 > 1 AND abs(ratio_slope) < 0.5 THEN 'b' WHEN ratio_zscore_30 < -1 AND abs(ratio_slope) < 0.5 THEN 'a' WHEN ratio_slope > 0 THEN 'a' ELSE 'b' END"
FRAME = f"""frame AS (
  SELECT *, row_number() {W} - 1 AS bar_idx, count(*) OVER (PARTITION BY series_id) AS n, {RULE} AS signal, ratio_zscore_30 AS z30 FROM @ WHERE ratio_zscore_90 IS NOT NULL AND ratio_zscore_30 IS NOT NULL AND vol_ratio IS NOT NULL),
sized AS (
  SELECT *, CASE WHEN vol IS NULL OR vol <= 0 THEN 1.0 ELSE least(0.01 / vol, 1.0) END AS size, lead(ratio, 5) {W} / ratio - 1 AS fwd FROM (SELECT *, CASE WHEN signal = 'a' THEN a_vol_20 ELSE b_vol_20 END AS vol FROM frame))"""
REGIME = "CASE WHEN ratio_zscore_30 > 1.5 THEN 'crisis' WHEN abs(ratio_zscore_30) < 0.3 THEN 'range_bound' WHEN ratio_zscore_30 < -1 THEN 'risk_on' WHEN ratio_zscore_30 IS NOT NULL THEN 'trending' END"


def _z60(x: str) -> str:
    return f"({x} - {guard('avg', x, 60, 30)}) / greatest({guard('stddev_samp', x, 60, 30)}, 1e-9)"


def _weight(crisis: float, quiet: float, on: float, trend: float) -> str:
    return f"CASE regime WHEN 'crisis' THEN {crisis} WHEN 'range_bound' THEN {quiet} WHEN 'risk_on' THEN {on} WHEN 'trending' THEN {trend} ELSE 1.0 END"


SIGNALS = f"""reg AS (SELECT *, {REGIME} AS regime FROM sized),
strat0 AS (
  SELECT *, {_z60("ratio_ema_slope")} * -0.35 - {_z60("rel_strength_20")} * 0.3 - {_z60("a_macd_hist")} * 0.2 + {_z60("b_ema_slope")} * 0.15 AS mom,
    (b_breakout - 0.5) * 2 - (a_breakout - 0.5) * 2 AS apart, least(2.5, greatest(0.5, a_vol_5 / greatest(a_vol_20, 1e-9))) AS pace FROM reg),
strat1 AS (SELECT *, abs(apart) * pace * greatest(a_atr_pct, 1e-9) AS raw_conf FROM strat0),
strat AS (
  SELECT *, tanh(z30 * 0.8) AS mr_signal,
    least(1, greatest(0, abs(z30) / 3 * CASE WHEN sign(z30) = sign(ratio_zscore_90) THEN 1.3 ELSE 0.85 END * CASE WHEN sign(z30) = sign(ratio_slope) THEN 0.7 ELSE 1.0 END * {_weight(1.5, 1.3, 0.8, 0.4)})) AS mr_confidence,
    tanh(mom) AS mom_signal, CASE WHEN mom IS NOT NULL THEN least(1, greatest(0, abs(mom) / 3 * {_weight(0.7, 0.4, 1.2, 1.5)})) END AS mom_confidence, tanh(apart * pace) AS bo_signal,
    least(1, greatest(0, least(1, raw_conf / greatest(most, 1e-9)) * {_weight(0.8, 0.3, 1.1, 1.4)})) AS bo_conf0, most FROM (SELECT *, {guard("max", "raw_conf", 60, 10)} AS most FROM strat1)),
strategy AS (SELECT *, CASE WHEN most IS NOT NULL THEN bo_conf0 END AS bo_confidence FROM strat)"""


def traded(source: str, keys: str, cost: str = "0.0002 + 0.0001") -> str:
    """Backtest of each group of keys: bt (rows)."""
    w = f"(PARTITION BY {keys} ORDER BY ts)"
    return f"""lagged AS (SELECT *, row_number() OVER {w} - 1 AS bar_no, lag(signal) OVER {w} AS held, lag(size) OVER {w} AS held_size, a_close / lag(a_close) OVER {w} - 1 AS ra, b_close / lag(b_close) OVER {w} - 1 AS rb FROM {source}),
moves AS (SELECT *, CASE WHEN bar_no >= 2 AND signal <> held THEN 1 ELSE 0 END AS switched, CASE WHEN bar_no >= 2 THEN held_size * CASE WHEN held = 'a' THEN ra ELSE rb END ELSE 0.0 END AS gross FROM lagged WHERE bar_no >= 1),
bt AS (SELECT *, product(1 + daily_return) OVER (PARTITION BY {keys} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS capital FROM (SELECT *, gross - switched * ({cost}) AS daily_return FROM moves))"""


def measured(keys: str) -> str:
    """Of bt: dd (with drawdown), met (metrics)."""
    return f"""dd AS (SELECT *, capital / max(capital) OVER (PARTITION BY {keys} ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM bt),
met0 AS (SELECT {keys}, coalesce(avg(daily_return) / nullif(stddev_samp(daily_return), 0) * sqrt(252), 0) AS sharpe,
  CASE WHEN count(*) < 2 THEN 0 WHEN arg_max(capital, ts) / arg_min(capital, ts) <= 0 THEN -1 ELSE pow(arg_max(capital, ts) / arg_min(capital, ts), 252.0 / count(*)) - 1 END AS cagr,
  min(drawdown) AS max_drawdown, coalesce(avg(CASE WHEN daily_return <> 0 THEN CASE WHEN daily_return > 0 THEN 1.0 ELSE 0.0 END END), 0) AS hit_rate, arg_max(capital, ts) AS final_capital, CAST(sum(switched) AS BIGINT) AS n_turns FROM dd GROUP BY {keys}),
met AS (SELECT {keys}, round(sharpe, 4) AS sharpe, round(cagr, 4) AS cagr, round(max_drawdown, 4) AS max_drawdown, round(hit_rate, 4) AS hit_rate, round(coalesce(cagr / nullif(abs(max_drawdown), 0), 0), 4) AS calmar, final_capital, n_turns FROM met0)"""


def folds(source: str, keys: str, cost: str = "0.0002 + 0.0001") -> str:
    return traded(source, keys, cost) + ", " + measured(keys)


def windows(source: str, size: int = 60, step: int = 20) -> str:
    at = f"{step + 5} * k"
    return f"wins AS (SELECT f.*, k AS window_idx FROM {source} f, generate_series(0, 2000) g(k) WHERE bar_idx >= {at} AND bar_idx < {at} + {size} AND {at} + {size} <= n)"


def ics(signals: list[str]) -> str:
    long = " UNION ALL ".join(f"SELECT series_id, window_idx, '{s}' AS s, {s} AS x, -fwd AS y FROM wins WHERE {s} IS NOT NULL AND fwd IS NOT NULL" for s in signals)
    rank = lambda c: f"rank() OVER (PARTITION BY series_id, window_idx, s ORDER BY {c}) + (count(*) OVER (PARTITION BY series_id, window_idx, s, {c}) - 1) / 2.0"
    picked = ", ".join(f"round(max(CASE WHEN s = '{s}' THEN ic END), 6) AS ic_{s}" for s in signals)
    return f"""long AS ({long}), ranked AS (SELECT *, {rank("x")} AS rx, {rank("y")} AS ry FROM long),
ic1 AS (SELECT series_id, window_idx, s, CASE WHEN count(*) >= 10 AND stddev_samp(rx) > 0 AND stddev_samp(ry) > 0 THEN corr(rx, ry) END AS ic FROM ranked GROUP BY ALL),
ic AS (SELECT series_id, window_idx, {picked}, avg(ic) AS ic_composite FROM ic1 GROUP BY ALL)"""


BASE = f"{BARS}, {RAW}, {FEAT}, {MORE}"
PLAIN = BASE + ", " + FRAME.replace("@", "more")
FULL = BASE + ", " + EMA + ", " + FRAME.replace("@", "emas") + ", " + SIGNALS
WALK = PLAIN + ", " + windows("sized") + ", " + folds("wins", "series_id, window_idx") + ", " + ics(["z30"])
SPANS = "span AS (SELECT series_id, @, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_bars FROM wins GROUP BY ALL)"
METRICS = ["sharpe", "cagr", "max_drawdown", "hit_rate", "calmar"]
DAY = "strftime(ts, '%Y-%m-%d') AS day"


def r(*names: str, places: int = 6) -> str:
    return ", ".join(f"CASE WHEN round(CAST({n} AS DOUBLE), {places}) = 0 THEN 0.0 ELSE round(CAST({n} AS DOUBLE), {places}) END AS {n}" for n in names)


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


def _anchored_rows(name: str) -> str:
    numbered = "SELECT *, CAST(floor((bar_idx - 20.0) / test) AS BIGINT) AS fold FROM (SELECT *, greatest(n // 6, 30) AS test FROM sized)"
    return f"{name} AS (SELECT * FROM ({numbered}) WHERE fold BETWEEN 1 AND 5 AND (fold + 1) * test + 20 <= n)"


def _anchored() -> str:
    return PLAIN + ", " + _anchored_rows("wins") + ", " + folds("wins", "series_id, fold")


def _regimes(select: str, more: str = "") -> str:
    return _with(BASE + f", reg AS (SELECT *, {REGIME} AS regime FROM more)" + more, select)


def _decay() -> str:
    """The best rate of the grid, then of finer grids around it: d0, d1, ... each hold one row a series."""
    points = "pts AS (SELECT series_id, CAST(window_idx AS DOUBLE) AS t, ic_composite AS y FROM ic WHERE ic_composite IS NOT NULL)"
    fit = """SELECT series_id, b, CASE WHEN b = 0 THEN 0 ELSE regr_slope(y, exp(-b * t)) END AS a, CASE WHEN b = 0 THEN avg(y) ELSE regr_intercept(y, exp(-b * t)) END AS c,
  CASE WHEN b = 0 THEN regr_syy(y, y) ELSE regr_syy(y, exp(-b * t)) * (1 - regr_r2(y, exp(-b * t))) END AS sse FROM {} GROUP BY series_id, b HAVING a IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY sse, b) = 1"""
    listed = lambda x: "(SELECT unnest([" + ", ".join(map(repr, x)) + "]::DOUBLE[]) AS f)"
    ctes = [points, f"d0 AS ({fit.format(f'(SELECT pts.*, f AS b FROM pts, {listed(decay_grid())})')})"]
    near = refining(decay_grid()[2] / decay_grid()[1], 3)
    ctes += [f"d{k + 1} AS ({fit.format(f'(SELECT DISTINCT pts.*, d{k}.b * f AS b FROM pts JOIN d{k} USING (series_id), {listed(x)})')})" for k, x in enumerate(near)]
    shown = {"alpha_initial": "round(a + c, 6)", "decay_rate": "round(b, 6)", "alpha_floor": "round(c, 6)", "half_life_windows": "CASE WHEN b > 1e-9 THEN round(ln(2) / b, 2) ELSE 'inf'::DOUBLE END", "half_life_days": "CASE WHEN b > 1e-9 THEN round(ln(2) / b * 20, 1) ELSE 'inf'::DOUBLE END"}
    picked = ", ".join(f"CASE WHEN ok THEN round({x}, 4) END AS {n}" for n, x in shown.items())
    return ", ".join(ctes) + f", cnt AS (SELECT series_id, count(ic_composite) AS k, count(*) AS n_windows FROM met LEFT JOIN ic USING (series_id, window_idx) GROUP BY 1), fitted AS (SELECT series_id, n_windows, {picked}, CASE WHEN ok THEN round(sse, 4) END AS sse, ok AS fit_success FROM (SELECT *, k >= 4 AND b IS NOT NULL AS ok FROM cnt LEFT JOIN d3 USING (series_id)))"


_FITTED = "alpha_initial, decay_rate, alpha_floor, half_life_windows, half_life_days"


def _density(k: int) -> str:
    """Of state k of the fixed model at (x, y)."""
    (mx, my), ((a, b), (_, d)) = FIXED_HMM["centre"][k], FIXED_HMM["covariance"][k]
    det = a * d - b * b
    return f"exp(-0.5 * ({d / det!r} * pow(x - ({mx}), 2) - 2 * {b / det!r} * (x - ({mx})) * (y - ({my})) + {a / det!r} * pow(y - ({my}), 2))) / {2 * 3.141592653589793 * det**0.5!r}"


def _hmm(then: str, select: str) -> str:
    obs = f"obs AS (SELECT series_id, ts, bar_idx AS i, n, ratio_zscore_30 AS x, ratio_zscore_90 AS y FROM frame), d AS (SELECT *, {_density(0)} AS b0, {_density(1)} AS b1 FROM obs)"
    return _with(PLAIN + ", " + obs + ", " + then, select)


def _em() -> str:
    """Forward and backward messages row by row, each divided by its sum."""
    (s0, s1), ((p00, p01), (p10, p11)) = FIXED_HMM["start"], FIXED_HMM["move"]
    f0, f1 = f"(f.a0 * {p00} + f.a1 * {p10}) * d.b0", f"(f.a0 * {p01} + f.a1 * {p11}) * d.b1"
    g0, g1 = f"({p00} * d.b0 * b.z0 + {p01} * d.b1 * b.z1)", f"({p10} * d.b0 * b.z0 + {p11} * d.b1 * b.z1)"
    then = f"""fwd AS (SELECT series_id, i, {s0} * b0 / ({s0} * b0 + {s1} * b1) AS a0, {s1} * b1 / ({s0} * b0 + {s1} * b1) AS a1, {s0} * b0 + {s1} * b1 AS c FROM d WHERE i = 0
  UNION ALL SELECT d.series_id, d.i, {f0} / ({f0} + {f1}), {f1} / ({f0} + {f1}), {f0} + {f1} FROM fwd f JOIN d ON d.series_id = f.series_id AND d.i = f.i + 1),
bwd AS (SELECT series_id, i, 1.0::DOUBLE AS z0, 1.0::DOUBLE AS z1 FROM d WHERE i = n - 1
  UNION ALL SELECT d.series_id, d.i - 1, {g0} / ({g0} + {g1}), {g1} / ({g0} + {g1}) FROM bwd b JOIN d ON d.series_id = b.series_id AND d.i = b.i WHERE d.i > 0),
g AS (SELECT d.*, a0, a1, z0, z1, c, a0 * z0 / (a0 * z0 + a1 * z1) AS g0, a1 * z1 / (a0 * z0 + a1 * z1) AS g1, lag(a0) OVER (PARTITION BY series_id ORDER BY i) AS q0, lag(a1) OVER (PARTITION BY series_id ORDER BY i) AS q1 FROM d JOIN fwd USING (series_id, i) JOIN bwd USING (series_id, i)),
x AS (SELECT *, q0 * {p00} * b0 * z0 AS x00, q0 * {p01} * b1 * z1 AS x01, q1 * {p10} * b0 * z0 AS x10, q1 * {p11} * b1 * z1 AS x11 FROM g),
m AS (SELECT sum(ln(c)) AS ll, {", ".join(f"sum(x{i}{j} / (x00 + x01 + x10 + x11)) + 1e-8 AS m{i}{j}" for i in "01" for j in "01")}, {", ".join(f"sum(g{i}) FILTER (WHERE i = 0) AS s{i}, sum(g{i}) AS n{i}, sum(g{i} * x) AS x{i}, sum(g{i} * y) AS y{i}, sum(g{i} * x * x) AS xx{i}, sum(g{i} * x * y) AS xy{i}, sum(g{i} * y * y) AS yy{i}" for i in "01")} FROM x)"""
    row = lambda name, value, i=0, j=0, k=0: f"SELECT '{name}' AS name, {i}::BIGINT AS i, {j}::BIGINT AS j, {k}::BIGINT AS k, round({value}, 5) AS value FROM m"
    rows = [row("log_likelihood", "ll")]
    for i in (0, 1):
        rows += [row("start", f"s{i} / (s0 + s1)", i), *[row("move", f"m{i}{j} / (m{i}0 + m{i}1)", i, j) for j in (0, 1)], row("centre", f"x{i} / n{i}", i), row("centre", f"y{i} / n{i}", i, 1)]
        rows += [row("covariance", f"{v}{w}{i} / n{i} - {v}{i} * {w}{i} / (n{i} * n{i}) + {0.001 if v == w else 0.0}", i, a, b) for a, v, b, w in ((0, "x", 0, "x"), (0, "x", 1, "y"), (1, "y", 1, "y"))]
    return _hmm(then, " UNION ALL ".join(rows))


def _path() -> str:
    """The best score of each state row by row with the state before it, then back from the best end."""
    import math

    (s0, s1), move = FIXED_HMM["start"], [[math.log(p) for p in row] for row in FIXED_HMM["move"]]
    to = lambda j: f"v.v0 + ({move[0][j]!r}), v.v1 + ({move[1][j]!r})"
    came = lambda j: f"CASE WHEN v.v1 + ({move[1][j]!r}) > v.v0 + ({move[0][j]!r}) THEN 1 ELSE 0 END"
    then = f"""v AS (SELECT series_id, i, n, ts, ln({s0}) + ln(b0) AS v0, ln({s1}) + ln(b1) AS v1, 0 AS p0, 0 AS p1 FROM d WHERE i = 0
  UNION ALL SELECT d.series_id, d.i, d.n, d.ts, greatest({to(0)}) + ln(d.b0), greatest({to(1)}) + ln(d.b1), {came(0)}, {came(1)} FROM v JOIN d ON d.series_id = v.series_id AND d.i = v.i + 1),
back AS (SELECT series_id, i, ts, CASE WHEN v1 > v0 THEN 1 ELSE 0 END AS s, CASE WHEN v1 > v0 THEN p1 ELSE p0 END AS p FROM v WHERE i = n - 1
  UNION ALL SELECT v.series_id, v.i, v.ts, b.p, CASE WHEN b.p = 1 THEN v.p1 ELSE v.p0 END FROM back b JOIN v ON v.series_id = b.series_id AND v.i = b.i - 1)"""
    return _hmm(then, f"SELECT series_id, {DAY}, CAST(s AS BIGINT) AS regime_state FROM back")


def _stumps() -> str:
    """Derivatives at equal scores, every border of every column for each class, the best of each, and what rows get."""
    names = ["ratio_zscore_30", "ratio_slope", "a_ret_5", "b_ret_5"]
    long = " UNION ALL ".join(f"SELECT rid, label, {k} AS f, {c} AS v FROM t" for k, c in enumerate(names))
    edges = "SELECT f, v AS edge FROM (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS place, count(*) OVER (PARTITION BY f) AS n FROM cells) WHERE " + " OR ".join(f"place = ceil({q} * n)" for q in (0.25, 0.5, 0.75))
    gain = lambda g, h: f"pow({g}, 2) / ({h} + 1)"
    pays = f"{gain('gl', 'hl')} + {gain('gr', 'hr')} - {gain('(gl + gr)', '(hl + hr)')} > 1e-9"
    margins = ", ".join(f"max(CASE WHEN c = {k} THEN m END) AS m{k}, max(CASE WHEN c = {k} THEN w END) AS w{k}" for k in range(3))
    pick = lambda p: "CASE WHEN m0 >= m1 AND m0 >= m2 THEN " + f"{p}0 WHEN m1 >= m2 THEN {p}1 ELSE {p}2 END"
    return _with(
        PLAIN
        + f""", t0 AS (SELECT *, stddev_samp(fwd) OVER (PARTITION BY series_id) * 0.3 AS threshold FROM sized),
t AS (SELECT *, row_number() OVER () AS rid, CASE WHEN fwd > threshold THEN 0 WHEN fwd < -threshold THEN 2 ELSE 1 END AS label FROM t0), cells AS ({long}), edges AS (SELECT DISTINCT * FROM ({edges})),
s AS (SELECT c, e.f, e.edge, sum(g) FILTER (WHERE v <= edge) AS gl, sum(g) FILTER (WHERE v > edge) AS gr, count(*) FILTER (WHERE v <= edge) * 4.0 / 9 AS hl, count(*) FILTER (WHERE v > edge) * 4.0 / 9 AS hr
  FROM (SELECT rid, f, v, c, 1.0 / 3 - CASE WHEN label = c THEN 1 ELSE 0 END AS g FROM cells, (VALUES (0), (1), (2)) k(c)) x JOIN edges e ON e.f = x.f GROUP BY ALL),
best AS (SELECT * FROM s WHERE hl >= 1 AND hr >= 1 QUALIFY row_number() OVER (PARTITION BY c ORDER BY {gain("gl", "hl")} + {gain("gr", "hr")} DESC, f, edge) = 1),
m AS (SELECT rid, {margins} FROM (SELECT rid, c, -0.5 * CASE WHEN {pays} THEN CASE WHEN v <= edge THEN gl / (hl + 1) ELSE gr / (hr + 1) END ELSE (gl + gr) / (hl + hr + 1) END AS m,
  -0.5 * CASE WHEN {pays} THEN (gl / (hl + 1) * hl + gr / (hr + 1) * hr) / (hl + hr) ELSE (gl + gr) / (hl + hr + 1) END AS w FROM cells JOIN best USING (f)) GROUP BY rid)""",
        f"SELECT series_id, {DAY}, CAST(label AS BIGINT) AS label, CAST({pick('')} AS BIGINT) AS predicted, round(exp({pick('m')}) / (exp(m0) + exp(m1) + exp(m2)), 6) AS ensemble_confidence, round({pick('m')}, 6) AS margin, round({pick('w')}, 6) AS base FROM t JOIN m USING (rid)",
    )


def _variances(name: str, candidates: str) -> str:
    """Variances of candidates (series_id, leg, alpha, beta), row by row."""
    return f"""{name} AS (
  SELECT t.series_id, t.leg, c.alpha, c.beta, i, ts, e, target, target AS variance FROM tar t JOIN {candidates} c ON c.series_id = t.series_id AND c.leg = t.leg WHERE i = 0
  UNION ALL
  SELECT n.series_id, n.leg, v.alpha, v.beta, n.i, n.ts, n.e, n.target, (1 - v.alpha - v.beta) * n.target + v.alpha * v.e * v.e + v.beta * v.variance FROM {name} v JOIN tar n ON n.series_id = v.series_id AND n.leg = v.leg AND n.i = v.i + 1)"""


def _garch(refinements: int) -> str:
    """best0 of the coarse grid, best1 and so on of the grids around the one before."""
    parts = [
        f"""{BARS}, {RAW}, legs AS (SELECT series_id, 'a_ret_1' AS leg, ts, a_ret_1 * 100 AS x FROM raw WHERE a_ret_1 IS NOT NULL UNION ALL SELECT series_id, 'b_ret_1', ts, b_ret_1 * 100 FROM raw WHERE b_ret_1 IS NOT NULL),
cen AS (SELECT series_id, leg, ts, x - avg(x) OVER (PARTITION BY series_id, leg) AS e, row_number() OVER (PARTITION BY series_id, leg ORDER BY ts) - 1 AS i FROM legs),
tar AS (SELECT *, avg(e * e) OVER (PARTITION BY series_id, leg) AS target FROM cen),
tried0 AS (SELECT * FROM (SELECT DISTINCT series_id, leg FROM tar), (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in COARSE)}) g(alpha, beta))"""
    ]
    for k in range(refinements + 1):
        if k:
            shrink = 0.35 ** (k - 1)
            near = ", ".join(f"({x**shrink!r}::DOUBLE, {y * shrink!r}::DOUBLE)" for x in (0.6, 0.8, 1.0, 1.3, 1.6) for y in (-0.06, -0.03, 0.0, 0.03, 0.06))
            parts.append(f"tried{k} AS (SELECT DISTINCT * FROM (SELECT series_id, leg, round(alpha * fa, 6) AS alpha, round(least(greatest(beta + fb, 0.2), 0.98), 6) AS beta FROM best{k - 1}, (VALUES {near}) g(fa, fb)) WHERE alpha + beta < 0.999)")
        parts.append(_variances(f"var{k}", f"tried{k}"))
        parts.append(f"best{k} AS (SELECT series_id, leg, alpha, beta, ll FROM (SELECT series_id, leg, alpha, beta, sum(-0.5 * (ln(variance) + e * e / variance)) AS ll FROM var{k} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY series_id, leg ORDER BY ll DESC, alpha DESC, beta DESC) = 1)")
    return ", ".join(parts)


_KINDS = "SELECT series_id, '{kind}' AS kind, {number} AS number, n_bars, strftime(first_ts, '%Y-%m-%d') AS first_day, strftime(last_ts, '%Y-%m-%d') AS last_day, {metrics}, round({ic}, 6) AS ic_composite FROM span JOIN met USING (series_id, {number})"


def oracle_sql() -> dict[str, str]:
    rows = {
        "pair_bars": _with(f"{BARS}, {RAW}", f"SELECT series_id, {DAY}, {r('a_close', 'b_close', 'ratio')} FROM raw"),
        "csv_stage": _with(BARS, f"SELECT series_id, {DAY}, {r('a_close', 'b_close')} FROM bars"),
        "lookback_scan": _with(BARS, f"SELECT series_id, {DAY}, {r('a_close', 'b_close')} FROM bars WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1998-01-01'"),
        "pair_universe": f"""WITH q AS (SELECT o_orderpriority AS t, CAST(o_orderdate AS TIMESTAMP) AS ts, floor(avg(CAST(o_totalprice AS DOUBLE)) * 1e6 + 0.5) / 1e6 AS c FROM orders GROUP BY 1, 2)
SELECT a.t || '/' || b.t AS series_id, count(*) AS n_bars, round(avg(a.c / b.c), 6) AS mean_ratio, round(stddev_samp(a.c / b.c), 6) AS std_ratio, min(strftime(a.ts, '%Y-%m-%d')) AS first_day, max(strftime(a.ts, '%Y-%m-%d')) AS last_day
FROM q a JOIN q b ON a.ts = b.ts AND a.t < b.t GROUP BY 1""",
        "macro_merge": """WITH h AS (SELECT date_trunc('hour', ts) AS ts, event_type AS t, floor(avg(value) * 1e6 + 0.5) / 1e6 AS v FROM events GROUP BY 1, 2),
rates AS (SELECT coalesce(a.ts, b.ts) AS ts, a.v AS l, b.v AS s FROM (SELECT * FROM h WHERE t = 'purchase') a FULL JOIN (SELECT * FROM h WHERE t = 'signup') b ON a.ts = b.ts),
filled AS (SELECT ts, last_value(l IGNORE NULLS) OVER w AS l, last_value(s IGNORE NULLS) OVER w AS s FROM rates WINDOW w AS (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT strftime(m.ts, '%Y-%m-%d %H:%M') AS hour, round(m.v, 6) AS "index", round(l, 6) AS yield_long, round(s, 6) AS yield_short, round(l - s, 6) AS yield_curve_slope FROM h m JOIN filled f ON m.ts = f.ts WHERE m.t = 'click' AND l IS NOT NULL AND s IS NOT NULL""",
        "forward_fill_limit": """WITH h AS (SELECT date_trunc('hour', ts) AS ts, round(max(CASE WHEN event_type = 'signup' THEN value END), 6) AS x FROM events GROUP BY 1)
SELECT strftime(ts, '%Y-%m-%d %H:%M') AS hour, round(x, 6) AS x, round(last_value(x IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS filled FROM h""",
        "zscore_30_90": _with(BASE, f"SELECT series_id, {DAY}, round(ratio_zscore_30, 6) AS z30, round(ratio_zscore_90, 6) AS z90 FROM feat"),
        "roll_z_60": _with(f"{BARS}, {RAW}", f"SELECT series_id, {DAY}, round({_z60('ratio')}, 6) AS z60 FROM raw"),
        "ret_vol_features": _with(BASE, f"SELECT series_id, {DAY}, {r('ratio_slope', *[f'{k}_{c}' for k in 'ab' for c in ('ret_1', 'ret_5', 'ret_20', 'vol_5', 'vol_20', 'vol_60', 'atr_14', 'atr_pct')], 'vol_ratio', 'vol_ratio_5', 'vol_ratio_60', places=4)} FROM more"),
        "ema_features": _with(BASE + ", " + EMA, f"SELECT series_id, {DAY}, {r('a_ema_slope', 'b_ema_slope', 'ratio_ema_slope', 'rel_strength_5', 'rel_strength_20', places=4)} FROM emas"),
        "macd": _with(BASE + ", " + EMA, f"SELECT series_id, {DAY}, {r(*[f'{k}_macd{c}' for k in 'ab' for c in ('', '_signal', '_hist')], places=4)} FROM emas"),
        "ewma_vol": _with(
            f"{BARS}, {RAW}, num AS (SELECT *, row_number() {W} AS i FROM raw), pairs AS (SELECT x.series_id, x.ts, pow(19.0 / 21, x.i - y.i) AS w, y.a_ret_1 AS a, y.b_ret_1 AS b FROM num x JOIN num y ON x.series_id = y.series_id AND y.i BETWEEN x.i - 600 AND x.i AND y.a_ret_1 IS NOT NULL)",
            f"SELECT n.series_id, strftime(n.ts, '%Y-%m-%d') AS day, {', '.join(f'round(CASE WHEN count(w) > 1 THEN sqrt(greatest((sum(w * {k} * {k}) / sum(w) - pow(sum(w * {k}) / sum(w), 2)) * sum(w) * sum(w) / (sum(w) * sum(w) - sum(w * w)), 0)) END, 6) AS {k}_cond_vol' for k in 'ab')} FROM num n LEFT JOIN pairs p ON n.series_id = p.series_id AND n.ts = p.ts GROUP BY n.series_id, n.ts",
        ),
        "breakout": _with(BASE, f"SELECT series_id, {DAY}, {r('a_breakout', 'b_breakout')} FROM feat"),
        "ratio_band": _with(f"{BARS}, {RAW}", f"SELECT series_id, {DAY}, round(ratio, 6) AS ratio, round({guard('avg', 'ratio', 30)}, 6) AS band_mid, round({guard('avg', 'ratio', 30)} - {guard('stddev_samp', 'ratio', 30)}, 6) AS band_low, round({guard('avg', 'ratio', 30)} + {guard('stddev_samp', 'ratio', 30)}, 6) AS band_high FROM raw"),
        "halo_zscore": _with(BASE, f"SELECT series_id, {DAY}, row_number() {W} - 1 AS bar_idx, round(ratio_zscore_90, 6) AS z90 FROM feat"),
        "feature_frame": _with(
            PLAIN + f", num AS (SELECT *, row_number() {W} AS i FROM raw)",
            "SELECT series_id, max(n1) AS n_single, max(f1) AS n_single_from, max(n2) AS n_staged, max(f2) AS n_staged_from FROM (SELECT series_id, count(*) AS n1, min(strftime(ts, '%Y-%m-%d')) AS f1, NULL AS n2, NULL AS f2 FROM frame GROUP BY 1 UNION ALL SELECT series_id, NULL, NULL, count(*), min(strftime(ts, '%Y-%m-%d')) FROM frame WHERE bar_idx >= 79 GROUP BY 1) GROUP BY 1",
        ),
        "rule_signal": _with(PLAIN, f"SELECT series_id, {DAY}, signal, {r('ratio_zscore_30', 'ratio_slope')} FROM frame"),
        "position_size": _with(PLAIN, f"SELECT series_id, {DAY}, {r('size')} FROM sized"),
        "backtest_curve": _with(PLAIN + ", " + folds("sized", "series_id"), f"SELECT series_id, {DAY}, signal, CAST(switched AS BIGINT) AS switched, {r('daily_return', 'capital', 'drawdown')} FROM dd"),
        "hmm_round": _em(),
        "hmm_path": _path(),
        "boosted_stumps": _stumps(),
        "long_averages": _with(
            f"""{BARS}, {RAW}, num AS (SELECT *, row_number() {W} - 1 AS i FROM raw),
ema AS (SELECT series_id, i, ts, ratio AS e10, ratio AS e99, ratio AS e199 FROM num WHERE i = 0
  UNION ALL SELECT n.series_id, n.i, n.ts, e10 + (n.ratio - e10) * {2 / 11!r}, e99 + (n.ratio - e99) * {2 / 100!r}, e199 + (n.ratio - e199) * {2 / 200!r} FROM ema e JOIN num n ON n.series_id = e.series_id AND n.i = e.i + 1)""",
            f"SELECT series_id, {DAY}, round(e10, 4) AS ema_10, round(e99, 4) AS ema_99, round(e199, 4) AS ema_199 FROM ema",
        ),
        "long_walk_forward": f"SELECT * FROM ({_with(WALK + ', ' + SPANS.replace('@', 'window_idx'), _KINDS.format(kind='rolling', number='window_idx', ic='ic_composite', metrics=r(*METRICS)) + ' LEFT JOIN ic USING (series_id, window_idx)')}) UNION ALL "
        f"SELECT * FROM ({_with(_anchored() + ', ' + SPANS.replace('@', 'fold'), _KINDS.format(kind='anchored', number='fold', ic='CAST(NULL AS DOUBLE)', metrics=r(*METRICS)) + ' WHERE n_bars >= 10')})",
        "backtest_columns": _with(PLAIN + ", " + folds("sized", "series_id"), f"SELECT s.series_id, strftime(s.ts, '%Y-%m-%d') AS day, round(s.ratio, 6) AS ratio, round(capital, 6) AS capital, CASE WHEN round(daily_return, 6) = 0 THEN 0.0 ELSE round(daily_return, 6) END AS daily_return FROM sized s LEFT JOIN bt USING (series_id, ts)"),
        "backtest_metrics": _with(PLAIN + ", " + folds("sized", "series_id"), f"SELECT series_id, {r(*METRICS, 'final_capital')}, round(final_capital - 1, 6) AS total_return, n_turns FROM met"),
        "cost_sweep": _with(
            PLAIN + ", priced AS (SELECT * FROM sized, (VALUES " + ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE)" for a, b in COSTS) + ") c(spread, slippage)), " + folds("priced", "series_id, spread, slippage", "spread + slippage"),
            f"SELECT series_id, {r('spread', 'slippage', *METRICS, 'final_capital')}, n_turns FROM met",
        ),
        "wf_anchored": _with(_anchored() + ", " + SPANS.replace("@", "fold"), f"SELECT series_id, fold, n_bars, strftime(first_ts, '%Y-%m-%d') AS first_day, strftime(last_ts, '%Y-%m-%d') AS last_day, {r(*METRICS)} FROM span JOIN met USING (series_id, fold) WHERE n_bars >= 10"),
        "wf_anchored_means": _with(_anchored(), f"SELECT series_id, count(*) AS n_folds, {', '.join(f'round(avg({m}), 6) AS {m}' for m in METRICS)} FROM met GROUP BY 1"),
        "wf_rolling": _with(
            FULL + ", " + windows("strategy") + ", " + folds("wins", "series_id, window_idx") + ", " + ics(IC_SIGNALS) + ", " + SPANS.replace("@", "window_idx"),
            f"SELECT series_id, window_idx, n_bars, strftime(first_ts, '%Y-%m-%d') AS first_day, strftime(last_ts, '%Y-%m-%d') AS last_day, {r(*METRICS, *[f'ic_{s}' for s in IC_SIGNALS], 'ic_composite')} FROM span JOIN met USING (series_id, window_idx) LEFT JOIN ic USING (series_id, window_idx)",
        ),
        "wf_summary": _with(
            WALK + ", cols AS (" + " UNION ALL ".join(f"SELECT series_id, '{m}' AS metric, {m} AS v FROM met LEFT JOIN ic USING (series_id, window_idx)" for m in [*METRICS, "ic_composite"]) + ")",
            "SELECT series_id, metric, round(round(avg(v), 4), 3) AS mean, round(round(stddev_samp(v), 4), 3) AS std, round(round(min(v), 4), 3) AS min, round(round(max(v), 4), 3) AS max, CASE WHEN metric IN ('sharpe', 'ic_composite') THEN round(round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 4), 3) END AS pct_positive_windows FROM cols GROUP BY series_id, metric",
        ),
        "ic_by_window": _with(PLAIN + ", " + windows("sized") + ", " + ics(["ratio_zscore_30", "ratio_slope"]), f"SELECT series_id, window_idx, {r('ic_ratio_zscore_30', 'ic_ratio_slope', 'ic_composite')} FROM ic"),
        "ic_stats": _with(WALK, "SELECT series_id, round(avg(ic_composite), 5) AS ic_mean, round(stddev_samp(ic_composite), 5) AS ic_std, round(min(ic_composite), 5) AS ic_min, round(max(ic_composite), 5) AS ic_max, round(avg(sharpe), 5) AS mean_sharpe, round(avg(hit_rate), 5) AS mean_hit_rate, count(*) AS n_windows FROM met LEFT JOIN ic USING (series_id, window_idx) GROUP BY 1"),
        "alpha_decay": _with(WALK, f"SELECT series_id, window_idx, round(ic_composite, 5) AS ic_composite, round(ic_composite / nullif(abs(first_value(ic_composite) OVER (PARTITION BY series_id ORDER BY window_idx)), 0), 5) AS normalized_alpha, {r('sharpe', 'hit_rate', places=5)} FROM met LEFT JOIN ic USING (series_id, window_idx)"),
        "decay_fit": _with(WALK + ", " + _decay(), f"SELECT series_id, {_FITTED}, sse, fit_success FROM fitted"),
        "whole_analysis": _with(
            PLAIN + ", " + _anchored_rows("anch") + ", " + windows("sized") + ", " + folds("wins", "series_id, window_idx") + ", " + ics(["z30"]) + ", " + _decay() + ", folded AS (SELECT series_id, count(*) AS r, count(DISTINCT fold) AS f FROM anch GROUP BY 1)",
            f"SELECT series_id, {_FITTED}, fit_success, n_windows AS n_folds, n_windows AS n_decay_curve, 6 AS n_summary, f AS n_anchored, r - f AS n_anchored_curve FROM fitted JOIN folded USING (series_id)",
        ),
        "long_series": _with(BASE + ", " + EMA, f"SELECT series_id, {DAY}, {r('ratio_zscore_30', 'ratio_zscore_90', 'ratio_ema_slope', 'a_macd_hist', 'a_vol_60', 'b_atr_pct', places=4)} FROM emas WHERE ratio_zscore_90 IS NOT NULL"),
        "window_sweep": "SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(_with(PLAIN + ", " + windows("sized", size, step) + ", " + folds("wins", "series_id, window_idx"), f"SELECT series_id, {size} AS window, {step} AS step, count(*) AS n_windows, {', '.join(f'round(avg({m}), 5) AS {m}' for m in METRICS)} FROM met GROUP BY 1") for size, step in WINDOWS) + ")",
        "given_returns": _with(
            PLAIN + f""", g AS (SELECT series_id, ts, ratio / lag(ratio) {W} - 1 AS gain, CASE WHEN signal <> lag(signal) {W} THEN 1 ELSE 0 END AS switched FROM sized),
bt AS (SELECT *, product(1 + daily_return) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS capital FROM (SELECT *, gain - switched * 0.0003 AS daily_return FROM g WHERE gain IS NOT NULL)), """
            + measured("series_id"),
            f"SELECT series_id, {r(*METRICS, 'final_capital')}, n_turns FROM met",
        ),
        "anchored_curve": _with(_anchored(), f"SELECT series_id, fold, {DAY}, {r('daily_return', 'capital')} FROM bt"),
        "signal_counts": _with(FULL, "SELECT series_id, count(*) AS n_rows, count(CASE WHEN mr_signal IS NOT NULL AND mom_signal IS NOT NULL AND bo_signal IS NOT NULL THEN 1 END) AS n_all, count(mr_signal) AS n_mr_signal, count(mom_signal) AS n_mom_signal, count(bo_signal) AS n_bo_signal FROM strategy GROUP BY 1"),
        "garch_coarse": _with(_garch(0), "SELECT series_id, leg, round(alpha, 4) AS alpha, round(beta, 4) AS beta, round(ll, 4) AS ll FROM best0"),
        "garch_fitted": _with(_garch(2), "SELECT series_id, leg, round(alpha, 5) AS alpha, round(beta, 5) AS beta, round(ll, 3) AS ll FROM best2"),
        "garch_vol": _with(
            _garch(2)
            + ", "
            + _variances("won", "(SELECT series_id, leg, alpha, beta FROM best2)")
            + ", vol AS (SELECT series_id, ts, max(CASE WHEN leg = 'a_ret_1' THEN sqrt(variance) / 100 END) AS a, max(CASE WHEN leg = 'b_ret_1' THEN sqrt(variance) / 100 END) AS b FROM won GROUP BY ALL)",
            f"SELECT r.series_id, strftime(r.ts, '%Y-%m-%d') AS day, round(a, 6) AS a_garch_vol, round(b, 6) AS b_garch_vol, round(b / a, 6) AS garch_vol_ratio FROM raw r LEFT JOIN vol v ON v.series_id = r.series_id AND v.ts = r.ts",
        ),
        "hmm_holds": _with(PLAIN, "SELECT series_id, count(*) AS n_labelled, true AS one_name, true AS crisis_moves, true AS few_states FROM frame GROUP BY 1"),
        "missing_regimes": _regimes(f"SELECT series_id, {DAY}, regime, CAST({_weight(0.7, 0.4, 1.2, 1.5)} AS DOUBLE) AS weight, CASE regime WHEN 'crisis' THEN 0::DOUBLE WHEN 'risk_on' THEN 2::DOUBLE WHEN 'trending' THEN 3::DOUBLE ELSE 1::DOUBLE END AS code FROM reg"),
        "versioned_stages": _with(f"{BARS}, {RAW}", f"SELECT series_id, {DAY}, {r('ratio')}, {r('slope')} FROM (SELECT *, ratio - lag(ratio, 5) {W} AS slope FROM raw)"),
        "stream_latest": _with(BARS, f"SELECT series_id, {DAY}, {r('a_close', 'b_close')} FROM bars QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) = 1"),
        "garch_gain": _with(f"{BARS}, {RAW}", "SELECT series_id, leg, round(var_pop(x * 100), 6) AS target, true AS holds FROM (SELECT series_id, 'a_ret_1' AS leg, a_ret_1 AS x FROM raw UNION ALL SELECT series_id, 'b_ret_1', b_ret_1 FROM raw) GROUP BY 1, 2"),
        "shap_sums": _with(FULL, f"SELECT series_id, {DAY}, true AS adds_up, true AS in_range FROM strategy WHERE mom_signal IS NOT NULL AND bo_confidence IS NOT NULL"),
        "strategy_signals": _with(FULL, f"SELECT series_id, {DAY}, regime, {r(*[f'{p}_{k}' for p in ('mr', 'mom', 'bo') for k in ('signal', 'confidence')])} FROM strategy"),
        "sub_signal_latest": _with(
            FULL + ", last AS (SELECT * FROM strategy QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) = 1)",
            "SELECT series_id, day, model, round(s, 6) AS signal, CASE WHEN s > 0.1 THEN 'BUY_B' WHEN s < -0.1 THEN 'BUY_A' ELSE 'HOLD' END AS direction, round(c, 6) AS confidence FROM (" + " UNION ALL ".join(f"SELECT series_id, {DAY}, '{m}' AS model, {p}_signal AS s, {p}_confidence AS c FROM last" for p, m in (("mr", "Mean Reversion"), ("mom", "Momentum"), ("bo", "Breakout"))) + ")",
        ),
        "latest_rows": _with(PLAIN, f"SELECT series_id, {DAY}, {r('ratio', 'ratio_zscore_30')} FROM frame QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 5"),
    }
    label = ", lab AS (SELECT *, CASE WHEN fwd > threshold THEN 0 WHEN fwd < -threshold THEN 2 ELSE 1 END AS label, CASE WHEN z30 > 1 THEN 2 WHEN z30 < -1 THEN 0 ELSE 1 END AS predicted, bar_idx < floor(n * 0.8) AS is_train FROM (SELECT *, stddev_samp(fwd) OVER (PARTITION BY series_id) * 0.3 AS threshold FROM sized))"
    rows |= {
        "target_labels": _with(PLAIN + label, f"SELECT series_id, {DAY}, {r('fwd', 'threshold')}, CAST(label AS BIGINT) AS label FROM lab"),
        "class_distribution": _with(PLAIN + label, "SELECT series_id, CAST(label AS BIGINT) AS label, count(*) AS n, ['BUY_A', 'HOLD', 'BUY_B'][label + 1] AS class_name FROM lab GROUP BY series_id, label"),
        "accuracy_by_class": _with(PLAIN + label, "SELECT series_id, CAST(label AS BIGINT) AS label, round(avg(CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM lab WHERE NOT is_train AND label IS NOT NULL GROUP BY GROUPING SETS ((series_id), (series_id, label))"),
        "train_test_split": _with(PLAIN + label, "SELECT series_id, is_train, count(*) AS n, min(strftime(ts, '%Y-%m-%d')) AS first_day, max(strftime(ts, '%Y-%m-%d')) AS last_day FROM lab GROUP BY 1, 2"),
        "regime_stats": _regimes("SELECT series_id, regime, count(*) AS days, round(count(*) / max(n), 6) AS share, round(avg(ratio), 6) AS mean_ratio, round(avg(a_vol_20), 6) AS mean_vol FROM (SELECT *, CAST(count(*) OVER (PARTITION BY series_id) AS DOUBLE) AS n FROM reg) WHERE regime IS NOT NULL GROUP BY 1, 2"),
        "regime_share": _regimes(f"SELECT series_id, {DAY}, " + ", ".join(f"round({guard('avg', 'x_' + k, 30, 5)}, 6) AS share_{k}" for k in ("crisis", "range_bound", "risk_on", "trending")) + " FROM (SELECT *, " + ", ".join(f"CASE WHEN regime = '{k}' THEN 1.0 ELSE 0.0 END AS x_{k}" for k in ("crisis", "range_bound", "risk_on", "trending")) + " FROM reg)"),
        "regime_transitions": _regimes(
            "SELECT a.series_id, a.regime AS from_regime, b.regime AS to_regime, count(k.ts) AS n, round(coalesce(count(k.ts) / nullif(CAST((SELECT count(*) FROM known q WHERE q.series_id = a.series_id AND q.regime = a.regime AND q.nxt IS NOT NULL) AS DOUBLE), 0), 0), 6) AS probability FROM seen a JOIN seen b USING (series_id) LEFT JOIN known k ON k.series_id = a.series_id AND k.regime = a.regime AND k.nxt = b.regime GROUP BY 1, 2, 3",
            f", known AS (SELECT *, lead(regime) {W} AS nxt FROM reg WHERE regime IS NOT NULL), seen AS (SELECT DISTINCT series_id, regime FROM known)",
        ),
        "regime_bands": _regimes(
            "SELECT series_id, regime, n_bars, strftime(s, '%Y-%m-%d') AS start_day, strftime(e, '%Y-%m-%d') AS end_day FROM ended WHERE regime IS NOT NULL",
            f", isl AS (SELECT *, row_number() {W} - row_number() OVER (PARTITION BY series_id, regime ORDER BY ts) AS g FROM reg), bands AS (SELECT series_id, regime, g, min(ts) AS s, max(ts) AS l, count(*) AS n_bars FROM isl GROUP BY ALL), ended AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY series_id ORDER BY s), l) AS e FROM bands)",
        ),
    }
    shown = ["ratio_zscore_30", "ratio_zscore_90", "ratio_slope", "a_ret_5", "b_ret_5", "a_vol_20", "vol_ratio"]
    contributions = lambda t: " UNION ALL ".join(f"SELECT series_id, '{c}' AS feature, {c} AS value FROM {t}" for c in shown)
    rows |= {
        "top_columns": _with(PLAIN, f"SELECT feature, round(avg(abs(value)), 6) AS importance FROM ({contributions('frame')}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
        "latest_columns": _with(PLAIN + ", last AS (SELECT * FROM frame QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) = 1)", f"SELECT series_id, feature, round(value, 6) AS value, place FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(value) DESC, feature) AS place FROM ({contributions('last')})) WHERE place <= 4"),
        "whole_pipeline": _with(PLAIN + ", " + folds("sized", "series_id"), f"SELECT series_id, {r(*METRICS, 'final_capital')}, n_turns FROM met"),
        "whole_pipeline_models": _with(PLAIN + ", " + folds("sized", "series_id") + ", cnt AS (SELECT series_id, count(*) AS k FROM sized GROUP BY 1)", f"SELECT series_id, {r(*METRICS, 'final_capital')}, n_turns, k AS n_regimes, k - 1 AS n_returns, true AS predicted FROM met JOIN cnt USING (series_id)"),
        "stream_bars": """WITH t AS (SELECT * FROM events WHERE event_type IN ('click', 'view')), b AS (SELECT date_trunc('hour', ts) AS w, max(CASE WHEN event_type = 'click' THEN {'at': ts, 'v': value} END).v AS a_close, max(CASE WHEN event_type = 'view' THEN {'at': ts, 'v': value} END).v AS b_close FROM t GROUP BY 1)
SELECT 'click/view' AS series_id, strftime(w, '%Y-%m-%d %H:%M') AS hour, round(a_close, 6) AS a_close, round(b_close, 6) AS b_close FROM b WHERE a_close IS NOT NULL AND b_close IS NOT NULL AND w + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM t)""",
        "stream_features": _with(
            BASE + ", " + EMA,
            f"SELECT series_id, {DAY}, round(ratio, 6) AS ratio, round(ratio_ema_slope, 6) AS ema_slope, round(ratio_zscore_30, 6) AS zscore_30, round(ratio_zscore_90, 6) AS zscore_90, {RULE} AS signal FROM emas",
        ),
    }
    return rows | {"long_backtest": rows["backtest_curve"], "pair_universe_blocks": rows["pair_universe"]}
