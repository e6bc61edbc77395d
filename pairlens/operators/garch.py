"""GARCH(1,1) volatility with a constant mean: variance targeting on a grid of (alpha, beta), then finer grids; then, if asked for, the likelihood over all four parameters.

Candidates are rows beside the returns; a candidate's variances are a linear recurrence with decay beta, and the likelihood is one sum. So are its derivatives: each
is a recurrence with the same decay, and a scoring step (Gauss-Newton) for all series is one aggregation and a 4 x 4 system a series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEY, TS
from ..sources.shared import staged
from .recurrence import Recurrence, linear_recurrence

COARSE = [(a, b) for a in (0.02, 0.05, 0.1, 0.2, 0.3) for b in (0.3, 0.5, 0.7, 0.8, 0.9, 0.95) if a + b < 0.999]
LEAST_BETA, MOST_BETA = 0.2, 0.98


def _variances(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Adds variance, from e (return less mean), target (mean square), alpha and beta (and shift and omega, where they are free): starts at the target."""
    w, free = Window.partitionBy(*keys).orderBy(TS), "omega" in rows.columns
    u = F.col("e") - F.col("shift") if free else F.col("e")
    before = F.lag(u * u).over(w)
    omega = F.col("omega") if free else (1 - F.col("alpha") - F.col("beta")) * F.col("target")
    drive = F.when(before.isNull(), F.col("target")).otherwise(omega + F.col("alpha") * before)
    out = linear_recurrence(rows.withColumn("__drive", drive), [Recurrence("variance", "beta", "__drive", LEAST_BETA, MOST_BETA)], keys)
    return out.drop("__drive")


def centred(df: DataFrame, columns: list[str]) -> DataFrame:
    """(series_id, leg, ts, e, target): returns in percent less their mean, a leg for each column; legs without variance go."""
    legs = F.array(*[F.struct(F.lit(c).alias("leg"), (F.col(c) * 100).alias("r")) for c in columns])
    everything = Window.partitionBy(KEY, "leg")
    rows = df.select(KEY, TS, F.inline(legs)).where(F.col("r").isNotNull())
    rows = rows.withColumn("e", F.col("r") - F.avg("r").over(everything))
    return rows.withColumn("target", F.avg(F.col("e") * F.col("e")).over(everything)).where("target > 0").select(KEY, "leg", TS, "e", "target")


def _best(rows: DataFrame) -> DataFrame:
    """The likeliest (alpha, beta) of each series and leg among its candidates."""
    v = _variances(rows, (KEY, "leg", "alpha", "beta"))
    ll = F.sum(-0.5 * (F.log("variance") + F.col("e") * F.col("e") / F.col("variance")))
    fits = v.groupBy(KEY, "leg", "alpha", "beta").agg(ll.alias("ll"), F.first("target").alias("target"))
    return fits.groupBy(KEY, "leg").agg(F.max(F.struct("ll", "alpha", "beta", "target")).alias("f")).select(KEY, "leg", "f.*")


def fit_legs(rows: DataFrame, refinements: int = 2) -> DataFrame:
    """(series_id, leg, ll, alpha, beta, target) from centred rows: the best of the grid, then of finer grids around it."""
    grid = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for a, b in COARSE])
    found = _best(rows.select("*", F.inline(grid)))
    for k in range(refinements):
        shrink = 0.35**k
        near = F.array(*[F.struct(F.lit(x**shrink).alias("fa"), F.lit(y * shrink).alias("fb")) for x in (0.6, 0.8, 1.0, 1.3, 1.6) for y in (-0.06, -0.03, 0.0, 0.03, 0.06)])
        beta = F.round(F.least(F.greatest(F.col("beta") + F.col("fb"), F.lit(LEAST_BETA)), F.lit(MOST_BETA)), 6)
        tried = found.select(KEY, "leg", "alpha", "beta", F.inline(near)).select(KEY, "leg", F.round(F.col("alpha") * F.col("fa"), 6).alias("alpha"), beta.alias("beta"))
        # few rows a series: made distinct before they meet the returns
        found = _best(rows.join(tried.where("alpha + beta < 0.999").distinct(), [KEY, "leg"]))
    return found


PARAMETERS = ["shift", "omega", "alpha", "beta"]
#: Lengths of a scoring step that are tried together.
REACH = (1.0, 0.5, 0.25, 0.06, 0.0)


def _scored(rows: DataFrame, tried: DataFrame) -> DataFrame:
    """(series_id, leg, PARAMETERS, ll, g, h): log likelihood, gradient and expected information of each candidate, one aggregation."""
    keys = (KEY, "leg", "try")
    w = Window.partitionBy(*keys).orderBy(TS)
    df = rows.join(tried, [KEY, "leg"]).withColumn("u", F.col("e") - F.col("shift"))
    square = F.lag(F.col("u") * F.col("u")).over(w)
    df = df.withColumn("__drive", F.when(square.isNull(), F.col("target")).otherwise(F.col("omega") + F.col("alpha") * square))
    df = linear_recurrence(df, [Recurrence("v", "beta", "__drive", LEAST_BETA, MOST_BETA)], keys)
    # the first variance is given: it moves with no parameter
    began = square.isNotNull()
    drives = {"shift": -2 * F.col("alpha") * F.lag("u").over(w), "omega": F.when(began, 1.0), "alpha": square, "beta": F.lag("v").over(w)}
    df = df.withColumns({f"__in_{p}": c for p, c in drives.items()})
    df = linear_recurrence(df, [Recurrence(f"d_{p}", "beta", f"__in_{p}", LEAST_BETA, MOST_BETA) for p in PARAMETERS], keys)
    v, u = F.col("v"), F.col("u")
    d = [F.col(f"d_{p}") for p in PARAMETERS]
    g = [F.sum(0.5 * (u * u / v - 1) / v * x + (u / v if p == "shift" else 0.0)) for p, x in zip(PARAMETERS, d, strict=True)]
    h = [F.sum(0.5 * x * y / (v * v) + (1 / v if p == q == "shift" else 0.0)) for p, x in zip(PARAMETERS, d, strict=True) for q, y in zip(PARAMETERS, d, strict=True)]
    return df.groupBy(*keys, *PARAMETERS).agg(F.sum(-0.5 * (F.log(v) + u * u / v)).alias("ll"), F.array(*g).alias("g"), F.array(*h).alias("h"))


def _next(kept: DataFrame) -> DataFrame:
    """The candidates along each series' scoring step, within what is allowed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                now, h = np.array([getattr(r, p) for p in PARAMETERS]), np.reshape(r.h, (4, 4))
                scale = np.sqrt(np.maximum(np.diag(h), 1e-12))
                step = np.linalg.solve(h / np.outer(scale, scale) + 1e-9 * np.eye(4), np.array(r.g) / scale) / scale
                for k, far in enumerate(REACH):
                    m, omega, alpha, beta = now + far * step
                    beta = min(max(beta, LEAST_BETA), MOST_BETA)
                    alpha = min(max(alpha, 1e-6), 0.9989 - beta)
                    out.append((getattr(r, KEY), r.leg, k, m, max(omega, 1e-9), alpha, beta))
            yield pd.DataFrame(out, columns=[KEY, "leg", "try", *PARAMETERS])

    return kept.select(KEY, "leg", *PARAMETERS, "g", "h").mapInPandas(run, f"{KEY} string, leg string, try int, " + ", ".join(f"{p} double" for p in PARAMETERS))


def likelihood_fit(rows: DataFrame, start: DataFrame | None = None, steps: int = 8) -> DataFrame:
    """(series_id, leg, shift, omega, alpha, beta, ll) from centred rows: shift moves the mean. start are fits of the grids, whose likelihood is never lost."""
    start = fit_legs(rows) if start is None else start
    tried = start.select(KEY, "leg", F.lit(0).alias("try"), F.lit(0.0).alias("shift"), ((1 - F.col("alpha") - F.col("beta")) * F.col("target")).alias("omega"), "alpha", "beta")
    for k in range(steps + 1):
        scored = _scored(rows, tried)
        names = [*PARAMETERS, "ll", "g", "h"]
        kept = staged(scored.groupBy(KEY, "leg").agg(F.max_by(F.struct(*names), "ll").alias("f")).select(KEY, "leg", "f.*"), "scored")
        if k < steps:
            tried = _next(kept)
    return kept.drop("g", "h")


def garch_fit(df: DataFrame, column: str, refinements: int = 2) -> DataFrame:
    """(series_id, alpha, beta, target, log_likelihood): the best of the grid for each series."""
    return fit_legs(centred(df, [column]), refinements).drop("leg").withColumnRenamed("ll", "log_likelihood")


def with_garch(df: DataFrame, refinements: int = 2, steps: int = 0) -> DataFrame:
    """steps: scoring steps over all four parameters after the grids (0: none). Adds a_garch_vol, b_garch_vol (roots of the fitted variances, in units of the returns) and their ratio (b over a), beside the frame."""
    rows = staged(centred(df, ["a_ret_1", "b_ret_1"]), "returns")
    fit = fit_legs(rows, refinements)
    fit = likelihood_fit(rows, fit, steps).drop("ll") if steps else fit.select(KEY, "leg", "alpha", "beta")
    vol = _variances(rows.join(fit, [KEY, "leg"]), (KEY, "leg")).groupBy(KEY, TS).agg(*[F.max(F.when(F.col("leg") == f"{leg}_ret_1", F.sqrt("variance") / 100)).alias(f"{leg}_garch_vol") for leg in "ab"])
    return df.join(vol, [KEY, TS], "left").withColumn("garch_vol_ratio", F.try_divide("b_garch_vol", "a_garch_vol"))
