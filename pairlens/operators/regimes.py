"""Regimes: hidden Markov and mixture models over standardised features, their names, and what is counted about them.

A hidden Markov model is fitted over blocks of at most ``block_rows`` rows of a series. A block's rows are one product of k x k matrices, so
messages come in two steps: the products of each task's blocks side by side, their running products along each series (k * k numbers a task), then
all rows of the blocks side by side, for all restarts in one pass. A long series is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import KEY, TS, over_series, require_columns
from ..sources.shared import staged
from .features import long_bar_index

FEATURES = ["ratio_zscore_30", "ratio_slope", "vol_ratio", "a_ema_slope", "b_ema_slope", "ratio_ema_slope", "a_macd_hist", "rel_strength_20", "a_atr_pct", "a_cond_vol", "cond_vol_ratio"]
#: Names a row of a staged frame, so that labels come back to the row they are of, whatever times repeat.
ROW = "__row"
REGIMES = ["crisis", "range_bound", "risk_on", "trending"]


def rule_regime(df: DataFrame) -> DataFrame:
    """A regime from fixed thresholds on the 30-row score; NULL without one."""
    z = F.col("ratio_zscore_30")
    return df.withColumn("regime", F.when(z > 1.5, "crisis").when(F.abs(z) < 0.3, "range_bound").when(z < -1, "risk_on").when(z.isNotNull(), "trending"))


@dataclass
class HiddenMarkov:
    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    start: np.ndarray
    move: np.ndarray
    centre: np.ndarray
    covariance: np.ndarray
    log_likelihood: float = -np.inf
    rounds: int = 0
    converged: bool = False

    def log_density(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.centre)))
        for k, (m, c) in enumerate(zip(self.centre, self.covariance, strict=True)):
            half = np.linalg.cholesky(c)
            z = np.linalg.solve(half, (x - m).T)
            out[:, k] = -0.5 * (z**2).sum(0) - np.log(np.diag(half)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
        return out

    def state_means(self) -> np.ndarray:
        return self.centre * self.scale + self.mean


class Joint:
    """Models of one size side by side, as arrays: one pass over rows serves all of them.

    Rows lie in pieces of ``length``; a step takes one row of each piece of each model. Arrays of rows are (place in the piece, model, piece, state).
    """

    def __init__(self, models: list[HiddenMarkov], length: int = 64):
        centre, covariance = np.stack([m.centre for m in models]), np.stack([m.covariance for m in models])
        self.length, self.start, self.move = length, np.stack([m.start for m in models]), np.stack([m.move for m in models])
        r, k, d = centre.shape
        half = np.linalg.inv(np.linalg.cholesky(covariance))
        self.half, self.shift = half.reshape(r, k * d, d), np.einsum("rkij,rkj->rki", half, centre)
        self.level = np.log(np.diagonal(half, axis1=2, axis2=3)).sum(2) - 0.5 * d * np.log(2 * np.pi)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """(model, state, row)."""
        r, k, d = self.shift.shape
        flat, out = np.ascontiguousarray(x.T), np.empty((r, k, len(x)))
        for m in range(r):
            z = (self.half[m] @ flat).reshape(k, d, -1) - self.shift[m][:, :, None]
            out[m] = self.level[m][:, None] - 0.5 * np.einsum("kdn,kdn->kn", z, z)
        return out

    def prepared(self, x: np.ndarray, first: bool) -> Prepared:
        density = self.log_density(x)
        r, k, n = density.shape
        top, pieces = density.max(1), -(-n // self.length)
        b = np.ones((r, k, pieces * self.length))
        b[:, :, :n] = np.exp(density - top[:, None])
        b = np.ascontiguousarray(b.reshape(r, k, pieces, self.length).transpose(3, 0, 2, 1))
        used = n - (pieces - 1) * self.length  # rows of the last piece
        # products of each piece's matrices move * b, as (model, state before it, piece, state at its end)
        a = np.broadcast_to(self.move[:, :, None, :], (r, k, pieces, k)) * b[0][:, None]
        if first:
            a[:, :, 0] = np.eye(k) * b[0][:, None, 0]
        for t in range(1, self.length):
            now = (a.reshape(r, k * pieces, k) @ self.move).reshape(r, k, pieces, k) * b[t][:, None]
            if t >= used:
                now[:, :, -1] = a[:, :, -1]
            a = now
            if t % 8 == 7:
                a /= np.maximum(a.max((1, 3), keepdims=True), 1e-300)
        m = np.ascontiguousarray(a.transpose(2, 0, 1, 3))
        total = m[0] / _norm(m[0])
        for s in range(1, pieces):
            total = total @ m[s]
            total /= _norm(total)
        return Prepared(first, n, used, b, top.sum(1), m, total)

    def expectation(self, p: Prepared, incoming: np.ndarray, outgoing: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood, state probabilities (model, row, state) and expected moves of a block, from the messages (model, state) that reach it from both sides."""
        pieces, r, k = p.pieces.shape[:3]
        carry, back = np.empty((pieces, r, k)), np.empty((pieces, r, k))
        carry[0], back[-1] = incoming / incoming.sum(1, keepdims=True), outgoing / outgoing.max(1, keepdims=True)
        for s in range(1, pieces):
            now = (carry[s - 1][:, None] @ p.pieces[s - 1])[:, 0]
            carry[s] = now / now.sum(1, keepdims=True)
        for s in range(pieces - 1, 0, -1):
            now = (p.pieces[s] @ back[s][:, :, None])[:, :, 0]
            back[s - 1] = now / now.max(1, keepdims=True)
        b, one = p.b, np.ones((k, 1))
        before, forward, behind, weight = np.empty_like(b), np.empty_like(b), np.empty_like(b), np.empty((*b.shape[:3], 1))
        before[0] = carry.transpose(1, 0, 2)
        for t in range(self.length):
            now = before[t] @ self.move
            if t == 0 and p.first:
                now[:, 0] = before[0, :, 0]
            now *= b[t]
            weight[t] = now @ one
            forward[t] = now / weight[t]
            if t + 1 < self.length:
                before[t + 1] = forward[t]
        behind[-1], turned = back.transpose(1, 0, 2), np.ascontiguousarray(self.move.transpose(0, 2, 1))
        for t in range(self.length - 1, 0, -1):
            now = (behind[t] * b[t]) @ turned
            now /= now @ one
            if t >= p.used:
                now[:, -1] = behind[t][:, -1]
            behind[t - 1] = now
        rows = lambda v: v.transpose(1, 2, 0, 3).reshape(r, pieces * self.length, -1)[:, : p.n]
        g = rows(forward * behind)
        mass = g @ one
        onward = rows(b * behind) / (rows(weight) * mass)
        out = slice(1 if p.first else 0, None)
        moves = self.move * (rows(before)[:, out].transpose(0, 2, 1) @ onward[:, out])
        return np.log(rows(weight)).sum((1, 2)) + p.log_top, g / mass, moves

    def run(self, blocks: list[np.ndarray], first: bool, incoming: np.ndarray | None, outgoing: np.ndarray | None) -> Iterator[tuple]:
        """(x, whether it is a series' first, log likelihood, state probabilities, expected moves) of each of a series' blocks that follow each other."""
        made = [self.prepared(x, first and at == 0) for at, x in enumerate(blocks)]
        ahead = [np.ones_like(self.start) if outgoing is None else outgoing]
        for p in made[:0:-1]:
            now = (p.total @ ahead[-1][:, :, None])[:, :, 0]
            ahead.append(now / now.max(1, keepdims=True))
        incoming = self.start if incoming is None else incoming
        for x, p, after in zip(blocks, made, ahead[::-1], strict=True):
            yield x, p.first, *self.expectation(p, incoming, after)
            now = (incoming[:, None] @ p.total)[:, 0]
            incoming = now / now.sum(1, keepdims=True)


@dataclass
class Prepared:
    """A block's rows as Joint needs them: emissions b up to factors whose logarithms sum to log_top, products of its pieces (piece, model, state, state) and over all of it."""

    first: bool
    n: int
    used: int
    b: np.ndarray
    log_top: np.ndarray
    pieces: np.ndarray
    total: np.ndarray


def _norm(p: np.ndarray) -> np.ndarray:
    return np.maximum(p.max(axis=(-1, -2), keepdims=True), 1e-300)


def transfer(model: HiddenMarkov, x: np.ndarray, first: bool) -> np.ndarray:
    """The product over a whole block, up to a factor."""
    return Joint([model]).prepared(x, first).total[0]


def expectation(model: HiddenMarkov, x: np.ndarray, first: bool = True, incoming: np.ndarray | None = None, outgoing: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, state probabilities of each row and expected moves of a block, from the messages that reach it from both sides."""
    joint = Joint([model])
    ll, g, moves = joint.expectation(joint.prepared(x, first), joint.start if incoming is None else incoming[None], np.ones_like(joint.start) if outgoing is None else outgoing[None])
    return float(ll[0]), g[0], moves[0]


def squares(x: np.ndarray) -> np.ndarray:
    """Each row's 1, values and products of two values (i <= j): what weighted sums give counts, means and covariances of."""
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([np.ones((len(x), 1)), x, x[:, i] * x[:, j]], 1)


def moments(sums: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mass, first, second) from weighted sums (..., 1 + d + d (d + 1) / 2) of squares."""
    i, j = np.triu_indices(d)
    second = np.empty((*sums.shape[:-1], d, d))
    second[..., i, j] = second[..., j, i] = sums[..., 1 + d :]
    return sums[..., 0], sums[..., 1 : 1 + d], second


def best_scores(model: HiddenMarkov, x: np.ndarray, first: bool) -> np.ndarray:
    """The best log score of a path through the block from each state before it to each state at its end."""
    d, move = model.log_density(x), np.log(model.move + 1e-300)
    k = len(d[0])
    v = np.where(np.eye(k) > 0, d[0][None], -np.inf) if first else move + d[0][None]
    for row in d[1:]:
        v = (v[:, :, None] + move[None]).max(1) + row[None]
    return v


def path_between(model: HiddenMarkov, x: np.ndarray, first: bool, before: int, end: int) -> np.ndarray:
    """The likeliest states of a block between the state before it and its last state."""
    d, move = model.log_density(x), np.log(model.move + 1e-300)
    came = np.zeros(d.shape, int)
    score = (np.where(np.arange(d.shape[1]) == before, 0.0, -np.inf) if first else move[before]) + d[0]
    for t in range(1, len(d)):
        every = score[:, None] + move
        came[t] = every.argmax(0)
        score = every.max(0) + d[t]
    path = np.empty(len(d), int)
    path[-1] = end
    for t in range(len(d) - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path


def standard(df: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations, one aggregation."""
    r = df.agg(*[F.avg(c) for c in features], *[F.stddev_pop(c) for c in features]).first()
    d = len(features)
    return np.array(r[:d], float), np.maximum(np.array(r[d:], float), 1e-12)


def standardised(df: DataFrame, features: list[str], mean: np.ndarray, scale: np.ndarray) -> list[Column]:
    return [((F.col(c) - float(m)) / float(s)).alias(c) for c, m, s in zip(features, mean, scale, strict=True)]


def fit_rows(df: DataFrame, share: float | None) -> DataFrame:
    """The first share of each series' rows, in time order; all of them without one."""
    if share is None:
        return df
    kept = df.withColumn("__place", F.row_number().over(over_series()) / F.count("*").over(Window.partitionBy(KEY)))
    return kept.where(F.col("__place") <= share).drop("__place")


def series_blocks(df: DataFrame, features: list[str], mean: np.ndarray, scale: np.ndarray, block_rows: int) -> DataFrame:
    """Complete rows packed into blocks in time order: series_id, block, rows (the ROW of each, or its time), x (the standardised features one row after the other)."""
    name = ROW if ROW in df.columns else TS
    rows = long_bar_index(df.select(*dict.fromkeys([KEY, TS, name, *features])).dropna())
    item = F.struct(F.col(TS).alias("at"), F.col(name).alias("row"), F.array(*standardised(rows, features, mean, scale)).alias("x"))
    packed = rows.groupBy(KEY, F.floor(F.col("bar_idx") / block_rows).alias("block")).agg(F.sort_array(F.collect_list(item)).alias("r"))
    return staged(packed.select(KEY, "block", F.transform("r", lambda r: r["row"]).alias("rows"), F.flatten(F.transform("r", lambda r: r["x"])).alias("x")), "blocks")


def runs(part: Iterable[tuple]) -> Iterator[tuple[str, int, list[np.ndarray]]]:
    """(series, number of the first block, rows of each block) of blocks (series, number, rows) in order."""
    for key, group in groupby(part, lambda b: b[0]):
        blocks = list(group)
        yield key, blocks[0][1], [x for _, _, x in blocks]


def held_blocks(blocks: DataFrame, d: int, blocks_a_task: int = 16) -> RDD:
    """(series, number, rows as an array), in order, at most about so many neighbours in a partition."""
    context = blocks.sparkSession.sparkContext
    n = blocks.count()
    parts = max(1, min(n, max(context.defaultParallelism, -(-n // blocks_a_task))))
    ordered = blocks.select(KEY, "block", "x").repartitionByRange(parts, KEY, "block").sortWithinPartitions(KEY, "block")
    return ordered.rdd.map(lambda r: (r[0], r[1], np.array(r[2], float).reshape(-1, d))).persist(StorageLevel.MEMORY_AND_DISK)


def summed(parts: RDD) -> np.ndarray:
    """The sum of one array from each partition; many are added up in tasks first."""
    return parts.treeReduce(np.add, 1 if parts.getNumPartitions() <= 64 else 2)


def starts(rows: DataFrame, held: RDD, features: list[str], mean: np.ndarray, scale: np.ndarray, n_states: int, n_restarts: int, seed: int, max_iter: int = 8, tol: float = 0.01) -> list[HiddenMarkov]:
    """Models that start from mixtures of a few rounds, one for each seed. Spark's mixtures draw the first centres; a round is one job for all mixtures that have not settled."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=features, outputCol="__features").transform(rows.select(*standardised(rows, features, mean, scale))).select("__features").persist()
    d = len(features)
    drawn = [GaussianMixture(featuresCol="__features", k=n_states, seed=seed + k, maxIter=0).fit(vectors) for k in range(n_restarts)]
    vectors.unpersist()
    weight = np.stack([m.weights for m in drawn])
    centre = np.stack([[g.mean.toArray() for g in m.gaussians] for m in drawn])
    covariance = np.stack([[g.cov.toArray() for g in m.gaussians] for m in drawn])
    live, before = list(range(n_restarts)), np.full(n_restarts, -np.inf)
    for _ in range(max_iter):
        if not live:
            break
        mixed = [Mixture(weight[k], centre[k], covariance[k]) for k in live]
        sums = summed(held.mapPartitions(lambda part, mixed=mixed: [mixture_sums(part, mixed, d)]))
        for k, s in zip(list(live), sums, strict=True):
            mass, first, second = moments(s[:, 1:], d)
            weight[k], centre[k] = mass / mass.sum(), first / mass[:, None]
            covariance[k] = second / mass[:, None, None] - np.einsum("ki,kj->kij", centre[k], centre[k])
            if abs(s[0, 0] - before[k]) <= tol:
                live.remove(k)
            before[k] = s[0, 0]
    move = np.full((n_states, n_states), 0.1 / n_states) + 0.9 * np.eye(n_states)
    return [HiddenMarkov(features, mean, scale, np.full(n_states, 1 / n_states), move, m, c + 0.05 * np.eye(d)) for m, c in zip(centre, covariance, strict=True)]


class Mixture:
    """A Gaussian mixture's densities; a direction in which a covariance has no width counts for none."""

    def __init__(self, weight: np.ndarray, centre: np.ndarray, covariance: np.ndarray):
        k, d = centre.shape
        value, vector = np.linalg.eigh(covariance)
        wide = value > np.finfo(float).eps * d * value.max(1, keepdims=True)
        half = np.where(wide, 1 / np.sqrt(np.where(wide, value, 1.0)), 0.0)[:, :, None] * vector.transpose(0, 2, 1)
        self.weight, self.half, self.shift = weight, half.reshape(k * d, d), np.einsum("kij,kj->ki", half, centre)
        self.level = -0.5 * (d * np.log(2 * np.pi) + np.log(np.where(wide, value, 1.0)).sum(1))

    def shares(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Log likelihood, and each component's share (component, row) of each row."""
        k, d = self.shift.shape
        z = (self.half @ x.T).reshape(k, d, -1) - self.shift[:, :, None]
        p = np.finfo(float).eps + self.weight[:, None] * np.exp(self.level[:, None] - 0.5 * np.einsum("kdn,kdn->kn", z, z))
        total = p.sum(0)
        return float(np.log(total).sum()), p / total


def mixture_sums(part: Iterable[tuple], mixed: list[Mixture], d: int) -> np.ndarray:
    """(mixture, component, log likelihood and weighted sums of squares) over blocks."""
    out = np.zeros((len(mixed), len(mixed[0].weight), 2 + d + d * (d + 1) // 2))
    for _, _, x in part:
        powers = squares(x)
        for k, m in enumerate(mixed):
            ll, share = m.shares(x)
            out[k, :, 0] += ll
            out[k, :, 1:] += share @ powers
    return out


def _messages(held: RDD, joint: Joint) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """What reaches a partition's run of blocks from both sides, by series and first block. Only a partition's first and last run can go on elsewhere, so the driver
    sees k * k numbers a model for two runs of each partition, however many rows or series there are."""

    def ends(part: Iterator[tuple]) -> Iterator[tuple]:
        first, last = None, None
        for run in runs(part):
            first, last = first or run, run
        for key, block, blocks in ([first] if first is last else [first, last]) if first else []:
            total = None
            for at, x in enumerate(blocks):
                now = joint.prepared(x, block == 0 and at == 0).total
                total = now if total is None else total @ now
                total = total / _norm(total)
            yield key, block, total

    out, along = {}, sorted(held.mapPartitions(ends).collect(), key=lambda e: (e[0] is not None, e[0] or "", e[1]))
    for key, group in groupby(along, lambda e: e[0]):
        found = list(group)
        outgoing = [np.ones_like(joint.start)]
        for _, _, m in found[:0:-1]:
            now = (m @ outgoing[-1][:, :, None])[:, :, 0]
            outgoing.append(now / now.max(1, keepdims=True))
        incoming = joint.start
        for (_, block, m), after in zip(found, outgoing[::-1], strict=True):
            out[key, block] = incoming, after
            now = (incoming[:, None] @ m)[:, 0]
            incoming = now / now.sum(1, keepdims=True)
    return out


def hmm_fit(df: DataFrame, features: list[str] | None = None, n_states: int = 4, n_restarts: int = 10, max_iter: int = 1000, tol: float = 1e-4, seed: int = 42, ridge: float = 1e-3, block_rows: int = 4096, initial: list[HiddenMarkov] | None = None) -> HiddenMarkov:
    """Baum-Welch pooled over series, from mixtures or from the models given (which also fix scaling, states and restarts). Each round is one job, and one before it for messages where
    a series has several blocks: tasks add up the expected counts of their blocks, for all restarts that have not settled, Spark adds those up, and the driver holds a few numbers a state. The best restart by log likelihood is returned;
    its ``converged`` tells whether it gained less than tol in the last round."""
    features = initial[0].features if initial else features or FEATURES
    require_columns(df, features, "hmm_fit")
    if initial:
        n_states, n_restarts = len(initial[0].start), len(initial)
    rows = df.select(KEY, TS, *features).dropna()
    n = rows.count()
    if n < 10 * n_states:
        raise ValueError(f"{n} complete rows are too few for {n_states} states")
    mean, scale = (initial[0].mean, initial[0].scale) if initial else standard(rows, features)
    d = len(features)
    blocks = series_blocks(df, features, mean, scale, block_rows)
    alone = blocks.where("block > 0").isEmpty()
    held = held_blocks(blocks, d)
    models = [replace(m) for m in initial] if initial else starts(rows, held, features, mean, scale, n_states, n_restarts, seed)
    live = list(range(n_restarts))
    cut = np.cumsum([1, n_states, n_states**2])

    def round_() -> np.ndarray:
        """The sums over all blocks for each live model, added up in the tasks and then by Spark."""
        joint = Joint([models[k] for k in live])
        sides = {} if alone else _messages(held, joint)

        def counted(part: Iterator[tuple]) -> Iterator[np.ndarray]:
            total = np.zeros((len(joint.start), cut[-1] + n_states * (1 + d + d * (d + 1) // 2)))
            for key, block, found in runs(part):
                # a run that does not begin its series has messages, or the blocks are not in order
                for x, first, ll, g, moves in joint.run(found, block == 0, *(sides[key, block] if block else sides.get((key, block), (None, None)))):
                    powers = g.transpose(0, 2, 1).reshape(-1, len(x)) @ squares(x)
                    total += np.concatenate([ll[:, None], g[:, 0] * first, moves.reshape(len(g), -1), powers.reshape(len(g), -1)], 1)
            yield total

        return summed(held.mapPartitions(counted))

    climbers = [Climber(m) for m in models]
    for _ in range(max_iter):
        if not live:
            break
        for k, sums in zip(live, round_(), strict=True):
            ll, start, moves, powers = np.split(sums, cut)
            mass, first, second = moments(powers.reshape(n_states, -1), d)
            mass = np.maximum(mass, 1e-8)
            moves = moves.reshape(n_states, n_states) + 1e-8
            centre = first / mass[:, None]
            covariance = second / mass[:, None, None] - np.einsum("ki,kj->kij", centre, centre) + ridge * np.eye(d)
            after = replace(models[k], start=start / start.sum(), move=moves / moves.sum(1, keepdims=True), centre=centre, covariance=covariance)
            models[k] = climbers[k].step(float(ll[0]), after, tol)
        live = [k for k in live if not models[k].converged]
    held.unpersist()
    return max(models, key=lambda m: m.log_likelihood)


class Climber:
    """Takes a model from round to round: two plain rounds, then a leap along what they had in common (squared extrapolation), which counts only if it
    is likelier than the round before it. Moves leap as logarithms, and covariances as the logarithms of matrices, so that what comes out are models."""

    def __init__(self, model: HiddenMarkov):
        self.before: list[HiddenMarkov] = []
        self.now, self.rounds, self.safe, self.best, self.reach = model, 0, None, -np.inf, 4.0

    def step(self, ll: float, after: HiddenMarkov, tol: float) -> HiddenMarkov:
        """The model to look at next, from the log likelihood of the one looked at and what a plain round makes of it."""
        self.rounds += 1
        if self.safe is not None:
            leaped, self.before = ll >= self.best, []
            self.reach = self.reach * 2 if leaped else max(1.0, self.reach / 4)
            if not leaped:
                after, ll = self.safe, self.best
            self.safe = None
            self.now = replace(after, log_likelihood=max(ll, self.best), rounds=self.rounds)
            self.best = max(ll, self.best)
            return self.now
        done = bool(ll - self.best < tol)
        self.best = max(ll, self.best)
        self.before.append(self.now)
        if done or len(self.before) < 2:
            self.now = replace(after, log_likelihood=self.best, rounds=self.rounds, converged=done)
            return self.now
        self.safe = after
        leap = extrapolated(self.before[0], self.before[1], after, self.reach)
        self.now = replace(leap if leap is not None else after, log_likelihood=self.best, rounds=self.rounds)
        return self.now


def _logs(m: HiddenMarkov) -> np.ndarray:
    value, vector = np.linalg.eigh(m.covariance)
    logs = np.einsum("kij,kj,klj->kil", vector, np.log(np.maximum(value, 1e-12)), vector)
    return np.concatenate([np.log(np.maximum(m.move, 1e-6)).ravel(), m.centre.ravel(), logs.ravel()])


def extrapolated(a: HiddenMarkov, b: HiddenMarkov, c: HiddenMarkov, reach: float = np.inf) -> HiddenMarkov | None:
    """The model that rounds a, b, c lead towards, at most reach steps ahead; None if they do not move, or lead nowhere."""
    x, y, z = map(_logs, (a, b, c))
    r, v = y - x, z - 2 * y + x
    size = np.linalg.norm(v)
    if size < 1e-12:
        return None
    far = -min(reach, max(1.0, np.linalg.norm(r) / size))
    p = x - 2 * far * r + far**2 * v
    k, d = a.centre.shape
    move, centre, logs = np.split(p, np.cumsum([k * k, k * d]))
    move = np.exp(np.clip(move.reshape(k, k), -30, 30))
    logs = logs.reshape(k, d, d)
    if not np.isfinite(logs).all():
        return None
    value, vector = np.linalg.eigh((logs + logs.transpose(0, 2, 1)) / 2)
    # no narrower and no wider than what it comes from by more than a hundred times
    spread = np.log(np.linalg.eigvalsh(c.covariance))
    low, high = spread.min() - 4.6, spread.max() + 4.6
    covariance = np.einsum("kij,kj,klj->kil", vector, np.exp(np.clip(value, low, high)), vector)
    if not all(np.isfinite(q).all() for q in (move, centre, covariance)):
        return None
    return replace(c, move=move / move.sum(1, keepdims=True), centre=centre.reshape(k, d), covariance=covariance)


def hmm_states(df: DataFrame, model: HiddenMarkov, block_rows: int = 4096) -> DataFrame:
    """(series_id, ts, regime_state), or (ROW, regime_state) of rows with one: the likeliest path of each series over its complete rows. Blocks give their best scores, which
    are followed along the series to the states at the blocks' ends; then each block finds its own part of the path."""
    d, name = len(model.features), ROW if ROW in df.columns else TS
    kind = dict(df.dtypes)[name]
    blocks = series_blocks(df, model.features, model.mean, model.scale, block_rows)

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({KEY: b[KEY], "block": b["block"], "m": [best_scores(model, np.array(v, float).reshape(-1, d), at == 0).ravel() for v, at in zip(b["x"], b["block"], strict=True)]})

    def ends(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        m = np.stack(part["m"].to_numpy()).reshape(len(part), len(model.start), -1)
        score = [np.log(model.start + 1e-300)]
        for v in m:
            score.append((score[-1][:, None] + v).max(0))
        state = [int(score[-1].argmax())]
        for t in range(len(part) - 1, -1, -1):
            state.append(int((score[t] + m[t][:, state[-1]]).argmax()))
        state = state[::-1]
        return pd.DataFrame({KEY: part[KEY], "block": part["block"], "before": state[:-1], "end": state[1:]})

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["state"] = [path_between(model, np.array(r.x, float).reshape(-1, d), r.block == 0, r.before, r.end) for r in b.itertuples(index=False)]
            yield b[[KEY, "rows", "state"]]

    at = blocks.select(KEY, "block", "x").mapInPandas(scores, f"{KEY} string, block bigint, m array<double>").groupBy(KEY).applyInPandas(ends, f"{KEY} string, block bigint, before int, end int")
    got = blocks.join(at, [KEY, "block"]).mapInPandas(paths, f"{KEY} string, rows array<{kind}>, state array<int>")
    each = got.select(KEY, F.inline(F.arrays_zip("rows", "state")))
    return each.select(*([KEY] if name == TS else []), F.col("rows").alias(name), F.col("state").alias("regime_state"))


def model_tables(spark: SparkSession, model: HiddenMarkov) -> tuple[DataFrame, DataFrame]:
    """(state, regime, feature, mean), means in original units, and (from_state, from_regime, to_state, to_regime, probability)."""
    names, k = name_states(model.state_means(), model.features), len(model.start)
    means = [(i, names[i], f, float(model.state_means()[i, j])) for i in range(k) for j, f in enumerate(model.features)]
    moves = [(i, names[i], j, names[j], float(model.move[i, j])) for i in range(k) for j in range(k)]
    return spark.createDataFrame(means, "state int, regime string, feature string, mean double"), spark.createDataFrame(moves, "from_state int, from_regime string, to_state int, to_regime string, probability double")


def name_states(means: np.ndarray, features: list[str], volatility: str = "a_atr_pct", score: str = "ratio_zscore_30") -> dict[int, str]:
    """crisis: highest sum of the ranks of volatility and score; range_bound: least volatility of the rest; risk_on: lowest score of the rest; trending: all others.

    Equal values share the mean of their ranks; of equal states the first counts.
    """
    vol, z = (means[:, features.index(c)].tolist() for c in (volatility, score))
    rank = lambda x, of: sum(y < x for y in of) + sum(y == x for y in of) / 2
    order = {"crisis": lambda k: (-rank(vol[k], vol) - rank(z[k], z), k), "range_bound": lambda k: (vol[k], k), "risk_on": lambda k: (z[k], k)}
    names: dict[int, str] = {}
    for name, key in order.items():
        first = min((k for k in range(len(means)) if k not in names), key=key, default=None)
        if first is not None:
            names[first] = name
    return {k: names.get(k, "trending") for k in range(len(means))}


def fit_and_label(df: DataFrame, n_states: int = 4, n_restarts: int = 10, model: str = "hmm", seed: int = 42, max_iter: int = 1000, features: list[str] | None = None, fit_upto: float | None = None) -> DataFrame:
    """The frame with regime_state and regime; rows with a missing feature keep NULLs. model: hmm, gmm, or none (all range_bound).

    Models are fitted on all rows, or on the first share fit_upto of each series, and label all rows. Rows stay one for one, also where a series has a time twice:
    the frame is written once with a number for each row, and labels come back by it.
    """
    features = features or FEATURES
    if model == "none":
        return df.withColumns({"regime_state": F.lit(None).cast("int"), "regime": F.lit("range_bound")})
    df = staged(df.withColumn(ROW, F.monotonically_increasing_id()), "frame")
    if model == "gmm":
        states, means = gmm_states(df, features, n_states, n_restarts, seed, fit_upto)
    else:
        fitted = hmm_fit(fit_rows(df, fit_upto), features, n_states, n_restarts, max_iter, seed=seed)
        states, means = hmm_states(df, fitted), fitted.state_means()
    names = F.create_map(*[F.lit(x) for pair in name_states(means, features).items() for x in pair])
    return df.join(states, ROW, "left").withColumn("regime", names[F.col("regime_state")]).drop(ROW)


def gmm_states(df: DataFrame, features: list[str], n_states: int, n_restarts: int, seed: int, fit_upto: float | None = None) -> tuple[DataFrame, np.ndarray]:
    """(ROW, regime_state) of a Gaussian mixture without time; the best of a few seeds by log likelihood."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    rows = df.select(KEY, TS, ROW, *features).dropna()
    known = fit_rows(rows, fit_upto)
    mean, scale = standard(known, features)
    vectors = lambda r: VectorAssembler(inputCols=features, outputCol="__features").transform(r.select(ROW, *standardised(r, features, mean, scale))).select(ROW, "__features")
    train = vectors(known).persist()
    fits = [GaussianMixture(featuresCol="__features", predictionCol="regime_state", k=n_states, seed=seed + k, maxIter=100).fit(train) for k in range(n_restarts)]
    best = max(fits, key=lambda m: m.summary.logLikelihood)
    train.unpersist()
    centre = np.array([g.mean.toArray() for g in best.gaussians])
    return best.transform(vectors(rows)).select(ROW, F.col("regime_state").cast("int").alias("regime_state")), centre * scale + mean


def regime_statistics(df: DataFrame) -> DataFrame:
    """Days, share of all rows (NULL regimes among them), mean ratio and volatility of each regime."""
    total = df.groupBy(KEY).agg(F.count("*").alias("n_all"))
    out = df.where("regime is not null").groupBy(KEY, "regime").agg(F.count("*").alias("days"), F.avg("ratio").alias("mean_ratio"), F.avg("a_vol_20").alias("mean_vol"))
    return out.join(total, KEY).withColumn("share", F.try_divide(F.col("days").cast("double"), F.col("n_all")))


def regime_shares(df: DataFrame, size: int = 30, least: int = 5) -> DataFrame:
    """Share of each regime in the last size rows; a NULL regime counts for none."""
    frame = over_series().rowsBetween(-(size - 1), 0)
    share = lambda r: F.when(F.count("*").over(frame) >= least, F.avg(F.coalesce(F.col("regime") == r, F.lit(False)).cast("double")).over(frame))
    return df.withColumns({f"share_{r}": share(r) for r in REGIMES})


def regime_transitions(df: DataFrame) -> DataFrame:
    """Probability of each regime after each other, over the grid of those seen; rows with a NULL regime are left out first."""
    known = df.where("regime is not null")
    pairs = known.select(KEY, F.col("regime").alias("from_regime"), F.lead("regime").over(over_series()).alias("to_regime")).where("to_regime is not null")
    counts = pairs.groupBy(KEY, "from_regime", "to_regime").agg(F.count("*").alias("n"))
    seen = known.groupBy(KEY).agg(F.collect_set("regime").alias("all"))  # at most as many as there are regimes
    grid = seen.select(KEY, F.explode("all").alias("from_regime"), "all").select(KEY, "from_regime", F.explode("all").alias("to_regime"))
    full = grid.join(counts, [KEY, "from_regime", "to_regime"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(KEY, "from_regime"))
    return full.withColumn("probability", F.coalesce(F.try_divide(F.col("n").cast("double"), total), F.lit(0.0)))


def regime_bands(df: DataFrame) -> DataFrame:
    """Runs of one regime: first and last time; a run ends where the next begins, the last at the last row. NULL runs are left out."""
    w = over_series()
    begins = (F.row_number().over(w) == 1) | ~F.col("regime").eqNullSafe(F.lag("regime").over(w))
    rows = df.withColumn("__new", begins.cast("int")).withColumn("band", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bands = rows.groupBy(KEY, "band").agg(F.first("regime").alias("regime"), F.min(TS).alias("band_start"), F.max(TS).alias("__last"), F.count("*").alias("n_bars"))
    after = F.lead("band_start").over(Window.partitionBy(KEY).orderBy("band"))
    return bands.withColumn("band_end", F.coalesce(after, F.col("__last"))).where("regime is not null").drop("__last")


def encoded(regime: str = "regime") -> Column:
    """The regime's place by name; range_bound where it is missing."""
    known = F.coalesce(regime, F.lit("range_bound"))
    return F.coalesce(*[F.when(known == r, F.lit(float(k))) for k, r in enumerate(REGIMES)], F.lit(1.0))
