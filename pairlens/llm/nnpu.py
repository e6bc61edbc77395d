"""Non-negative positive-unlabelled learning in numpy.

The risk of a scorer g with class prior p, trusted positives P and unlabelled rows U is

    p * mean_P loss(+g) + max(0, mean_U loss(-g) - p * mean_P loss(-g))

with the logistic loss; while the second part is below zero, its gradient is reversed. One hidden layer of tanh
units, or none (a linear scorer). Full-batch Adam from a fixed seed, so that reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class PUModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        for w, b in zip(self.weights[:-2:2], self.weights[1:-2:2], strict=True):
            z = np.tanh(z @ w + b)
        return (z @ self.weights[-2] + self.weights[-1])[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class, 0 to 1."""
        if not self.weights:
            return np.full(len(x), self.prior)
        return sigmoid(self.raw(x))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk(g_p: np.ndarray, g_u: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk; the second may be negative."""
    loss = lambda z: np.logaddexp(0, -z)
    return prior * loss(g_p).mean(), loss(-g_u).mean() - prior * loss(-g_p).mean()


def fit(x_p: np.ndarray, x_u: np.ndarray, prior: float, hidden: int = 0, steps: int = 400, rate: float = 0.03, decay: float = 1e-4, standardise: bool = True, seed: int = 7, corrected: bool = True) -> PUModel:
    """Without positives or unlabelled rows the model says the prior for every row. Not corrected: positives against unlabelled rows, as if those were negatives."""
    prior = float(min(max(prior, 0.0), 1.0))
    d = x_p.shape[1] if x_p.ndim == 2 else x_u.shape[1]
    if not len(x_p) or not len(x_u) or prior in (0.0, 1.0):
        return PUModel(np.zeros(d), np.ones(d), [], prior)
    if standardise:
        mean, scale = x_u.mean(0), np.maximum(x_u.std(0), 1e-6)
    else:
        mean, scale = np.zeros(d), np.ones(d)
    zp, zu = (np.clip((x - mean) / scale, -6, 6) for x in (x_p, x_u))
    rng = np.random.default_rng(seed)
    w = []
    if hidden:
        w += [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden)]
        d = hidden
    w += [np.zeros((d, 1)) if not hidden else rng.normal(0, 1 / np.sqrt(d), (d, 1)), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for t in range(1, steps + 1):
        hp, hu = (np.tanh(zp @ w[0] + w[1]), np.tanh(zu @ w[0] + w[1])) if hidden else (zp, zu)
        gp, gu = (hp @ w[-2] + w[-1])[:, 0], (hu @ w[-2] + w[-1])[:, 0]
        _, negative = risk(gp, gu, prior)
        sp, su = sigmoid(gp), sigmoid(gu)
        if not corrected:
            dp, du = -prior * (1 - sp) / len(gp), (1 - prior) * su / len(gu)
        elif negative >= 0:
            dp, du = -prior * (1 - sp) / len(gp) - prior * sp / len(gp), su / len(gu)
        else:
            dp, du = prior * sp / len(gp), -su / len(gu)
        grads = [hp.T @ dp[:, None] + hu.T @ du[:, None], np.array([dp.sum() + du.sum()])]
        if hidden:
            bp, bu = dp[:, None] * w[-2].T * (1 - hp**2), du[:, None] * w[-2].T * (1 - hu**2)
            grads = [zp.T @ bp + zu.T @ bu, bp.sum(0) + bu.sum(0), *grads]
        for k, g in enumerate(grads):
            g = g + decay * w[k] * (w[k].ndim == 2)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return PUModel(mean, scale, w, prior)


def class_prior(x_p: np.ndarray, x_u: np.ndarray, hidden: int = 16, steps: int = 200, rate: float = 0.02, least: int = 20) -> float:
    """The share of positives among unlabelled rows, from both samples alone.

    Any set of rows holds a share of the unlabelled that is at least the prior times its share of the positives, with equality where it holds no
    negatives. The sets are the upper parts of a scorer that tells positives from unlabelled rows, fitted on one half and read on the other; the ratio that is least with
    its standard error is the estimate, the mean of both halves. Under ``least`` rows of either: one half.
    """
    if min(len(x_p), len(x_u)) < least:
        return 0.5
    found = []
    for k in (0, 1):
        scorer = fit(x_p[k::2], x_u[k::2], 0.5, hidden, steps, rate, decay=1e-3, corrected=False)
        p, u = np.sort(scorer.raw(x_p[1 - k :: 2])), np.sort(scorer.raw(x_u[1 - k :: 2]))
        at = np.quantile(p, np.arange(0.02, 0.6, 0.02))
        share_p, share_u = (1 - np.searchsorted(s, at) / len(s) for s in (p, u))
        ratio = share_u / np.maximum(share_p, 1e-9)
        error = ratio * np.sqrt((1 - share_u) / np.maximum(share_u * len(u), 1e-9) + (1 - share_p) / np.maximum(share_p * len(p), 1e-9))
        sure = share_u > 0
        found.append(ratio[sure][(ratio + error)[sure].argmin()] if sure.any() else 0.0)
    return float(np.clip(np.mean(found), 0.0, 1.0))
