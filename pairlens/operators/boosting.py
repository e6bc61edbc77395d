"""Joint boosting of several classes: second-order softmax on binned features.

Rows are cut into blocks of small integers (bins). A level of all classes' trees is one job (many rounds are, where one block holds all rows): tasks add up the histograms of gradients over their blocks, Spark adds those up
in a tree, and the driver, which holds bins and not rows, chooses the splits. Scores of rows stay with the blocks, are taken on by one round after the other, and are
written to the checkpoint folder every few rounds, so that a lost executor costs those only. A tree looks at a share of the columns, a round at a share of the rows; both follow
from the seed and from the rows' own hashes, however the rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder, staged

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass
class Tree:
    """Nodes as in a heap: node i has the children 2i + 1 (at most the threshold) and 2i + 2. feature is -1 for leaves, cover the sum of second derivatives."""

    feature: np.ndarray
    at: np.ndarray  # bin while training, threshold afterwards
    value: np.ndarray
    cover: np.ndarray

    @staticmethod
    def root(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n))

    def places(self, x: np.ndarray) -> np.ndarray:
        """The node each row comes to, by bins or by values as ``at`` is."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            f = self.feature[node]
            if (f < 0).all():
                return node
            node = np.where(f < 0, node, 2 * node + 1 + (x[rows, f] > self.at[node]))


@dataclass
class Boosted:
    """margins = the sum of the trees' values of each class; trees: one list a round, one tree a class."""

    features: list[str]
    n_classes: int
    trees: list[list[Tree]] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros((len(x), self.n_classes))
        for each in self.trees:
            for k, tree in enumerate(each):
                total[:, k] += tree.value[tree.places(x)]
        return total


def softmax(margins: np.ndarray) -> np.ndarray:
    p = np.exp(margins - margins.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def derivatives(margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives (rows, classes) of the log loss."""
    p = softmax(margins)
    return p - (np.arange(p.shape[1]) == label[:, None]), np.maximum(2 * p * (1 - p), 1e-16)


def chosen(key: np.ndarray, turn: int, share: float) -> np.ndarray:
    """Which rows a round looks at, by the hash of each."""
    with np.errstate(over="ignore"):
        z = key + np.uint64(turn + 1) * _MIX[0]
        z = (z ^ (z >> np.uint64(30))) * _MIX[1]
        z = (z ^ (z >> np.uint64(27))) * _MIX[2]
    return (z ^ (z >> np.uint64(31))) >> np.uint64(11) < np.uint64(int(share * (1 << 53)))


def edges_of(rows: DataFrame, features: list[str], bins: int, error: float | None = None) -> list[np.ndarray]:
    """The borders of each feature's bins: at most bins - 1 quantiles, from one pass. error is that of the quantiles' ranks, a tenth of a bin if not given."""
    found = rows.approxQuantile(features, [k / bins for k in range(1, bins)], 0.1 / bins if error is None else error)
    return [np.unique(np.array(q, float)) for q in found]


def blocks_of(rows: DataFrame, features: list[str], label: str, edges: list[np.ndarray], block_rows: int) -> tuple[RDD, int]:
    """(bins, labels, hashes) of at most block_rows rows each, and the number of all rows. If one block holds them all, there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(len(features))], axis=1).reshape(-1, len(features))
            binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1).astype(np.uint8)
            y, key = b.column(len(features)).to_numpy(zero_copy_only=False).astype(np.int8), b.column(len(features) + 1).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(x), block_rows):
                cut = slice(at, at + block_rows)
                yield pa.RecordBatch.from_arrays([pa.array([v[cut].tobytes()], pa.binary()) for v in (binned, y, key)], names=["bins", "label", "key"])

    d, n = len(features), rows.count()
    # each of many short jobs goes over all blocks: as few as the rows fill
    packed = rows.repartition(max(1, -(-n // block_rows))).select(*features, F.col(label).cast("int").alias("label"), F.xxhash64(*features, F.col(label).cast("int")).alias("key")).mapInArrow(run, "bins binary, label binary, key binary")
    packed = staged(packed, "blocks")
    found = packed.rdd.map(lambda r: (np.frombuffer(r["bins"], np.uint8).reshape(-1, d), np.frombuffer(r["label"], np.int8), np.frombuffer(r["key"], np.uint64)))
    if n <= block_rows:
        # batches of one task become one block
        found = found.coalesce(1).mapPartitions(lambda part: [tuple(np.concatenate(v) for v in zip(*part, strict=True))])
    return found, n


def histograms(blocks: Iterable[tuple], trees: list[Tree], level: int, turn: int, share: float, n_bins: int) -> np.ndarray | None:
    """Sums of both derivatives: (classes, nodes of the level, features, bins, 2)."""
    k, first, width = len(trees), 2**level - 1, 2**level
    total = None
    for bins, label, key, margins in blocks:
        d = bins.shape[1]
        total = np.zeros((k, width, d, n_bins, 2)) if total is None else total
        own = chosen(key, turn, share)
        x, (g, h) = bins[own], derivatives(margins[own], label[own])
        flat = np.arange(d) * n_bins + x
        for c, tree in enumerate(trees):
            node = tree.places(x) - first
            open_ = node >= 0
            at = (node[open_, None] * (d * n_bins) + flat[open_]).ravel()
            for s, v in enumerate((g[open_, c], h[open_, c])):
                total[c, :, :, :, s] += np.bincount(at, np.repeat(v, d), minlength=width * d * n_bins).reshape(width, d, n_bins)
    return total


def grow(trees: list[Tree], sums: np.ndarray, level: int, columns: list[np.ndarray], smoothing: float, least_cover: float, last: bool) -> bool:
    """Split the nodes of a level where that pays; whether any was. values are of the step, before the rate."""
    first, grown = 2**level - 1, False
    for c, tree in enumerate(trees):
        whole = sums[c, :, 0].sum(1)  # any feature holds all rows
        if level == 0:
            tree.value[0], tree.cover[0] = -whole[0, 0] / (whole[0, 1] + smoothing), whole[0, 1]
        left = np.cumsum(sums[c], axis=2)
        right = whole[:, None, None] - left
        score = lambda s: s[..., 0] ** 2 / (s[..., 1] + smoothing)
        gain = score(left) + score(right) - score(whole)[:, None, None]
        gain[(left[..., 1] < least_cover) | (right[..., 1] < least_cover)] = -np.inf
        gain[:, np.setdiff1d(np.arange(gain.shape[1]), columns[c])] = -np.inf
        for j in range(len(whole)):
            # of equal gains the first, however the sums were rounded
            f, b = np.unravel_index((gain[j] >= gain[j].max() - 1e-9 * (1 + abs(gain[j].max()))).argmax(), gain[j].shape) if np.isfinite(gain[j].max()) else (0, 0)
            if gain[j, f, b] <= 1e-9:
                continue
            node, grown = first + j, True
            tree.feature[node], tree.at[node] = f, b
            for child, s in ((2 * node + 1, left[j, f, b]), (2 * node + 2, right[j, f, b])):
                tree.value[child], tree.cover[child] = -s[0] / (s[1] + smoothing), s[1]
    return grown and not last


@dataclass(frozen=True)
class Growth:
    """How trees grow."""

    n_features: int
    n_classes: int
    depth: int
    rate: float
    row_share: float
    column_share: float
    smoothing: float
    least_cover: float
    bins: int
    seed: int

    def round(self, turn: int, summed: Callable[[list[Tree], int], np.ndarray]) -> list[Tree]:
        """One tree a class. summed gives the histograms of a level over all rows."""
        rng, size = np.random.default_rng([self.seed, turn]), max(1, round(self.column_share * self.n_features))
        columns = [rng.choice(self.n_features, size, replace=False) for _ in range(self.n_classes)]
        trees = [Tree.root(self.depth) for _ in range(self.n_classes)]
        for level in range(self.depth):
            if not grow(trees, summed(trees, level), level, columns, self.smoothing, self.least_cover, level == self.depth - 1):
                break
        for tree in trees:
            tree.value *= self.rate
        return trees

    def sums(self, blocks: Iterable[tuple], trees: list[Tree], level: int, turn: int) -> np.ndarray | None:
        return histograms(blocks, trees, level, turn, self.row_share, self.bins)


def taken_on(block: tuple, rounds: list[list[Tree]]) -> tuple:
    """A block with what some rounds add to its scores."""
    margins = block[3].copy()
    for trees in rounds:
        margins += np.stack([t.value[t.places(block[0])] for t in trees], axis=1)
    return (*block[:3], margins)


def rounds_of_one_block(part: Iterator[tuple], growth: Growth, before: list[list[Tree]], turns: range) -> Iterator[list[list[Tree]]]:
    """Some rounds in a task that has all rows, as one block: its histograms are those of all rows."""
    for block in part:
        block, made = taken_on(block, before), []
        for turn in turns:
            made.append(growth.round(turn, lambda trees, level, block=block, turn=turn: growth.sums([block], trees, level, turn)))
            block = taken_on(block, made[-1:])
        yield made


def fit(rows: DataFrame, features: list[str], label: str = "label", n_classes: int = 3, rounds: int = 300, depth: int = 4, rate: float = 0.05, row_share: float = 0.8, column_share: float = 0.8, smoothing: float = 1.0, least_cover: float = 1.0, bins: int = 64, seed: int = 42, block_rows: int = 50_000, checkpoint_every: int = 25, error: float | None = None) -> Boosted:
    """rows: complete features (doubles) and a label from 0. Each round grows one tree a class, all from the scores before it.

    Where block_rows hold all rows, checkpoint_every rounds are one job, as one block's histograms are whole; otherwise each level is one.
    """
    if not 2 <= bins <= 256:
        raise ValueError("bins must be between 2 and 256")
    context, model = rows.sparkSession.sparkContext, Boosted(list(features), n_classes)
    edges = edges_of(rows, features, bins, error)
    if not edges or any(len(e) == 0 for e in edges):
        return model
    growth = Growth(len(features), n_classes, depth, rate, row_share, column_share, smoothing, least_cover, bins, seed)
    blocks, n = blocks_of(rows, features, label, edges, block_rows)
    state = blocks.map(lambda b: (*b, np.zeros((len(b[1]), n_classes)))).persist(StorageLevel.MEMORY_AND_DISK)
    if n <= block_rows:
        for turn in range(0, rounds, checkpoint_every):
            turns, before = range(turn, min(turn + checkpoint_every, rounds)), model.trees
            model.trees = before + state.mapPartitions(lambda part, before=before, turns=turns: rounds_of_one_block(part, growth, before, turns)).collect()[0]
    else:
        if not context.getCheckpointDir():
            context.setCheckpointDir(shared_folder(rows.sparkSession, "checkpoints"))
        last = None
        for turn in range(rounds):
            summed = lambda trees, level, state=state, turn=turn: state.mapPartitions(lambda part: [s for s in [growth.sums(part, trees, level, turn)] if s is not None]).treeReduce(np.add)
            trees = growth.round(turn, summed)
            after = state.map(lambda b, trees=trees: taken_on(b, [trees])).persist(StorageLevel.MEMORY_AND_DISK)
            if (turn + 1) % checkpoint_every == 0:
                after.checkpoint()
                after.count()
            if last is not None:
                last.unpersist()
            last, state = state, after
            model.trees.append(trees)
        if last is not None:
            last.unpersist()
    state.unpersist()
    for each in model.trees:
        for tree in each:
            split = tree.feature >= 0
            tree.at[split] = [edges[f][min(int(b), len(edges[f]) - 1)] for f, b in zip(tree.feature[split], tree.at[split], strict=True)]
    return model
