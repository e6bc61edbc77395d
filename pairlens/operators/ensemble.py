"""Boosted three-class model over signals and features, with attributions for the predicted class.

Attributions are exact Shapley values of path-dependent trees. A leaf's value reaches a row by a product over the features on its path: 1 or 0 as the row takes
the leaf's way there, or the share of training weight that does where a feature is unknown. The sums over subsets of known features are coefficients of the
polynomial of those factors; each feature's own factor is divided out of it. That is quadratic in the depth, for a whole Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import KEY, TS, require_columns
from ..sources.shared import staged
from . import boosting
from .boosting import Boosted, Tree
from .regimes import encoded
from .signals import CLASSES, STRATEGY, target_labels, train_test_split

RAW = ["ratio_zscore_30", "ratio_zscore_90", "ratio_slope", "vol_ratio", "ratio_ema_slope", "a_ema_slope", "b_ema_slope", "a_macd_hist", "rel_strength_20", "a_breakout", "b_breakout", "a_atr_pct", "a_vol_5", "a_cond_vol", "cond_vol_ratio"]
FEATURES = [*STRATEGY, *RAW, "regime_encoded"]


@dataclass
class Leaf:
    """A leaf: its value, for each feature on its path the interval it allows and the share of training rows that goes along, and its share of all."""

    value: float
    path: list[tuple[int, float, float, float]]
    share: float = 1.0


def leaves(tree: Tree) -> list[Leaf]:
    out = []

    def walk(i: int, path: dict[int, tuple[float, float, float]], share: float) -> None:
        f = int(tree.feature[i])
        if f < 0:
            out.append(Leaf(float(tree.value[i]), [(k, *v) for k, v in path.items()], share))
            return
        low, high, along = path.get(f, (-np.inf, np.inf, 1.0))
        for child, lo, hi in ((2 * i + 1, low, min(high, tree.at[i])), (2 * i + 2, max(low, tree.at[i]), high)):
            part = tree.cover[child] / tree.cover[i]
            walk(child, path | {f: (lo, hi, along * part)}, share * part)

    walk(0, {}, 1.0)
    return out


def attributions(trees: list[list[Leaf]], x: np.ndarray) -> np.ndarray:
    """Shapley values (rows, features) of a sum of trees."""
    phi = np.zeros(x.shape)
    for found in trees:
        for leaf in found:
            m = len(leaf.path)
            if not m:
                continue
            known = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, lo, hi, _ in leaf.path]
            # coefficients by the number of known features
            whole = [np.ones(len(x))]
            for o, (*_, z) in zip(known, leaf.path, strict=True):
                whole = [(z * whole[k] if k < len(whole) else 0.0) + (o * whole[k - 1] if k else 0.0) for k in range(len(whole) + 1)]
            for o, (f, _, _, z) in zip(known, leaf.path, strict=True):
                total, rest = np.zeros(len(x)), np.zeros(len(x))
                for k in range(m - 1, -1, -1):
                    # without this feature: its factor is z plus o for each known one
                    rest = np.where(o > 0, whole[k + 1] - z * rest, whole[k] / z)
                    total += rest / (m * comb(m - 1, k))
                phi[:, f] += leaf.value * (o - z) * total
    return phi


def feature_matrix(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Adds regime_encoded, the number of the regime; rows with a missing feature are left out."""
    df = df.withColumn("regime_encoded", encoded())
    require_columns(df, features, "feature_matrix")
    return df.dropna(subset=list(features))


def fit(df: DataFrame, n_trees: int = 300, depth: int = 4, rate: float = 0.05, share: float = 0.8, train_share: float = 0.8, seed: int = 42, features: list[str] = FEATURES, fit_upto: float | None = None, rows_per_task: int = 50_000) -> Boosted:
    """A pooled model from the first train_share of each series' complete rows. The labels' threshold is over all rows; fit_upto goes to it."""
    rows = train_test_split(feature_matrix(target_labels(df, fit_upto=fit_upto), features), train_share).where("is_train").select(*[F.col(c).cast("double").alias(c) for c in features], "label")
    return boosting.fit(staged(rows, "training"), features, "label", len(CLASSES), n_trees, depth, rate, share, share, seed=seed, block_rows=rows_per_task)


def predict(df: DataFrame, model: Boosted, attribute: bool = True) -> DataFrame:
    """The frame with predicted, ensemble_signal, ensemble_confidence (the softmax probability), margin, base, and shap_<feature> of the predicted class.

    Rows stay as they are, one for one; those with a missing feature get NULLs.
    """
    features, names = model.features, [CLASSES[k] for k in sorted(CLASSES)]
    added = "predicted int, ensemble_signal string, ensemble_confidence double, margin double, base double" + "".join(f", shap_{f} double" for f in features if attribute)
    by_class = [[leaves(each[k]) for each in model.trees] for k in range(model.n_classes)] if attribute else []
    bases = np.array([sum(leaf.value * leaf.share for each in model.trees for leaf in leaves(each[k])) for k in range(model.n_classes)])
    given = df.withColumns({f"__x{i}": (encoded() if f == "regime_encoded" else F.col(f)).cast("double") for i, f in enumerate(features)})
    kept = [c for c in df.columns if c not in {p.split()[0] for p in added.split(", ")}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(len(kept) + i).to_numpy(zero_copy_only=False) for i in range(len(features))], axis=1).astype(float)
            whole = ~np.isnan(x).any(1)
            margins = model.margins(x[whole])
            k = margins.argmax(1)
            made = [k, None, boosting.softmax(margins).max(1), margins[np.arange(len(k)), k], bases[k]]
            if attribute:
                phi = np.zeros((len(k), len(features)))
                for c in range(model.n_classes):
                    phi[k == c] = attributions(by_class[c], x[whole][k == c])
                made += list(phi.T)
            columns = []
            for i, v in enumerate(made):
                if i == 1:
                    signal = np.full(len(x), None, object)
                    signal[whole] = [names[c] for c in k]
                    columns.append(pa.array(signal, pa.string()))
                else:
                    every = np.zeros(len(x))
                    every[whole] = v
                    columns.append(pa.array(every.astype(np.int32) if i == 0 else every, mask=~whole))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *columns], names=[*kept, *[p.split()[0] for p in added.split(", ")]])

    schema = StructType([df.schema[c] for c in kept] + StructType.fromDDL(added).fields)
    return given.select(*kept, *[f"__x{i}" for i in range(len(features))]).mapInArrow(run, schema)


def fit_and_predict(df: DataFrame, **options) -> DataFrame:
    """The frame with predictions and attributions, row for row."""
    df = staged(df, "signals")  # looked at by the fit and by the prediction
    return predict(df, fit(df, **options))


def _long(df: DataFrame, prefix: str) -> DataFrame:
    found = [c for c in df.columns if c.startswith(prefix)]
    if not found:
        raise ValueError(f"no columns {prefix}*")
    return df.select(KEY, TS, F.inline(F.array(*[F.struct(F.lit(c.removeprefix(prefix)).alias("feature"), F.col(c).alias("value")) for c in found])))


def top_features(df: DataFrame, n: int = 10, prefix: str = "shap_") -> DataFrame:
    """The n features of largest mean absolute attribution."""
    return _long(df, prefix).groupBy("feature").agg(F.avg(F.abs("value")).alias("importance")).orderBy(F.desc("importance"), "feature").limit(n)


def latest_contributions(df: DataFrame, n: int = 15, prefix: str = "shap_") -> DataFrame:
    """The n largest attributions, by absolute value, of each series' last row."""
    from .signals import latest

    w = Window.partitionBy(KEY).orderBy(F.desc(F.abs("value")), "feature")
    return _long(latest(df), prefix).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
