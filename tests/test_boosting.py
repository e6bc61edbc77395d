"""Joint boosting against the same rule written row by row."""

import numpy as np
import pandas as pd
import pytest

from pairlens.operators import boosting


def table(n=400, d=5, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 2)
    y = np.clip((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.3, size=n)).round().astype(int) + 1, 0, 2)
    return x, y, [f"f{k}" for k in range(d)]


def row_by_row(x, y, edges, key, rounds, depth, rate, row_share, column_share, smoothing, least, seed, k=3):
    """Margins of plain boosting: each node looks at all its rows for each border."""
    n, d = x.shape
    margins = np.zeros((n, k))
    for turn in range(rounds):
        rng = np.random.default_rng([seed, turn])
        columns = [sorted(rng.choice(d, max(1, round(column_share * d)), replace=False)) for _ in range(k)]
        p = np.exp(margins) / np.exp(margins).sum(1, keepdims=True)
        taken = [i for i in range(n) if boosting.chosen(key[i : i + 1], turn, row_share)[0]]
        step = np.zeros((n, k))
        for c in range(k):
            g = [p[i, c] - (y[i] == c) for i in range(n)]
            h = [max(2 * p[i, c] * (1 - p[i, c]), 1e-16) for i in range(n)]

            def node(rows, every, level):
                total = lambda v, of: sum(v[i] for i in of)
                score = lambda of: total(g, of) ** 2 / (total(h, of) + smoothing)
                best = (1e-9, None)
                for f in columns[c] if level < depth else ():
                    for at in edges[f]:
                        left, right = [i for i in rows if x[i, f] <= at], [i for i in rows if x[i, f] > at]
                        if total(h, left) >= least and total(h, right) >= least:
                            gain = score(left) + score(right) - score(rows)
                            if gain > best[0] + 1e-9 * (1 + gain):
                                best = (gain, f, at, left, right)
                if best[1] is None:
                    for i in every:
                        step[i, c] = -rate * total(g, rows) / (total(h, rows) + smoothing)
                    return
                _, f, at, left, right = best
                node(left, [i for i in every if x[i, f] <= at], level + 1)
                node(right, [i for i in every if x[i, f] > at], level + 1)

            node(taken, list(range(n)), 0)
        margins += step
    return margins


@pytest.mark.parametrize("block_rows,shares", [(1000, (1.0, 1.0)), (64, (0.7, 0.6))])
def test_margins_equal_row_by_row(spark, block_rows, shares):
    x, y, names = table(150)
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(label=y))
    options = {"rounds": 5, "depth": 3, "rate": 0.3, "row_share": shares[0], "column_share": shares[1]}
    model = boosting.fit(df.repartition(3), names, bins=8, seed=3, block_rows=block_rows, checkpoint_every=2, error=0.0, **options)
    edges = boosting.edges_of(df, names, 8, 0.0)
    from pyspark.sql import functions as F

    keyed = df.select(*names, "label", F.xxhash64(*names, F.col("label").cast("int")).alias("key")).toPandas()
    want = row_by_row(keyed[names].to_numpy(), keyed.label.to_numpy(), edges, keyed.key.to_numpy().view(np.uint64), smoothing=1.0, least=1.0, seed=3, **options)
    np.testing.assert_allclose(model.margins(keyed[names].to_numpy()), want, atol=1e-9)
    assert sum(t.feature[0] >= 0 for each in model.trees for t in each) > 10


def test_it_learns_and_reruns_agree(spark):
    x, y, names = table(2000)
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(label=y))
    fits = [boosting.fit(d, names, rounds=15, rate=0.2, block_rows=size, error=0.0) for d, size in ((df, 10_000), (df.repartition(5), 300))]
    margins = [m.margins(x) for m in fits]
    np.testing.assert_allclose(*margins, atol=1e-9)
    assert (margins[0].argmax(1) == y).mean() > 0.8


def test_nothing_to_learn(spark):
    empty = boosting.fit(spark.createDataFrame([], "u double, label int"), ["u"], rounds=2)
    np.testing.assert_allclose(empty.margins(np.zeros((2, 1))), 0)
    flat = boosting.fit(spark.createDataFrame([(1.0, k % 2) for k in range(40)], "u double, label int"), ["u"], n_classes=2, rounds=2)
    assert all(t.feature[0] < 0 for each in flat.trees for t in each)
    with pytest.raises(ValueError):
        boosting.fit(spark.createDataFrame([(1.0, 0)], "u double, label int"), ["u"], bins=1)
