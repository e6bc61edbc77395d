import datetime as dt
import itertools
import math
import uuid

import numpy as np
import pandas as pd
import pytest
from panels import panel
from pyspark.sql import functions as F

from pairlens.operators import ensemble, garch, regimes
from pairlens.operators import features as f
from pairlens.operators import signals as s
from pairlens.plans import pipeline
from pairlens.sources import bars as src


def test_hidden_states_are_found_again(spark):
    rng = np.random.default_rng(2)
    state, x = 0, []
    centres = np.array([[0, 0], [4, 0], [0, 4], [4, 4.0]])
    truth = []
    for _ in range(1200):
        state = state if rng.random() < 0.95 else rng.integers(4)
        truth.append(state)
        x.append(centres[state] + rng.normal(0, 0.5, 2))
    p = pd.DataFrame(x, columns=["u", "v"]).assign(series_id="s", ts=pd.date_range("2020-01-01", periods=1200))
    df = spark.createDataFrame(p)
    model = regimes.hmm_fit(df, ["u", "v"], n_restarts=3, max_iter=15)
    got = regimes.hmm_states(df, model).orderBy("ts").toPandas().regime_state
    best = sum(pd.crosstab(got, pd.Series(truth)).max(axis=1)) / 1200
    assert best > 0.97
    np.testing.assert_allclose(model.move.sum(1), 1)


def sequential_messages(model, x):
    """Forward and backward messages row after row."""
    b = np.exp(model.log_density(x))
    n, k = b.shape
    forward, back = np.empty((n, k)), np.ones((n, k))
    forward[0] = model.start * b[0]
    for t in range(1, n):
        forward[t] = forward[t - 1] @ model.move * b[t]
    for t in range(n - 2, -1, -1):
        back[t] = model.move @ (b[t + 1] * back[t + 1])
    total = forward[-1].sum()
    moves = sum(np.outer(forward[t - 1], b[t] * back[t]) * model.move for t in range(1, n)) / total
    return np.log(total), forward * back / total, moves


def small_model(seed=3, k=3, d=2):
    rng = np.random.default_rng(seed)
    return regimes.HiddenMarkov(["u", "v"], np.zeros(d), np.ones(d), rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.normal(0, 1, (k, d)), np.stack([np.eye(d)] * k)), rng


def test_messages_by_blocks_equal_those_row_by_row():
    model, rng = small_model()
    x = rng.normal(0, 1, (150, 2))
    ll, g, moves = sequential_messages(model, x)
    got = regimes.expectation(model, x)
    assert got[0] == pytest.approx(ll)
    np.testing.assert_allclose(got[1], g, atol=1e-9)
    np.testing.assert_allclose(got[2], moves, atol=1e-9)
    # two blocks, with what reaches each from the other
    a, b = x[:70], x[70:]
    outgoing, incoming = regimes.transfer(model, b, False) @ np.ones(3), model.start @ regimes.transfer(model, a, True)
    one, two = regimes.expectation(model, a, True, None, outgoing), regimes.expectation(model, b, False, incoming, None)
    assert one[0] + two[0] == pytest.approx(ll)
    np.testing.assert_allclose(np.concatenate([one[1], two[1]]), g, atol=1e-9)
    np.testing.assert_allclose(one[2] + two[2], moves, atol=1e-9)


def test_a_series_in_many_blocks(spark):
    model, rng = small_model()
    p = pd.concat([pd.DataFrame(rng.normal(0, 1.5, (n, 2)), columns=["u", "v"]).assign(series_id=s, ts=pd.date_range("2020-01-01", periods=n)) for s, n in (("x", 230), ("y", 40), ("z", 1))])
    df = spark.createDataFrame(p)
    paths = [regimes.hmm_states(df, model, block_rows=size).orderBy("series_id", "ts").toPandas() for size in (32, 4096)]
    pd.testing.assert_frame_equal(*paths)
    fits = [regimes.hmm_fit(df, ["u", "v"], n_states=2, n_restarts=2, max_iter=4, block_rows=size) for size in (32, 4096)]
    assert fits[0].log_likelihood == pytest.approx(fits[1].log_likelihood) and fits[0].rounds == 4 and not fits[0].converged
    np.testing.assert_allclose(fits[0].centre, fits[1].centre, atol=1e-8)
    # the likeliest of all paths, by trying them
    few = p[p.series_id == "x"].head(7)
    d, best = model.log_density(few[["u", "v"]].to_numpy()), []
    for path in itertools.product(range(3), repeat=7):
        best.append((np.log(model.start[path[0]]) + sum(np.log(model.move[i, j]) for i, j in zip(path, path[1:])) + sum(d[t, k] for t, k in enumerate(path)), path))
    got = regimes.hmm_states(spark.createDataFrame(few), model, block_rows=3).orderBy("ts").toPandas().regime_state
    assert tuple(got) == max(best)[1]


def test_models_side_by_side_and_runs_of_blocks():
    models = [small_model(seed)[0] for seed in (3, 4, 5)]
    x = np.random.default_rng(6).normal(0, 1, (120, 2))
    joint = regimes.Joint(models, length=16)
    got = list(joint.run([x[:70], x[70:71], x[71:]], True, None, None))
    for m, model in enumerate(models):
        ll, g, moves = sequential_messages(model, x)
        assert sum(b[2][m] for b in got) == pytest.approx(ll)
        np.testing.assert_allclose(np.concatenate([b[3][m] for b in got]), g, atol=1e-9)
        np.testing.assert_allclose(sum(b[4][m] for b in got), moves, atol=1e-9)


def uneven(spark):
    """Series of many blocks, few rows and one row; and a model of each restart."""
    _, rng = small_model()
    p = pd.concat([pd.DataFrame(rng.normal(0, 1.5, (n, 2)), columns=["u", "v"]).assign(series_id=s, ts=pd.date_range("2020-01-01", periods=n)) for s, n in (("w", 1), ("x", 120), ("y", 40), ("z", 90))])
    return spark.createDataFrame(p), p


def test_rounds_over_blocks_that_lie_in_any_partitions(spark):
    """Few or many neighbours in a partition: the sums are those of whole series."""
    df, p = uneven(spark)
    models = [small_model(seed)[0] for seed in (3, 4)]
    whole = [sum(sequential_messages(m, x[["u", "v"]].to_numpy())[0] for _, x in p.groupby("series_id")) for m in models]
    for size in (8, 64, 4096):
        best = regimes.hmm_fit(df, initial=models, max_iter=1, block_rows=size)
        assert best.log_likelihood == pytest.approx(max(whole))
        blocks = regimes.series_blocks(df, ["u", "v"], np.zeros(2), np.ones(2), size)
        joint = regimes.Joint(models)
        for a_task in (1, 3, 1000):
            held = regimes.held_blocks(blocks, 2, a_task)
            sides = regimes._messages(held, joint)
            found = held.mapPartitions(lambda part, sides=sides: [sum((b[2] for key, at, x in regimes.runs(part) for b in joint.run(x, at == 0, *sides.get((key, at), (None, None)))), np.zeros(2))]).sum()
            np.testing.assert_allclose(found, whole)


def jobs_of(spark, fit):
    """(jobs, stages that were not skipped) that fit ran."""
    context, group = spark.sparkContext, f"fit-{uuid.uuid4()}"
    context.setJobGroup(group, "")
    fit()
    tracker = context.statusTracker()
    jobs = tracker.getJobIdsForGroup(group)
    context.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(k) for k in {k for j in jobs for k in tracker.getJobInfo(j).stageIds}]
    return len(jobs), sum(bool(k and k.numCompletedTasks) for k in stages)


def test_a_round_is_two_jobs_without_a_shuffle(spark):
    """Also where series have many blocks; and a restart costs what draws its first centres, not a job for each round of its mixture."""
    df, _ = uneven(spark)
    models = [small_model(seed)[0] for seed in (3, 4)]
    few, many = (jobs_of(spark, lambda n=n: regimes.hmm_fit(df, initial=models, max_iter=n, tol=-np.inf, block_rows=16)) for n in (1, 6))
    assert many[0] - few[0] <= 10 and many[1] - few[1] <= 10
    two, five = (jobs_of(spark, lambda n=n: regimes.hmm_fit(df, ["u", "v"], 2, n, max_iter=1)) for n in (2, 5))
    assert five[0] - two[0] <= 3 * 6


def test_mixtures_side_by_side_are_those_of_spark(spark):
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    df, _ = uneven(spark)
    # a feature that never changes: covariances have no width in its direction
    df = df.withColumn("w", F.lit(0.0)).cache()
    names, zero, one = ["u", "v", "w"], np.zeros(3), np.ones(3)
    held = regimes.held_blocks(regimes.series_blocks(df, names, zero, one, 50), 3)
    got = regimes.starts(df, held, names, zero, one, 2, 2, seed=7)
    vectors = VectorAssembler(inputCols=names, outputCol="f").transform(df.select(*regimes.standardised(df, names, zero, one))).select("f").persist()
    for k, model in enumerate(got):
        of_spark = GaussianMixture(featuresCol="f", k=2, seed=7 + k, maxIter=8).fit(vectors)
        np.testing.assert_allclose(model.centre, [g.mean.toArray() for g in of_spark.gaussians], atol=1e-9)
        np.testing.assert_allclose(model.covariance - 0.05 * np.eye(3), [g.cov.toArray() for g in of_spark.gaussians], atol=1e-9)
    vectors.unpersist()
    df.unpersist()


def test_fits_that_do_not_look_ahead(spark):
    model, rng = small_model()
    p = pd.DataFrame(rng.normal(0, 1, (200, 2)), columns=["u", "v"]).assign(series_id="s", ts=pd.date_range("2020-01-01", periods=200))
    later = p.assign(u=np.where(np.arange(200) >= 100, 50.0, p.u))
    fits = [regimes.hmm_fit(regimes.fit_rows(spark.createDataFrame(x), 0.5), ["u", "v"], 2, 1, 3) for x in (p, later)]
    np.testing.assert_allclose(fits[0].state_means(), fits[1].state_means())
    means, moves = regimes.model_tables(spark, regimes.HiddenMarkov(["a_atr_pct", "ratio_zscore_30"], np.zeros(2), np.ones(2), model.start, model.move, model.centre, model.covariance))
    assert means.count() == 6 and moves.groupBy("from_state").sum("probability").where("abs(`sum(probability)` - 1) > 1e-9").count() == 0


def test_state_names():
    means = np.array([[0.9, 2.0], [0.1, 0.0], [0.5, -1.0], [0.6, 1.0]])
    assert regimes.name_states(means, ["a_atr_pct", "ratio_zscore_30"]) == {0: "crisis", 1: "range_bound", 2: "risk_on", 3: "trending"}
    assert len(regimes.name_states(means[:3], ["a_atr_pct", "ratio_zscore_30"])) == 3


def test_too_few_rows(spark):
    with pytest.raises(ValueError, match="too few"):
        regimes.hmm_fit(spark.createDataFrame([("s", k, 1.0) for k in range(5)], "series_id string, ts int, u double"), ["u"])


def test_transitions_and_bands(spark):
    names = ["a", "a", "b", None, "a", "b", "b"]
    df = spark.createDataFrame([("s", k, n) for k, n in enumerate(names)], "series_id string, ts int, regime string")
    got = {(r.from_regime, r.to_regime): r.probability for r in regimes.regime_transitions(df).collect()}
    assert got == pytest.approx({("a", "a"): 1 / 3, ("a", "b"): 2 / 3, ("b", "a"): 1 / 2, ("b", "b"): 1 / 2})
    bands = [(r.regime, r.band_start, r.band_end) for r in regimes.regime_bands(df).orderBy("band_start").collect()]
    assert bands == [("a", 0, 2), ("b", 2, 3), ("a", 4, 5), ("b", 5, 6)]


def test_garch_parameters_are_found_again(spark):
    rng = np.random.default_rng(9)
    v, r = 1.0, []
    for _ in range(4000):
        e = rng.normal(0, np.sqrt(v))
        r.append(e / 100)
        v = 0.1 + 0.1 * e * e + 0.8 * v
    df = spark.createDataFrame(pd.DataFrame({"series_id": "s", "ts": pd.date_range("2000-01-01", periods=4000), "r": r}))
    fit = garch.garch_fit(df, "r").first()
    assert fit.alpha == pytest.approx(0.1, abs=0.05) and fit.beta == pytest.approx(0.8, abs=0.1)


def plain_likelihood(r, shift, omega, alpha, beta):
    e = r - r.mean()
    v, total, u = np.mean(e * e), 0.0, e - shift
    for t in range(len(e)):
        if t:
            v = omega + alpha * u[t - 1] ** 2 + beta * v
        total -= 0.5 * (np.log(v) + u[t] ** 2 / v)
    return total


def test_garch_likelihood_over_all_parameters(spark):
    """No neighbour is likelier, by a likelihood row after row; never below the grid's; planted parameters are found."""
    rng = np.random.default_rng(10)
    parts = []
    for name, n, (omega, alpha, beta) in (("s", 6000, (0.1, 0.1, 0.8)), ("t", 1500, (0.4, 0.25, 0.5))):
        v, r = omega / (1 - alpha - beta), []
        for _ in range(n):
            e = rng.normal(0, np.sqrt(v))
            r.append((0.05 + e) / 100)
            v = omega + alpha * e * e + beta * v
        parts.append(pd.DataFrame({"series_id": name, "ts": pd.date_range("2000-01-01", periods=n), "r": r}))
    rows = garch.centred(spark.createDataFrame(pd.concat(parts)), ["r"]).persist()
    grid = garch.fit_legs(rows)
    before = {r.series_id: r.ll for r in grid.collect()}
    got = {r.series_id: r for r in garch.likelihood_fit(rows, grid, steps=6).collect()}
    for part, truth in zip(parts, ((0.1, 0.1, 0.8), (0.4, 0.25, 0.5))):
        r = got[part.series_id[0]]
        found, x = np.array([r.shift, r.omega, r.alpha, r.beta]), part.r.to_numpy() * 100
        best = plain_likelihood(x, *found)
        assert r.ll == pytest.approx(best) and r.ll >= before[r.series_id] - 1e-9
        for k in range(4):
            for side in (-1, 1):
                near = found.copy()
                near[k] += side * max(0.02 * abs(found[k]), 0.004)
                assert plain_likelihood(x, *near) < best + 1e-3
        np.testing.assert_allclose(found[1:], truth, rtol=0.35)
    rows.unpersist()


def test_volatility_of_both_garch_fits(spark):
    """Both give a volatility on every row with a return; the frame has complete rows only, fitted before the others went."""
    from pyspark.sql import functions as sf

    bars = spark.createDataFrame(panel(400))
    frames = [pipeline.garch_features(bars, steps).orderBy("ts").toPandas() for steps in (0, 2)]
    assert len(frames[0]) == len(frames[1]) == f.feature_frame(bars).count()
    assert all((x.a_cond_vol > 0).all() and "a_ewm_vol" in x for x in frames)
    every = garch.with_garch(f.all_features(bars))
    assert every.count() == 400 and every.where(sf.col("a_garch_vol").isNull()).count() == 1
    late = every.where("ratio_zscore_90 is not null").orderBy("ts").toPandas()
    np.testing.assert_allclose(late.a_garch_vol, frames[0].a_cond_vol, rtol=1e-9)


def test_attributions_add_up(spark):
    df = s.strategy_signals(regimes.rule_regime(f.feature_frame(spark.createDataFrame(panel(300, ("x", "y")))))).persist()
    model = ensemble.fit(df, n_trees=4)
    out = ensemble.predict(df, model).where("predicted is not null").toPandas()
    shap = out[[c for c in out if c.startswith("shap_")]].sum(axis=1)
    np.testing.assert_allclose(shap + out.base, out.margin, atol=1e-9)
    assert out.ensemble_confidence.between(1 / 3 - 1e-9, 1).all()
    for each in model.trees:  # the leaves of each tree share all training weight
        assert [sum(leaf.share for leaf in ensemble.leaves(t)) for t in each] == pytest.approx([1, 1, 1])
    assert ensemble.top_features(spark.createDataFrame(out), 3).count() == 3
    with pytest.raises(ValueError):
        ensemble.top_features(df, 3)


def test_rows_of_equal_times_stay_one_for_one(spark):
    p = panel(300)
    p = pd.concat([p, p.iloc[[250, 250, 280]].assign(a_close=lambda d: d.a_close * 1.001)])
    df = s.strategy_signals(regimes.rule_regime(f.feature_frame(spark.createDataFrame(p))))
    n = df.count()
    both = ensemble.fit_and_predict(df, n_trees=2)
    complete = ensemble.feature_matrix(df).count()
    assert both.count() == n and both.where("predicted is not null").count() == complete > 150
    assert set(df.columns) < set(both.columns)
    for model in ("hmm", "gmm"):
        got = regimes.fit_and_label(df.drop("regime"), n_states=2, n_restarts=1, model=model, max_iter=2)
        assert got.count() == n and got.where("regime is null").count() == 0 and regimes.ROW not in got.columns
    holes = df.withColumn("a_macd_hist", F.when(F.col("ts") < "2020-05-01", None).otherwise(F.col("a_macd_hist")))
    got = ensemble.fit_and_predict(holes, n_trees=1)
    assert got.count() == n and got.where("predicted is not null and a_macd_hist is null").count() == 0


def test_labels_look_at_all_rows(spark):
    """The threshold is that of all rows, also of those that the model cannot use."""
    df = s.strategy_signals(regimes.rule_regime(f.feature_frame(spark.createDataFrame(panel(300)))))
    holes = df.withColumn("a_macd_hist", F.when(F.col("ts") < "2020-07-01", None).otherwise(F.col("a_macd_hist")))
    seen = {}
    before = ensemble.boosting.fit
    ensemble.boosting.fit = lambda rows, *a, **k: seen.update(rows=rows.count(), labels=rows.groupBy("label").count().collect()) or before(rows, *a, **k)
    try:
        ensemble.fit(holes, n_trees=1)
    finally:
        ensemble.boosting.fit = before
    want = s.train_test_split(s.target_labels(holes).dropna(subset=["a_macd_hist"])).where("is_train").groupBy("label").count().collect()
    assert sorted(map(tuple, seen["labels"])) == sorted(map(tuple, want)) and seen["rows"] == sum(r["count"] for r in want)


def by_subsets(leaf, x):
    """Shapley values of a leaf from all subsets of the other features on its path."""
    m, phi = len(leaf.path), np.zeros(len(x))
    along = [float(lo < x[f_] <= hi) for f_, lo, hi, _ in leaf.path]
    for i, (f_, *_) in enumerate(leaf.path):
        rest = [j for j in range(m) if j != i]
        for size in range(m):
            for known in itertools.combinations(rest, size):
                weight = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                phi[f_] += weight * leaf.value * (along[i] - leaf.path[i][3]) * math.prod(along[j] if j in known else leaf.path[j][3] for j in rest)
    return phi


@pytest.mark.parametrize("depth", [1, 4, 7])
def test_attributions_equal_all_subsets(depth):
    rng = np.random.default_rng(depth)
    trees = [[ensemble.Leaf(rng.normal(), [(int(k), *sorted(rng.normal(size=2)), rng.uniform(0.05, 0.95)) for k in rng.choice(9, depth, replace=False)]) for _ in range(5)] for _ in range(3)]
    x = rng.normal(size=(20, 9))
    want = [sum(by_subsets(leaf, row) for tree in trees for leaf in tree) for row in x]
    np.testing.assert_allclose(ensemble.attributions(trees, x), want, atol=1e-10)


def test_attributions_of_deep_trees():
    """A thousand leaves of depth 10 add up to their part of the margin, as they could not over all subsets."""
    rng = np.random.default_rng(1)
    trees = [[ensemble.Leaf(rng.normal(), [(int(k), *np.sort(rng.normal(size=2)), rng.uniform(0.01, 0.99)) for k in rng.choice(22, 10, replace=False)]) for _ in range(1000)]]
    x = rng.normal(size=(200, 22))
    inside = lambda leaf, row: math.prod(float(lo < row[k] <= hi) for k, lo, hi, _ in leaf.path)
    want = [sum(leaf.value * (inside(leaf, row) - math.prod(z for *_, z in leaf.path)) for leaf in trees[0]) for row in x[:20]]
    np.testing.assert_allclose(ensemble.attributions(trees, x).sum(1)[:20], want, atol=1e-8)


def test_attributions_of_a_hand_made_tree():
    inf = float("inf")
    tree = [ensemble.Leaf(1.0, [(0, -inf, 0.0, 0.5)]), ensemble.Leaf(3.0, [(0, 0.0, inf, 0.5)])]
    phi = ensemble.attributions([tree], np.array([[-1.0], [1.0]]))
    np.testing.assert_allclose(phi[:, 0], [-1, 1])


def test_pairs_of_many_instruments_are_dealt_out(spark):
    quotes = spark.createDataFrame([(f"i{k:03d}", t, float(k + t)) for k in range(120) for t in range(2)], "ticker string, ts int, close double")
    plain = src.pair_universe(quotes).collect()
    dealt = src.pair_universe(quotes, 5).collect()
    assert sorted(map(tuple, dealt)) == sorted(map(tuple, plain)) and len(plain) == 2 * 120 * 119 // 2
    # 15 keys a time in place of one, none with more than the pairs of two buckets
    own = quotes.where("ts = 0").select(F.pmod(F.xxhash64("ticker"), F.lit(5)).alias("b")).groupBy("b").count().collect()
    assert len(own) == 5 and max(r["count"] for r in own) ** 2 < len(plain) / 2 / 4


def test_sources(spark, tmp_path):
    df = spark.createDataFrame(panel(20))
    src.write_stage(df, str(tmp_path / "p"))
    assert src.read_first_available(spark, [str(tmp_path / "none"), str(tmp_path / "p")]).count() == 20
    assert src.read_bars(spark, str(tmp_path / "p"), since="2020-01-11 00:00:00").count() == 10
    holes = spark.createDataFrame([("s", dt.datetime(2020, 1, 1), float("nan"), 1.0)], src.BARS)
    src.write_stage(holes, str(tmp_path / "holes"), partition_by=None)
    assert src.read_bars(spark, str(tmp_path / "holes")).first().a_close is None and src.read_first_available(spark, [str(tmp_path / "holes")]).first().a_close is None
    with pytest.raises(FileNotFoundError):
        src.read_first_available(spark, [str(tmp_path / "none")])
    q = spark.createDataFrame([("s", 1, "A", "close", 1.0), ("s", 1, "B", "close", 2.0), ("s", 2, "A", "close", 3.0), ("s", 1, "A", "open", 9.0)], "series_id string, ts int, ticker string, field string, value double")
    assert [tuple(r) for r in src.quotes_to_bars(q, "A", "B").collect()] == [("s", 1, 1.0, 2.0)]
    assert src.pair_universe(q.where("field = 'close'").select("ticker", "ts", F.col("value").alias("close"))).count() == 1


def test_leaps_reach_the_same_optimum_in_fewer_rounds():
    """More states than there are, which plain rounds take long to settle."""
    rng = np.random.default_rng(12)
    state, x = 0, []
    for _ in range(900):
        state = state if rng.random() < 0.9 else rng.integers(3)
        x.append(np.array([[0, 0], [0.9, 0], [0, 0.9]])[state] + rng.normal(0, 0.6, 2))
    x, k = (np.array(x) - np.mean(x, 0)) / np.std(x, 0), 5

    def plain(m):
        ll, g, moves = regimes.expectation(m, x)
        mass, moves = g.sum(0), moves + 1e-8
        centre = (g.T @ x) / mass[:, None]
        covariance = np.stack([(x * g[:, [j]]).T @ x for j in range(k)]) / mass[:, None, None] - np.einsum("ki,kj->kij", centre, centre) + 1e-3 * np.eye(2)
        return ll, regimes.replace(m, start=g[0] / g[0].sum(), move=moves / moves.sum(1, keepdims=True), centre=centre, covariance=covariance)

    rounds = []
    for seed in range(3):
        near = np.random.default_rng(seed).choice(900, k)
        first = regimes.HiddenMarkov(["u", "v"], np.zeros(2), np.ones(2), np.full(k, 1 / k), np.full((k, k), 0.1 / k) + 0.9 * np.eye(k), x[near], np.stack([np.eye(2)] * k))
        m = first
        best = -np.inf
        for n in range(1, 1000):
            ll, m = plain(m)
            if ll - best < 1e-4:
                break
            best = ll
        climber, now = regimes.Climber(first), first
        while not now.converged:
            now = climber.step(*plain(now), 1e-4)
        assert now.log_likelihood >= best - 0.01
        rounds.append((now.rounds, n))
    assert sum(a for a, _ in rounds) < 0.55 * sum(b for _, b in rounds)
