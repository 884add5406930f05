"""Trees from histograms and linear models from sums, against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidegauge.models import linear, regressors, search, trees
from tidegauge.models.trees import Settings, fit_trees
from tidegauge.operators import grids


def frame_of(spark, x, y):
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(x.shape[1])]).assign(y=y)
    return regressors.table_frame(spark.createDataFrame(pdf), [f"c{i}" for i in range(x.shape[1])], "y")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 6, 400), rng.integers(0, 40, 400) / 4, rng.integers(-3, 3, 400)], axis=1).astype(float)
    y = np.where(x[:, 0] > 2, 5.0, -1.0) * x[:, 2] + x[:, 1] + rng.standard_normal(400)
    return frame_of(spark, x, y), x, y


def soft(g, a):
    return np.sign(g) * max(abs(g) - a, 0)


def plain_tree(x, g, depth, s):
    """Leaf values of every row from all cuts between neighbouring values."""
    weight = -soft(g.sum(), s.l1) / (len(g) + s.l2)
    best = (1e-9, None, None)
    for f in range(x.shape[1]) if depth else ():
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) < s.least:
                continue
            score = [soft(p.sum(), s.l1) ** 2 / (len(p) + s.l2) for p in (g[left], g[~left], g)]
            gain = score[0] + score[1] - score[2]
            if gain > best[0] + 1e-9:
                best = (gain, f, cut)
    if best[1] is None:
        return np.full(len(g), weight)
    out, left = np.empty(len(g)), x[:, best[1]] <= best[2]
    for part in (left, ~left):
        out[part] = plain_tree(x[part], g[part], depth - 1, s)
    return out


def plain_boost(x, y, s):
    pred = np.full(len(y), y.mean())
    for _ in range(s.rounds):
        pred += s.rate * plain_tree(x, pred - y, s.depth, s)
    return pred


@pytest.mark.parametrize(
    "s",
    [Settings("boost", 2, 2, 0.3, l2=1.0), Settings("boost", 2, 2, 0.3, l2=2.0, l1=20.0), Settings("boost", 5, 3, 0.5, least=20), Settings("boost", 1, 6, 1.0, least=5)],
)
def test_boosting_equals_a_plain_loop(data, s):
    df, x, y = data
    assert np.allclose(fit_trees(df, [s]).predict(x)[:, 0], plain_boost(x, y, s))


def test_a_tree_equals_a_plain_loop(data):
    df, x, y = data
    s = regressors.tree(max_depth=4)
    assert np.allclose(fit_trees(df, [s]).predict(x)[:, 0], y.mean() + plain_tree(x, y.mean() - y, 4, s))


CANDIDATES = [
    regressors.forest(6, 4), regressors.forest(3, 2), regressors.gbt(7, 0.1), regressors.gbt(3, 0.1),
    regressors.xgboost(5, 4), regressors.xgboost(2, 4), regressors.tree(3), regressors.tree(5),
]


def test_fitting_together_equals_fitting_alone(data):
    df, x, _ = data
    together = fit_trees(df, CANDIDATES)
    assert len(together.chains) == 4
    for i, s in enumerate(CANDIDATES):
        assert np.allclose(together.predict(x)[:, i], fit_trees(df, [s]).predict(x)[:, 0])


def test_spread_cells_grow_the_same_trees(data, monkeypatch):
    df, x, _ = data
    monkeypatch.setattr(trees, "KEPT_ROUNDS", 3)
    monkeypatch.setattr(trees, "LEVEL_TREES", 4)
    held, spread = (fit_trees(df.repartition(5), CANDIDATES, table_bytes=b) for b in (1 << 20, 0))
    assert np.allclose(held.predict(x), spread.predict(x))
    assert [len(t) for t in held.trees] == [len(t) for t in spread.trees]


def test_many_partial_sums_are_added_in_tasks(data, monkeypatch):
    from tidegauge.models import sums

    df, x, _ = data
    want = fit_trees(df, CANDIDATES[2:4], table_bytes=0).predict(x)
    monkeypatch.setattr(sums, "FEW_PARTS", 1)
    assert np.allclose(fit_trees(df.repartition(4), CANDIDATES[2:4], table_bytes=0).predict(x), want)


def test_forest_averages_trees_of_drawn_parts(data):
    df, x, y = data
    fitted = fit_trees(df, [regressors.forest(40, 5, 1)])
    got = fitted.predict(x)[:, 0]
    assert np.corrcoef(got, y)[0, 1] > 0.9 and len({t.value.tobytes() for t in fitted.trees[0]}) > 30
    parts, columns = Settings("boost", rows=0.8, columns=0.7).draw(4, 10)
    assert parts.sum() == 16 and columns.sum() == 7 and set(parts) == {0, 1}


def test_wide_and_odd_features(spark):
    rng = np.random.default_rng(1)
    x = np.stack([rng.standard_normal(3000), np.full(3000, 7.0)], axis=1)
    y = np.where(x[:, 0] > 0.5, 10.0, 0.0)
    fitted = fit_trees(frame_of(spark, x, y), [regressors.tree(4)], max_bins=64)
    assert len(fitted.cuts[0]) <= 63 and len(fitted.cuts[1]) == 0
    assert np.abs(fitted.predict(x)[:, 0] - y).mean() < 0.3
    constant = fit_trees(frame_of(spark, x[:50], np.full(50, 3.0)), [regressors.gbt(3)])
    assert np.allclose(constant.predict(x[:5]), 3.0)
    with pytest.raises(ValueError):
        fit_trees(frame_of(spark, x, y).limit(0), [regressors.tree()])


def test_ridge_for_all_penalties_and_steps(spark):
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((200, 3)) * [1, 1e3, 1e-3] + [1e6, 0, 5], rng.standard_normal((200, 2)) + 1e5
    pdf = pd.DataFrame({"x": x.tolist(), "y": y.tolist()})
    got = {(r.alpha, r.step, r.term): r.value for r in linear.ridge_path(spark.createDataFrame(pdf), F.col("x"), F.col("y"), [1e-6, 1.0, 50.0]).collect()}
    xc, yc = x - x.mean(0), y - y.mean(0)
    for alpha in (1e-6, 1.0, 50.0):
        w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
        for j in (0, 1):
            assert np.allclose([got[alpha, j + 1, f"w{i}"] for i in range(3)], w[:, j], rtol=1e-6)
            assert np.isclose(got[alpha, j + 1, "intercept"], y[:, j].mean() - x.mean(0) @ w[:, j])


def test_linear_with_a_repeated_feature(spark):
    x = np.arange(20.0)
    model = regressors.fit_linear(frame_of(spark, np.stack([x, x], axis=1), 4 * x + 1))
    assert np.allclose(model.coefficients, [2, 2]) and np.isclose(model.intercept, 1)


def test_search_marks_what_cannot_be_fitted(data):
    df, _, _ = data
    cands = [("gbt", {"n_estimators": 0}), ("ridge", {"beta": 1}), ("linear", {}), ("forest", {"n_estimators": 3}), ("ridge", {"alpha": -1.0})]
    got = {r.candidate_id: r for r in search.table_search(df, df, cands).collect()}
    assert [got[i].error is None for i in range(5)] == [False, False, True, True, False]
    assert all(got[i].mae == float("inf") for i in (0, 1, 4)) and got[3].mae < got[2].mae
    assert search.table_search(df, df, cands[:1]).count() == 1


def test_full_grids_share_chains():
    s = [regressors.tree_settings(f, p) for f, p in grids.table_grid() if f in regressors.TREES]
    assert len(s) == 27 and len({x.chain() for x in s}) == 7
    s = [regressors.tree_settings(f, p) for f, p in grids.forecast_grid() if f in regressors.TREES]
    assert len(s) == 12 and len({x.chain() for x in s}) == 6


def test_a_combination_of_bins_passes_the_trees_once(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector

    from tidegauge.models import search

    x = F.array((F.col("id") % 5).cast("double"), F.when(F.col("id") % 7 < 6, (F.col("id") % 7).cast("double")))
    label = F.when(F.col("id") % 11 > 0, (F.col("id") % 5 * 3 + F.col("id") % 13).cast("double"))
    rows = spark.range(5_000).repartition(8).select(array_to_vector(F.transform(x, lambda v: F.coalesce(v, F.lit(float("nan"))))).alias("features"), label.alias("label"))
    scored = []
    join = search.join_facts
    monkeypatch.setattr(search, "join_facts", lambda left, facts, keys: scored.append(facts.count()) or join(left, facts, keys))
    fitted = search.Fitted(rows, [("tree", {}), ("ridge", {}), ("gbt", {"n_estimators": 3}), ("xgboost", {"n_estimators": 2})])
    got = fitted.predictions(rows).collect()
    assert scored == [35]  # of 5,000 rows
    held = rows.select(vector_to_array("features").alias("x"), "label").collect()
    want = fitted.trees.predict(np.array([r.x for r in held]))
    key = lambda label, p: (-1.0 if label is None else label, *np.round(p, 6))
    assert len(got) == 5_000 and all(len(r["__p"]) == 4 for r in got)
    assert sorted(key(r.label, r["__p"][1:]) for r in got) == sorted(key(r.label, p) for r, p in zip(held, want, strict=True))
