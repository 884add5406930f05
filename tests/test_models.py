"""Model fitting, search, importance and retraining."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.models import evaluate, mlp, network, regressors, retrain, search
from tidegauge.operators import registry, sequence, stats


@pytest.fixture(scope="module")
def linear_data(spark):
    rng = np.random.default_rng(0)
    n = 400
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2]
    y = x @ [3.0, -0.5, 7.0] + 2 + rng.normal(size=n)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, id=range(n))
    return spark.createDataFrame(pdf).cache(), x, y


@pytest.mark.parametrize("alpha", [0.0, 1.0, 10.0])
def test_ridge_closed_form(linear_data, alpha):
    df, x, y = linear_data
    train = regressors.table_frame(df, ["a", "b", "c"], "y")
    model = regressors.fit_ridge(train, alpha) if alpha else regressors.fit_linear(train)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-7)
    assert np.isclose(model.intercept, y.mean() - x.mean(0) @ w, atol=1e-7)


def test_table_search(spark, linear_data):
    df, _, _ = linear_data
    frame = regressors.table_frame(df, ["a", "b", "c"], "y", scale=True, keep=["id"])
    train, valid = frame.filter("id < 300").cache(), frame.filter("id >= 300").cache()
    cands = [("tree", {}), ("ridge", {"alpha": 0.1}), ("forest", {"n_estimators": 5}), ("gbt", {"n_estimators": 5}),
             ("xgboost", {"n_estimators": 4, "max_depth": 4}), ("unheard", {})]
    got = search.table_search(train, valid, cands).collect()
    assert got[0].family == "ridge" and got[-1].family == "unheard" and got[-1].mae == float("inf")
    assert "unknown model family" in got[-1].error and all(r.error is None for r in got[:-1])
    winner = search.best_candidate(spark.createDataFrame(got, search.RESULT_SCHEMA))
    assert winner[:2] == ("ridge", {"alpha": 0.1})
    manifest = search.selection_manifest(spark, winner, 10, 5, ["a"]).first()
    assert json.loads(manifest.selected_params) == {"alpha": 0.1} and manifest.horizon == 5


def test_forecast(spark):
    t = np.arange(120)
    df = spark.createDataFrame(pd.DataFrame({"t": t, "v": np.sin(t / 6.0) * 10 + 20}))
    win = sequence.sliding_windows(df, ["t"], ["v"], "v", 8, 3, multi_output=True).cache()
    train, valid = win.filter("window_start < 80"), win.filter("window_start >= 80")
    got = search.forecast_search(train, valid, 3, [("ridge", {"alpha": 0.001}), ("tree", {})])
    assert [r.family for r in got.collect()] == ["ridge", "tree"]
    with pytest.raises(ValueError):
        search.forecast_search(train.limit(3), valid.limit(3), 3, [])
    model = regressors.fit_multi_output(train, 3, "ridge", {"alpha": 0.001})
    out = evaluate.publish_forecast(df, ["t"], ["v"], 8, model).orderBy("step").collect()
    want = np.sin(np.arange(120, 123) / 6.0) * 10 + 20
    assert [r.step for r in out] == [1, 2, 3] and np.allclose([r.pred for r in out], want, atol=0.05)


@pytest.mark.parametrize("act", network.ACTIVATIONS)
@pytest.mark.parametrize("loss", ["smoothl1", "mse"])
def test_gradient(act, loss):
    rng = np.random.default_rng(1)
    net = network.Network.create(3, (5, 4), act, 2)
    x, y = rng.normal(size=(7, 3)), rng.normal(size=7) * 3
    _, grad = net.gradient(x, y, loss)
    for i in rng.choice(len(net.params), 12, replace=False):
        up, down = net.copy(), net.copy()
        up.params[i] += 1e-6
        down.params[i] -= 1e-6
        num = (up.gradient(x, y, loss)[0] - down.gradient(x, y, loss)[0]) / 2e-6
        assert np.isclose(grad[i], num, atol=1e-4)


def test_network_round_trip():
    net = network.Network.create(3, (4,), "gelu", 1)
    again = network.Network.from_json(net.to_json())
    x = np.ones((2, 3))
    assert np.allclose(net.predict(x), again.predict(x))
    assert np.allclose(net.predict(np.ones((2, 5))), net.predict(x))
    with pytest.raises(ValueError):
        network.Network.create(3, (4,), "mse")


def test_distributed_mlp(linear_data):
    df, x, y = linear_data
    rows = mlp.rows_frame(df, ["a", "b", "c"], "y").withColumn("y", F.col("y") / 10).repartition(3).cache()
    net = network.Network.create(3, (8,), "tanh", 0)
    loss, grad, n = mlp.gradient_sums(rows, net, "smoothl1")
    want_loss, want = net.gradient(x, y / 10, "smoothl1")
    assert n == 400 and np.isclose(loss, want_loss) and np.allclose(grad, want)
    best, history = mlp.fit_mlp(rows, rows, 3, (8,), "tanh", lr=0.05, epochs=10, start=net, freeze=1)
    assert min(history) < history[0]
    assert np.allclose(best.params[: best.frozen(1)], net.params[: net.frozen(1)])


@pytest.mark.parametrize("block_rows", [1000, 100])
def test_mini_batches_equal_a_plain_loop_over_blocks(linear_data, block_rows):
    df, _, _ = linear_data
    rows = mlp.rows_frame(df, ["a", "b", "c"], "y").withColumn("y", F.col("y") / 10).cache()
    best, history = mlp.fit_mlp(rows, rows, 3, (8,), "tanh", lr=0.01, epochs=4, batch_size=16, block_rows=block_rows, seed=5)
    blocks = {}
    for r in sorted(mlp.in_blocks(rows, block_rows).collect(), key=lambda r: r.h):
        blocks.setdefault(r.block, []).append(r)
    assert len(blocks) == -(-400 // block_rows)
    net, opt, want = network.Network.create(3, (8,), "tanh", 5), network.Adam(41, 0.01), []
    state = np.zeros((3, 41))
    state[0] = net.params
    x, y = np.array([r.x for r in rows.collect()]), np.array([r.y for r in rows.collect()])
    steps = 0
    for epoch in range(4):
        total, done = np.zeros((3, 41)), 0
        for block, own in blocks.items():
            one, opt = net.copy(), network.Adam(41, 0.01)
            one.params, opt.m, opt.v, opt.t = (*(s.copy() for s in state), steps)
            bx, by = np.array([r.x for r in own]), np.array([r.y for r in own])
            rng = np.random.default_rng([5, epoch, block])
            for idx in np.array_split(rng.permutation(len(bx)), -(-len(bx) // 16)):
                one.params = opt.step(one.params, one.gradient(bx[idx], by[idx], "smoothl1")[1] / len(idx))
            total += np.stack([one.params, opt.m, opt.v]) * len(bx)
            done = max(done, opt.t)
        state, steps = total / 400, done
        net.params = state[0].copy()
        want.append(float(np.mean((net.predict(x) - y) ** 2)))
    assert np.allclose(history, want) and min(history) < history[0]
    assert np.isclose(np.mean((best.predict(x) - y) ** 2), min(want))


def test_permutation_importance(linear_data):
    df, x, y = linear_data
    vec = df.select("id", F.array("a", "b", "c").alias("x"), "y")
    predict = lambda v: v[0] * 3.0 + v[1] * -0.5 + v[2] * 7.0 + 2.0
    def run(d, rows):
        got = evaluate.permutation_importance(d, ["id"], ["a", "b", "c"], "x", "y", predict, max_rows=rows)
        return {r.feature: r.mae_increase for r in got.collect()}

    order = [r.id for r in vec.select("id", F.md5(F.concat_ws("|", F.lit("0"), "id")).alias("h")).orderBy("h").collect()]
    w = np.array([3.0, -0.5, 7.0])
    base, out = np.abs(x @ w + 2 - y).mean(), []
    for v in range(9):
        xp = x.copy()
        xp[order, v // 3] = np.roll(x[order, v // 3], v + 1)
        out.append(np.abs(xp @ w + 2 - y).mean() - base)
    want = dict(zip("abc", np.array(out).reshape(3, 3).mean(axis=1)))
    for rows in (10**6, 100):
        got, again = run(vec, rows), run(vec.repartition(7), rows)
        assert list(got)[-1] == "c" and all(v > 0 for v in got.values())
        for name in "abc":
            assert np.isclose(got[name], again[name]) and np.isclose(got[name], want[name])
    assert len(run(vec.limit(3), 100)) == 3


def test_scoring_helpers(spark, linear_data):
    df, x, y = linear_data
    sc = stats.StandardScaler.fit(df, ["a", "b", "c"])
    a, b = network.Network.create(3, (4,), seed=1), network.Network.create(2, (4,), seed=2)
    got = evaluate.score_pair(df.select("id", evaluate.scaled_vector(sc).alias("x")), "x", a, b).orderBy("id").toPandas()
    xs = (x - x.mean(0)) / x.std(0)
    assert np.allclose(got.pred_orig, a.predict(xs)) and np.allclose(got.pred_adj, b.predict(xs))
    acc = evaluate.slice_accuracy(df.withColumn("p", F.col("y") * 1.2), ["id"], "tail", 50, "y", "p", 0.25).first()
    assert acc.n == 50 and acc.acc == 100.0


@pytest.fixture(scope="module")
def window(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 3))
    y = x @ [1.0, -2.0, 0.5] + 5
    rows = [(i, [float(v) for v in r], float(t) if i % 10 else None) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, x array<double>, y double").cache()


def test_two_stage_search(spark, window):
    base = network.Network.create(3, (64, 32), "relu", 5)
    res = retrain.two_stage_search(window, ["id"], "A", baseline=base, current=base).cache()
    row = res.first()
    assert row.train_rows + row.val_rows == 108 and row.val_rows == 21
    assert row.rmse < row.baseline_rmse and row.tier == "A"
    entry = retrain.registry_entry(res, 1700)
    got = registry.promotion_gate(entry).first()
    assert got.promoted and float(got.metrics["rmse"]) == pytest.approx(row.rmse)
    net = network.Network.from_json(entry.first().content)
    assert list(net.hidden) == row.hidden


def _blocks(window, n):
    rows = window.filter("y is not null")
    h = F.xxhash64(F.lit(0), "id")
    return rows.select(F.pmod(h, F.lit(n)).cast("int").alias("block"), h.alias("h"), "x", "y"), rows.select("x", "y")


def test_invalid_candidates_are_reported(spark, window):
    train, valid = _blocks(window, 2)
    grid = spark.createDataFrame(
        [(0, "C", 1e-2, 16, [4], "relu", "mse", 0.0), (1, "C", 1e-2, 16, [4], "mse", "mse", 0.0)], retrain.tier_grid(spark, "C").schema)
    got = retrain.score_candidates(grid, train, valid, 3, None, 2, False).orderBy("candidate_id").collect()
    assert got[0].error is None and got[1].error == "unsupported activation: mse" and got[1].rmse == float("inf")
    assert [r.candidate_id for r in retrain.finalists(spark.createDataFrame(got, retrain.RESULT_SCHEMA), 3).collect()] == [0]


def test_one_block_trains_as_a_plain_loop(spark, window):
    grid = spark.createDataFrame(
        [(0, "A", 1e-2, 16, [4], "relu", "mse", 0.0), (1, "A", 5e-2, 32, [4], "tanh", "smoothl1", 1e-4)], retrain.tier_grid(spark, "A").schema)
    train, valid = _blocks(window, 1)
    got = {r.candidate_id: r for r in retrain.score_candidates(grid, train, valid, 3, None, 3, False, seed=3).collect()}
    rows = train.orderBy("h").collect()
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    for c in grid.collect():
        net = network.Network.create(3, c.hidden, c.activation, 3)
        opt = network.Adam(len(net.params), c.lr, c.wd)
        for epoch in range(3):
            network.fit_epochs(net, x, y, opt, c.loss, c.batch_size, np.random.default_rng([3, epoch, 0]))
        assert got[c.candidate_id].rmse == pytest.approx(float(np.sqrt(np.mean((net.predict(x) - y) ** 2))))


def test_windows_of_any_size_take_one_way(spark, window, monkeypatch):
    small = spark.createDataFrame(
        [(0, "A", 1e-2, 16, [4], "relu", "mse", 0.0), (1, "A", 5e-2, 16, [4], "tanh", "mse", 0.0)], retrain.tier_grid(spark, "A").schema)
    monkeypatch.setattr(retrain, "tier_grid", lambda *a: small)
    row, again = (retrain.two_stage_search(w, ["id"], "A", block_rows=20).first() for w in (window, window.repartition(9)))
    assert row.error is None and row.network and row.train_rows == 87
    assert row.rmse == pytest.approx(again.rmse) and row.candidate_id == again.candidate_id


def test_queries_fit_the_full_grids_and_settings(monkeypatch):
    from tidegauge.operators import grids
    from tidegauge.plans import learning

    asked = {}
    monkeypatch.setattr(learning, "_line_split", lambda *_: (None, None))
    monkeypatch.setattr(learning, "_daily_windows", lambda *_: (None, None))
    monkeypatch.setattr(learning.search, "table_search", lambda train, valid, candidates: asked.update(table=candidates))
    monkeypatch.setattr(learning.search, "forecast_search", lambda train, valid, horizon, candidates: asked.update(forecast=candidates))
    monkeypatch.setattr(learning, "_fit_report", lambda spark, sf_dir, family, params: asked.update({family: params["n_estimators"]}))
    for name in ("grid_search", "forecast_search", "forest_fit", "gbt_fit", "boosted_fit"):
        getattr(learning, name)(None, None)
    assert all(c in asked["table"] for c in grids.table_grid()) and asked["forecast"] == grids.forecast_grid()
    assert (asked["forest"], asked["gbt"], asked["xgboost"]) == (200, 200, 400)


def test_epochs_read_packed_blocks_where_they_lie(spark, monkeypatch):
    rows = spark.range(3_000).select(
        F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double")).alias("x"),
        F.when(F.col("id") % 9 > 0, (F.col("id") % 11).cast("double")).alias("y"),
    )
    kept = rows.where("y is not null")
    seen = []
    own = retrain.batch_epoch
    monkeypatch.setattr(retrain, "batch_epoch", lambda blocks, *a: seen.append(blocks) or own(blocks, *a))
    mlp.fit_mlp(kept, rows, 2, (4,), epochs=3, batch_size=16, block_rows=100, seed=1)
    assert len(seen) == 3 and all(b is seen[0] for b in seen)
    assert seen[0].count() == len({r.block for r in mlp.in_blocks(kept, 100).collect()})  # a row a block: no sort or shuffle of rows
    net = network.Network.create(2, (4,), seed=1)
    held = [(r.x, r.y) for r in rows.collect() if r.y is not None]
    want = np.mean((net.predict(np.array([x for x, _ in held])) - np.array([y for _, y in held])) ** 2)
    assert mlp.mean_squared_error(rows, net) == pytest.approx(want)
    assert mlp.mean_squared_error(rows.where("y is null"), net) is None
