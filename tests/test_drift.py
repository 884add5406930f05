"""Divergence and drift operators against numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import drift as d
from tidegauge.operators import histogram as h


def np_js(base, win, bins, rng=None):
    lo, hi = rng or (min(base.min(), win.min()), max(base.max(), win.max()))
    if hi <= lo:
        return None
    eps = 1e-12
    p = np.histogram(np.clip(base, lo, hi), bins=bins, range=(lo, hi), density=True)[0] + eps
    q = np.histogram(np.clip(win, lo, hi), bins=bins, range=(lo, hi), density=True)[0] + eps
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return 0.5 * np.sum(p * np.log(p / m)) + 0.5 * np.sum(q * np.log(q / m))


def np_windows(x, size, stride, bins, frozen=False):
    out = {}
    base = x[:size]
    for k in range(1, (len(x) - size) // stride + 1):
        win = x[k * stride : k * stride + size]
        scores = []
        for j in range(x.shape[1]):
            rng = (base[:, j].min(), base[:, j].max()) if frozen else None
            if frozen and rng[1] <= rng[0]:
                continue
            s = np_js(base[:, j], win[:, j], bins, rng)
            if s is not None:
                scores.append(s)
        out[k] = float(np.mean(scores)) if scores else 0.0
    return out


@pytest.fixture(scope="module")
def drifting(spark):
    rng = np.random.default_rng(3)
    parts = []
    for name, n in (("hot", 900), ("b", 260), ("c", 90), ("flat", 130)):
        t = np.arange(n)
        a = rng.normal(size=n) + (t > n / 2) * 2.5
        b = rng.exponential(size=n)
        if name == "flat":
            a, b = np.ones(n), np.full(n, 2.0)
        parts.append(pd.DataFrame({"g": name, "t": t, "a": a, "b": b, "c": 1.0}))
    pdf = pd.concat(parts)
    return spark.createDataFrame(pdf).repartition(6), pdf


@pytest.mark.parametrize("mode", ["joint", "frozen"])
@pytest.mark.parametrize("size,stride", [(100, 20), (60, 25)])
@pytest.mark.parametrize("max_rows,per_block", [(10**6, 256), (50, 3)])
def test_drift_windows(drifting, mode, size, stride, max_rows, per_block):
    df, pdf = drifting
    got = d.drift_windows(
        df, ["t"], ["a", "b", "c"], ["g"], size, stride, 16, mode,
        max_rows=max_rows, windows_per_block=per_block,
    ).toPandas()
    want = {}
    for g, part in pdf.groupby("g"):
        x = part.sort_values("t")[["a", "b", "c"]].to_numpy()
        for k, js in np_windows(x, size, stride, 16, mode == "frozen").items():
            want[(g, k)] = js
    have = {(r.g, r.window_id): r.js for r in got.itertuples()}
    assert have.keys() == want.keys()
    for key, js in want.items():
        assert math.isclose(have[key], js, rel_tol=1e-9, abs_tol=1e-12), key
    for r in got.itertuples():
        tier = "C" if r.js >= 0.8 else "B" if r.js >= 0.5 else "A" if r.js >= 0.2 else None
        assert (r.tier if isinstance(r.tier, str) else None) == tier


def test_ungrouped_and_log_base(drifting):
    df, pdf = drifting
    one = df.filter("g = 'hot'")
    x = pdf[pdf.g == "hot"][["a"]].to_numpy()
    want = np_windows(x, 100, 50, 64)
    got = {r.window_id: r.js for r in d.drift_windows(one, ["t"], ["a"], size=100, stride=50, log_base=2).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k] / math.log(2), rel_tol=1e-9) for k in want)
    assert max(got.values()) <= 1.0


def test_drift_score_properties(drifting):
    df, pdf = drifting
    left, right = df.filter("g = 'hot' and t < 400"), df.filter("g = 'hot' and t >= 500")
    ab = d.drift_score(left, right, ["a", "b"], bins=32).first()[0]
    ba = d.drift_score(right, left, ["a", "b"], bins=32).first()[0]
    x = pdf[pdf.g == "hot"]
    want = np.mean([np_js(x[x.t < 400][c].to_numpy(), x[x.t >= 500][c].to_numpy(), 32) for c in "ab"])
    assert math.isclose(ab, want, rel_tol=1e-9) and math.isclose(ab, ba, rel_tol=1e-9)
    assert 0 < ab <= math.log(2)
    assert d.drift_score(left, left, ["a", "b"]).first()[0] == pytest.approx(0.0, abs=1e-12)


def test_count_windows(drifting):
    df, _ = drifting
    got = d.count_windows(df.filter("g = 'b'"), ["t"], ["g"], 100, 50).groupBy("window_id").agg(
        F.count("*").alias("n"), F.min("t").alias("lo")
    )
    assert {(r.window_id, r.n, r.lo) for r in got.collect()} == {(k, 100, 50 * k) for k in range(4)}


@pytest.mark.parametrize("max_rows", [2, 1000])
def test_episodes(spark, max_rows):
    tiers = [None, "A", "B", None, None, "A", None, "C", "C", None]
    rows = [("s", i + 1, 0.1 * i, t) for i, t in enumerate(tiers)]
    scored = spark.createDataFrame(rows, "g string, window_id long, js double, tier string")
    got = d.drift_episodes(scored, ["g"], max_rows=max_rows).orderBy("episode").collect()
    assert [(r.episode, r.first_window, r.last_window, r.windows, r.max_tier) for r in got] == [
        (1, 2, 3, 2, "B"), (2, 6, 6, 1, "A"), (3, 8, 9, 2, "C")]
    merged = d.drift_episodes(scored, ["g"], cooldown=1, max_rows=max_rows).orderBy("episode").collect()
    assert [(r.first_window, r.last_window) for r in merged] == [(2, 3), (6, 9)]


def test_calibration(drifting):
    df, pdf = drifting
    one = df.filter("g = 'hot'")
    got = {r.tier: r.threshold for r in d.calibrate_thresholds(one, ["t"], ["a"], 100, resamples=40).collect()}
    x = pdf[pdf.g == "hot"]["a"].to_numpy()
    starts = [r[0] for r in one.sparkSession.range(40).select(
        F.pmod(F.xxhash64(F.lit(0), "id"), F.lit(801))).collect()]
    scores = [np_js(x[:100], x[s : s + 100], 64) for s in starts]
    for tier, q in (("A", 0.9), ("B", 0.95), ("C", 0.99)):
        assert math.isclose(got[tier], np.quantile(scores, q), rel_tol=1e-9)


def test_histograms(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=1000)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    auto = {r.bin: r.n for r in h.histogram(df, "x", 50).collect()}
    want = np.histogram(x, bins=50)[0]
    assert [auto.get(i, 0) for i in range(50)] == list(want)
    fixed = {r.bin: r.n for r in h.histogram(df, "x", 64, -1, 1).collect()}
    assert [fixed.get(i, 0) for i in range(64)] == list(np.histogram(x, bins=64, range=(-1, 1))[0])
    empty = h.prob_hist(df, "x", 4, 100, 101).collect()
    assert sorted((r.bin, r.p) for r in empty) == [(i, 0.25) for i in range(4)]


def test_divergences(spark):
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.1, 0.6, 0.3])
    left = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "bin int, p double")
    right = spark.createDataFrame([(i, float(v)) for i, v in enumerate(q)], "bin int, p double")
    got = h.compare_histograms(left, right).first()
    clip = lambda v: np.clip(v, 1e-12, 1)
    kl = lambda a, b: np.sum(clip(a) * (np.log(clip(a)) - np.log(clip(b))))
    m = (p + q) / 2
    assert math.isclose(got.kl, kl(p, q), rel_tol=1e-12)
    assert math.isclose(got.js, (kl(p, m) + kl(q, m)) / 2, rel_tol=1e-12)


def test_long_baseline_is_not_sorted_in_one_task(drifting, monkeypatch):
    df, pdf = drifting
    monkeypatch.setattr(d, "limits_per_task", lambda *_: False)
    got = d.drift_windows(df, ["t"], ["a"], ["g"], 100, 50, 16, max_rows=50).toPandas()
    x = pdf[pdf.g == "hot"].sort_values("t")[["a"]].to_numpy()
    have = {r.window_id: r.js for r in got[got.g == "hot"].itertuples()}
    want = np_windows(x, 100, 50, 16)
    assert have.keys() == want.keys() and all(math.isclose(have[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want)


def test_windows_move_once(drifting):
    """After rows reach their block of windows, nothing of theirs is shuffled again."""
    df, _ = drifting
    scored = d.drift_windows(df, ["t"], ["a", "b"], ["g"], 100, 20)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    top = plan.split("REPARTITION_BY_NUM")[0]
    assert "REPARTITION_BY_NUM" in plan and "Exchange hashpartitioning" not in top.rsplit("\n", 1)[0]
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
