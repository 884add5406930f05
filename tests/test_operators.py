"""Sequence, alignment, resource, registry, schema and statistics operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import scalars as s
from tidegauge.operators import alignment, grids, registry, resources, schema, sequence, stats


@pytest.fixture(scope="module")
def ts_frame(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(
        {
            "g": ["a"] * 60 + ["b"] * 25 + ["c"] * 5,
            "t": list(range(60)) + list(range(25)) + list(range(5)),
            "f": rng.normal(size=90),
            "y": rng.normal(size=90),
        }
    )
    return spark.createDataFrame(pdf).repartition(4), pdf


@pytest.mark.parametrize("max_rows", [7, 1000])
@pytest.mark.parametrize("multi", [False, True])
@pytest.mark.parametrize("take_last", [None, 6])
def test_sliding_windows(ts_frame, max_rows, multi, take_last):
    df, pdf = ts_frame
    got = sequence.sliding_windows(
        df, ["t"], ["f", "absent"], "y", 4, 3, multi, take_last, ["g"], max_rows
    ).collect()
    want = {}
    for g, p in pdf.groupby("g"):
        n = len(p)
        starts = list(range(max(0, n - 4 - 3 + 1)))
        for i in starts[-take_last:] if take_last else starts:
            x = [[v, 0.0] for v in p.f.iloc[i : i + 4]]
            y = list(p.y.iloc[i + 4 : i + 7]) if multi else p.y.iloc[i + 6]
            want[(g, i)] = (x, y)
    assert {(r.g, r.window_start): (r.x, r.y) for r in got} == want


def test_sliding_windows_ungrouped_tail(ts_frame):
    df, pdf = ts_frame
    one = df.filter("g = 'a'")
    got = sequence.sliding_windows(one, ["t"], ["f"], "y", 4, 3, take_last=5).collect()
    assert sorted(r.window_start for r in got) == [49, 50, 51, 52, 53]
    y = pdf[pdf.g == "a"].y.tolist()
    assert all(r.y == y[r.window_start + 6] for r in got)
    with pytest.raises(ValueError):
        sequence.sliding_windows(df.filter("g = 'c'"), ["t"], ["f"], "y", 4, 3, require=True)


@pytest.mark.parametrize("max_rows", [7, 1000])
def test_last_window_and_mean(ts_frame, max_rows):
    df, pdf = ts_frame
    got = {r.g: [v[0] for v in r.x] for r in sequence.last_window(df, ["t"], ["f"], 10, ["g"], max_rows).collect()}
    assert got == {g: list(p.f.tail(10)) for g, p in pdf.groupby("g") if len(p) >= 10}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(sequence, "limits_per_task", lambda *_: False)
        again = sequence.last_window(df, ["t"], ["f"], 10, ["g"], max_rows).collect()
        assert {r.g: [v[0] for v in r.x] for r in again} == got
    one = sequence.last_window(df.filter("g = 'a'"), ["t"], ["f"], 3).first().x
    assert [v[0] for v in one] == list(pdf[pdf.g == "a"].f.tail(3))
    means = sequence.moving_mean(df, ["t"], "y", 5, 2, ["g"], max_rows).collect()
    assert len(means) == 56 + 21 + 1
    for r in means:
        p = pdf[pdf.g == r.g].y
        assert math.isclose(r.mean, p.iloc[r.t - 4 : r.t + 1].mean(), rel_tol=1e-9)
        assert r.forecast == [r.mean] * 2


@pytest.mark.parametrize("max_rows", [3, 1000])
def test_counter_rate(spark, max_rows):
    rows = [("p", 0.0, 1.0), ("p", 2.0, 5.0), ("p", 2.5, 4.0), ("p", 3.0, 4.25), ("q", 1.0, 9.0)]
    df = spark.createDataFrame(rows, "pod string, ts double, cpu double")
    got = sequence.counter_rate(df, "ts", "cpu", ["pod"], max_rows=max_rows).orderBy("ts").collect()
    assert [(r.ts, r.vcpu, r.cpu_pct) for r in got] == [(2.0, 2.0, 200.0), (2.5, 0.0, 0.0), (3.0, 0.5, 50.0)]


@pytest.mark.parametrize("max_rows", [7, 1000])
def test_cumulative_accuracy(ts_frame, max_rows):
    df, pdf = ts_frame
    got = sequence.cumulative_accuracy(
        df.withColumn("p", F.col("y") + F.col("f") * 0.2), ["g", "t"], "y", "p", max_rows=max_rows
    ).orderBy("row_idx").toPandas()
    hit = (np.abs(pdf.f * 0.2) / np.maximum(np.abs(pdf.y), 1e-8) <= 0.25).cumsum()
    assert list(got.correct) == list(hit)
    assert np.allclose(got.cum_acc, hit / np.arange(1, 91))


def test_zip(spark):
    rows = [("e", n, i, float(i)) for n, k in (("x", 4), ("y", 6), ("z", 2)) for i in range(k)]
    long = spark.createDataFrame(rows, "exp string, name string, row_idx long, value double")
    inner = alignment.zip_inner(long, ["exp"], ["x", "y", "z"]).collect()
    assert sorted(r.row_idx for r in inner) == [0, 1]
    left = alignment.zip_left(long, ["exp"], ["x", "y", "z", "w"], ["x", "y"]).orderBy("row_idx").collect()
    assert [(r.row_idx, r.x, r.z, r.w) for r in left] == [
        (0, 0.0, 0.0, None), (1, 1.0, 1.0, None), (2, 2.0, None, None), (3, 3.0, None, None)]


@pytest.mark.parametrize("max_rows", [5, 1000])
def test_asof(spark, max_rows):
    rng = np.random.default_rng(2)
    left = pd.DataFrame({"k": rng.choice(["a", "b"], 80), "t": rng.permutation(400)[:80].astype(float), "id": range(80)})
    right = pd.DataFrame({"k": rng.choice(["a", "b"], 30), "t": rng.permutation(400)[:30].astype(float), "js": rng.random(30)})
    got = alignment.asof_latest(
        spark.createDataFrame(left), spark.createDataFrame(right), "t", "js", ["k"], "id", max_rows=max_rows
    ).toPandas().sort_values("t")
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("t"), on="t", by="k")
    assert np.allclose(got.js.to_numpy(float), want.js.to_numpy(float), equal_nan=True)
    aged = alignment.asof_latest(
        spark.createDataFrame(left), spark.createDataFrame(right), "t", "js", ["k"], "id", max_age=10.0, max_rows=max_rows
    ).toPandas().sort_values("t")
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("t"), on="t", by="k", tolerance=10.0)
    assert np.allclose(aged.js.to_numpy(float), want.js.to_numpy(float), equal_nan=True)


def test_first_available(spark):
    df = spark.createDataFrame(
        [("e1", "latency_old.csv"), ("e1", "latency-old.csv"), ("e2", "latency.csv"), ("e2", "latency_old.csv")],
        "exp string, file string")
    rank = F.when(F.col("file") == "latency.csv", 0).when(F.col("file") == "latency_old.csv", 1).otherwise(2)
    got = alignment.first_available(df, ["exp"], rank, "file").collect()
    assert {(r.exp, r.file) for r in got} == {("e1", "latency_old.csv"), ("e2", "latency.csv")}


def test_resource_units_and_summary(spark):
    df = spark.createDataFrame(
        [("x", 1000, "50", 4, 2048.0), ("x", 1500, "bad", 4, 1024.0), ("y", 2000, "10", 2, None)],
        "component string, epoch_ms long, cpu_percent string, ncpu int, rss_kb double")
    n = resources.normalize_resource_units(df, ["component"]).orderBy("ts").collect()
    assert [(r.ts, r.cpu_pct, r.vcpu, r.rss_mb, r.host_cpus) for r in n] == [
        (1.0, 50.0, 2.0, 2.0, 1.0), (1.5, None, None, 1.0, 1.0), (2.0, 10.0, 0.2, None, 1.0)]
    with pytest.raises(ValueError):
        resources.normalize_resource_units(df.drop("epoch_ms"))
    got = {r.component: r for r in resources.resource_summary(
        resources.normalize_resource_units(df, ["component"])).collect()}
    assert got["x"].samples == 2 and got["x"].rss_mb_p95 == pytest.approx(1.95) and got["y"].rss_mb_p95 is None


def test_binned_total(spark):
    rows = [("p1", 0.24, 1.0, 10.0, 4), ("p1", 0.1, 2.0, 12.0, 4), ("p2", 0.2, 0.5, 5.0, 8), ("p2", 0.75, 1.0, 6.0, 8)]
    df = spark.createDataFrame(rows, "pod string, ts double, vcpu double, rss_mb double, host_cpus int")
    got = resources.binned_total(df).orderBy("ts").collect()
    assert [tuple(r) for r in got] == [(0.0, 2.0, 17.0, 8, 25.0), (1.0, 1.0, 6.0, 8, 12.5)]


def test_metric_lines(spark):
    lines = [("ts,component,event,pod,kv",), ('2024-01-01,infer,tick,p0,{"a":1.5,"b":"x,y"}',), ("",)]
    parsed = resources.parse_metric_lines(spark.createDataFrame(lines, "line string"))
    got = resources.metrics_pivot(parsed, ["a", "b"]).collect()
    assert [(r.component, r.event, r.a, r.b) for r in got] == [("infer", "tick", 1.5, None)]
    table = resources.markdown_table(resources.metrics_rollup(resources.metrics_pivot(parsed, ["a"]), ["a"]), ["event"], max_lines=100)
    assert table.splitlines()[2] == "| infer | tick | 1 | 1.5 | 1.5 |"


@pytest.mark.parametrize("max_rows", [2, 1000])
def test_promotion_gate(spark, max_rows):
    rows = [
        (1, "m1", {"acc@0.25": "50.0", "baseline_acc@0.25": "49.0"}),
        (2, "m1", {"acc@0.25": "90.0", "baseline_acc@0.25": "49.0"}),
        (3, "m2", {"acc@0.15": "50.0", "baseline_acc@0.15": "50.0"}),
        (4, "m3", {"rmse": "1"}),
        (5, "m4", {"acc@0.15": "50.02", "baseline_acc@0.15": "50.0"}),
    ]
    df = spark.createDataFrame(rows, "ts long, content string, metrics map<string,string>")
    got = registry.promotion_gate(df, max_rows=max_rows).orderBy("ts").collect()
    assert [r.promoted for r in got] == [True, False, False, True, True]
    assert registry.latest_version(df).first().ts == 5
    fallback = df.filter("ts < 3")
    assert registry.latest_pointer(df.filter("ts > 9"), fallback).first().ts == 2
    assert registry.latest_pointer(df.filter("ts > 9"), fallback.filter("ts > 9")).count() == 0


def test_grids(spark):
    a = grids.tier_grid(spark, "A", [64, 32]).orderBy("candidate_id").collect()
    assert len(a) == 2 * 2 * 2 * 2 * 1 * 2 and a[0].hidden == [64, 32]
    assert grids.tier_grid(spark, "C").count() == 3 * 2 * 3 * 2 * 2 * 2
    assert grids.tier_grid(spark, "?").count() == grids.tier_grid(spark, "B").count()
    full = grids.grid_frame(spark, grids.forecast_grid())
    ranked = spark.createDataFrame(
        [("RandomForest", 1), ("Nothing", 2), ("GBDT", 3), ("Ridge", 4)], "model string, rank int")
    cands = grids.candidate_families(ranked, 1)
    assert [r.family for r in cands.collect()] == ["xgboost"]
    assert grids.prune_grid(full, cands, "family").count() == 12


def test_schema_operators(spark):
    df = spark.createDataFrame(
        [("1", "<not counted>", "x", "5"), ("2", " ", "y", "bad"), ("", "3.5", "z", "7")],
        "a string, b string, c string, y string")
    clean = schema.clean_null_tokens(df)
    assert [r.b for r in clean.collect()] == [None, None, "3.5"]
    assert schema.discover_numeric(clean, exclude=("y",)) == ["a", "b"]
    aligned = schema.align_schema(df, ["b", "new"], "y").collect()
    assert [tuple(r) for r in aligned] == [(0.0, 0.0, 5.0), (3.5, 0.0, 7.0)]
    assert schema.dedup_names(["a", "b", "a", "a"]) == ["a", "b", "a__dup1", "a__dup2"]
    assert schema.keep_first_columns(df.toDF("a", "b", "a", "y")).columns == ["a", "b", "y"]
    assert schema.reorder_standard_first(df, ["y", "a", "q"]).columns == ["y", "a", "b", "c"]
    names = spark.createDataFrame([("e", "a"), ("e", "zz")], "exp string, name string")
    r = schema.schema_audit(names, ["a", "b"], "exp", "name").first()
    assert (r.cols, r.missing, r.extra) == (2, ["b"], ["zz"])
    trained = schema.prepare_training(
        spark.createDataFrame([("1", "2", None), ("3", "4", "5")], "f string, y string, latency string"), ["f"], "y")
    assert [tuple(r) for r in trained.collect()] == [(3.0, 4.0)]


def test_scalars(spark):
    one = spark.range(1)

    def val(c):
        return one.select(c).first()[0]

    assert val(s.first_number(F.lit("203028(Total)"))) == 203028.0
    assert val(s.first_number(F.lit("x -1.5e2 7"))) == -150.0
    assert val(s.first_number(F.lit("none"))) is None
    assert val(s.to_number(F.lit("nan"))) is None and val(s.to_number(F.lit("2"))) == 2.0
    assert val(s.align_dim(F.array(F.lit(1.0), F.lit(2.0)), 3)) == [1.0, 2.0, 0.0]
    assert val(s.align_dim(F.array(F.lit(1.0), F.lit(2.0)), 1)) == [1.0]
    assert val(s.canonical_model(F.lit(" GBRT "))) == "xgboost" and val(s.canonical_model(F.lit("svm"))) is None
    kv = F.create_map(F.lit("acc@0.15"), F.lit("3.5"))
    assert val(s.pick_metric(kv, s.accuracy_keys(0.25))) == 3.5
    assert val(s.pick_metric(kv, ["zz"])) == 0.0
    names = ["exp-10", "Exp-9", "exp-1.csv", "exp-1", "exp-01b", "7up"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(s.natural_sort_key("n")).collect()

    def key(n):
        import re
        return [int(p) if p.isdigit() else p.lower() for p in re.split(r"(\d+)", n)]

    assert [key(r.n) for r in rows] == [key(n) for n in sorted(names, key=key)]


def test_sentinels(spark):
    rows = [
        (b'{"label":1}', [("run_id", b"r1")], False),
        (b"__EOF__", [], True),
        (b'{"_sentinel":true,"run_id":"r1"}', [], True),
        (b'{"_sentinel":false}', [], False),
        (b"x", [("stream-sentinel", b"1"), ("run_id", b"r1")], True),
        (b"x", [("stream-sentinel", b"0")], False),
    ]
    df = spark.createDataFrame(
        [(v, h, e) for v, h, e in rows], "value binary, headers array<struct<key string, value binary>>, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", s.is_sentinel("value", "headers")).collect())
    other = df.withColumn("got", s.is_sentinel("value", "headers", run_id="r2")).collect()
    assert [r.got for r in other] == [False, True, False, False, False, False]


def test_statistics(spark):
    rng = np.random.default_rng(9)
    n = 400
    x = rng.normal(size=(n, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "k"])
    pdf["k"] = 1.0
    pdf["y"] = 3 * pdf.a - pdf.b + rng.normal(size=n)
    pdf["p"] = pdf.y + rng.normal(size=n) * 0.3
    df = spark.createDataFrame(pdf)
    top = stats.corr_topk(df, ["a", "b", "k"], "y", 3).collect()
    assert [r.feature for r in top] == ["a", "b", "k"] and top[2].abs_corr == 0.0
    assert math.isclose(top[0].abs_corr, abs(np.corrcoef(pdf.a, pdf.y)[0, 1]), rel_tol=1e-9)
    sc = stats.StandardScaler.fit(df, ["a", "k"])
    assert math.isclose(sc.scale[0], pdf.a.std(ddof=0), rel_tol=1e-9) and sc.scale[1] == 1.0
    assert stats.StandardScaler.fit(df, ["a"], with_mean=False).mean == (0.0,)
    m = stats.error_metrics(df, "y", "p").first()
    err = pdf.p - pdf.y
    assert math.isclose(m.mae, err.abs().mean()) and math.isclose(m.rmse, np.sqrt((err**2).mean()))
    assert math.isclose(m.r2, 1 - (err**2).sum() / ((pdf.y - pdf.y.mean()) ** 2).sum())
    assert math.isclose(m.acc_15, 100 * (err.abs() / np.maximum(pdf.y.abs(), 1e-6) <= 0.15).mean())
    flat = spark.createDataFrame([(1.0, float("nan")), (1.0, 1.1)], "y double, p double")
    r = flat.agg(stats.accuracy_within("y", "p", 0.15).alias("a"), stats.accuracy_within("y", "p", 0.2, "absolute").alias("b")).first()
    assert r.a == 100.0 and r.b == 100.0
    assert flat.filter("p = 7").agg(stats.accuracy_within("y", "p", 0.1).alias("a")).first().a == 0.0
    modal = stats.modal_value(spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "v string"), "v").first()
    assert (modal.v, modal.n) == ("a", 2)
    f = spark.createDataFrame([([1.0, 9.0], [1.1, 0.0]), ([2.0, 9.0], [3.0, 0.0])], "y array<double>, p array<double>")
    assert stats.forecast_metrics(f, "y", "p").first().acc_15 == 0.5
