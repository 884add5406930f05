"""Streams over files: several files are several micro-batches; results equal the batch ones."""

import json
import math
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.models import network, retrain
from tidegauge.operators import drift
from tidegauge.operators.registry import publish_version
from tidegauge.operators.stats import StandardScaler
from tidegauge.streaming import monitor, records, scoring


START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def message(i, x, label=None, stage="s0", sec=None):
    body = {"features": {"a": x[0], "b": x[1]}, "send_ts": f"2024-01-01T00:{i // 60 % 60:02d}:{i % 60:02d}Z", "stage": stage}
    if label is not None:
        body["label"] = label
    return json.dumps(body).encode()


def topic_file(spark, path, rows):
    """One file of ``(key, value, partition, offset, second)`` rows."""
    data = [
        (k.encode(), v, "t", p, o, START + timedelta(seconds=s), []) for k, v, p, o, s in rows
    ]
    spark.createDataFrame(data, records.TOPIC_SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture(scope="module")
def topic(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("topic"))
    rng = np.random.default_rng(8)
    n = 700
    x = rng.normal(size=(n, 2))
    x[350:, 0] += 4
    rows = [("k1" if i % 3 else "k2", message(i, x[i], float(x[i].sum()) if i % 7 else None), i % 3, i, i) for i in range(n)]
    rows[40] = ("k1", b"not json", 0, 40, 40)
    for a in range(0, n, 150):
        topic_file(spark, path, rows[a : a + 150])
    topic_file(spark, path, [("k1", b"__EOF__", p, 10_000 + p, n) for p in range(3)])
    topic_file(spark, path, rows[:20])
    return path


def decoded(raw):
    return records.decode_stream(raw, ["a", "b"]).withColumn("key", F.col("key").cast("string"))


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name)


def test_decode_and_progress(spark, topic):
    raw = spark.read.schema(records.TOPIC_SCHEMA).parquet(topic)
    assert decoded(raw).count() == 699 + 20
    progress = records.partition_progress(raw)
    assert records.stream_done(progress, 3).first().done and not records.stream_done(progress, 4).first().done
    assert records.stream_done(progress, 3, by="count").first().done
    assert decoded(raw).filter("label is null").count() > 0
    trip = records.round_trip(decoded(raw)).agg(F.max("rtt_ms").alias("m")).first().m
    assert trip is not None


def test_topic_options():
    o = records.topic_options("h:1", "t", max_offsets=5)
    assert o["startingOffsets"] == "latest" and o["includeHeaders"] == "true" and o["maxOffsetsPerTrigger"] == "5"
    assert records.topic_options("h:1", "t", starting="earliest")["startingOffsets"] == "earliest"


def test_streaming_sentinels_and_dedup(spark, topic):
    raw = records.read_record_files(spark, topic)
    got = run(spark, records.partition_progress(raw), "progress", "complete").collect()
    assert {r.partition for r in got if r.done} == {0, 1, 2}
    seen = run(spark, records.deduplicate(records.read_record_files(spark, topic), "2 hours"), "dedup")
    assert seen.count() == 700 + 3


def unique(raw):
    return decoded(raw.dropDuplicates(["partition", "offset"]))


def test_monitor_equals_batch(spark, topic):
    cfg = monitor.MonitorConfig(size=60, stride=20, bins=16, lock_on_drift=False)
    stream = monitor.monitor_stream(
        decoded(records.deduplicate(records.read_record_files(spark, topic), "2 hours")),
        "key", F.unix_micros("timestamp") / 1e6, [F.col("offset")], cfg,
    )
    got = run(spark, stream, "mon").collect()
    batch = unique(spark.read.schema(records.TOPIC_SCHEMA).parquet(topic)).select(
        "key", "timestamp", "offset", F.col("x")[0].alias("a"), F.col("x")[1].alias("b")
    )
    want = drift.drift_windows(batch, ["timestamp", "offset"], ["a", "b"], ["key"], 60, 20, 16).collect()
    have = {(r.key, r.window_id): (r.js, r.tier) for r in got}
    assert have.keys() == {(r.key, r.window_id) for r in want} and len(have) > 20
    for r in want:
        assert math.isclose(have[(r.key, r.window_id)][0], r.js, rel_tol=1e-9, abs_tol=1e-12)
        assert have[(r.key, r.window_id)][1] == r.tier
    assert {r.event for r in got} == {"js_tick", "drift"}


def simulate(x, times, done_at, size, stride, bins, cooldown):
    """Plain re-statement of the trigger rules."""
    out, win, base, since, locked, until = [], [], None, 0, False, -1.0
    done = sorted(done_at)
    for t, v in zip(times, x):
        while done and done[0] < t:
            d = done.pop(0)
            if locked:
                locked, until = False, d + cooldown
                base = np.array(win[-size:])
                out.append(("retrain_done_seen", d))
        win.append(v)
        if base is None:
            if len(win) == size:
                base = np.array(win)
            continue
        since += 1
        if locked or t < until or since < stride:
            continue
        since = 0
        js = monitor.window_divergence(base, np.array(win[-size:]), bins)
        if js >= 0.2:
            locked = True
            out.append(("drift", t))
        else:
            out.append(("js_tick", t))
    return out


def test_suppression_cooldown_and_baseline_refresh(spark, topic, tmp_path):
    done = [(380.5, "k1"), (600.5, "k1"), (650.5, "k2")]
    comp_path = str(tmp_path / "done")
    spark.createDataFrame(done, "at double, key string").coalesce(1).write.parquet(comp_path)
    # One batch holds everything, so that both streams share one time order.
    raw = records.read_record_files(spark, topic, files_per_batch=100)
    cfg = monitor.MonitorConfig(size=60, stride=20, bins=16, cooldown_seconds=35.0)
    start = pd.Timestamp("2024-01-01").timestamp()
    events = monitor.monitor_stream(
        unique_stream(raw), "key", F.unix_micros("timestamp") / 1e6 - start, [F.col("offset")], cfg,
        spark.readStream.schema("at double, key string").parquet(comp_path),
    )
    q = monitor.write_monitor(events, "key", str(tmp_path / "ev"), str(tmp_path / "snap"), str(tmp_path / "cp"))
    q.awaitTermination(240)
    assert q.exception() is None
    got = spark.read.parquet(str(tmp_path / "ev")).orderBy("key", "at").collect()
    rows = unique(spark.read.schema(records.TOPIC_SCHEMA).parquet(topic)).select(
        "key", (F.unix_micros("timestamp") / 1e6 - start).alias("t"), "x").orderBy("t").toPandas()
    for key in ("k1", "k2"):
        part = rows[rows.key == key]
        want = simulate(list(part.x), list(part.t), [t for t, k in done if k == key], 60, 20, 16, 35.0)
        assert [(r.event, r.at) for r in got if r.key == key] == want
        assert any(e == "drift" for e, _ in want)
    snap = spark.read.parquet(str(tmp_path / "snap"))
    n = sum(r.event == "drift" for r in got)
    per = snap.groupBy("key", "window_id").count().collect()
    assert len(per) == n and all(40 < r["count"] < 60 for r in per)


def unique_stream(raw):
    return decoded(raw.withWatermark("timestamp", "2 hours").dropDuplicatesWithinWatermark(["partition", "offset"]))


def test_rollup(spark, topic):
    scored = decoded(records.read_record_files(spark, topic)).withColumn("hit", F.when(F.col("offset") % 2 == 0, 1).otherwise(0))
    got = run(spark, records.rate_rollup(scored, delay="1 hour"), "rates", "update")
    best = got.groupBy("start", "stage").agg(F.max("n").alias("n"), F.max("hits").alias("h")).orderBy("start").collect()
    assert [r.n for r in best][1:-1] == [60] * (len(best) - 2) and best[1].h == 30 and sum(r.n for r in best) == 719


def test_dual_scoring_with_hot_swap(spark, topic, tmp_path):
    base = network.Network.create(2, (4,), seed=0)
    better = network.Network.create(2, (4,), seed=3)
    worse = network.Network.create(2, (4,), seed=9)
    sc = StandardScaler(("a", "b"), (0.0, 0.0), (1.0, 1.0))
    reg, out = str(tmp_path / "reg"), str(tmp_path / "out")
    schema = "ts bigint, model_key string, metrics_key string, content string, metrics map<string,string>"

    def publish(ts, net, acc):
        row = (ts, f"m{ts}", f"x{ts}", net.to_json(), {"acc@0.25": str(acc), "baseline_acc@0.25": "50"})
        publish_version(reg, spark.createDataFrame([row], schema))

    scorer = scoring.DualScorer(base, sc, reg, out)
    steps = {1: (10, better, 60), 3: (20, worse, 50.0)}

    def batch(df, batch_id):
        if batch_id in steps:
            publish(*steps[batch_id])
        scorer(df, batch_id)
        scorer(df, batch_id)  # a repeated batch changes nothing

    stream = records.decode_stream(records.read_record_files(spark, topic), ["a", "b"], default_label=0.0)
    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    totals = spark.read.parquet(f"{out}/totals").orderBy("batch_id").collect()
    assert [r.model_key for r in totals][:4] == ["baseline", "m10", "m10", "m10"]
    trace = spark.read.parquet(f"{out}/trace")
    assert trace.count() == totals[-1].cum_total == 719
    assert totals[-1].cum_correct == trace.agg(F.sum("correct")).first()[0]
    first = trace.filter("batch_id = 0").filter("pred_orig <> pred_adj").count()
    assert first == 0 and trace.filter("batch_id = 2").filter("pred_orig <> pred_adj").count() > 0


def test_drift_to_registry(spark, topic, tmp_path):
    """A triggered window is retrained and published, as one job after the other."""
    cfg = monitor.MonitorConfig(size=60, stride=20, bins=16)
    raw = spark.read.schema(records.TOPIC_SCHEMA).parquet(topic)
    assert unique(raw).count() == 699
    stream = monitor.monitor_stream(
        unique_stream(records.read_record_files(spark, topic, 100)), "key", F.unix_micros("timestamp") / 1e6, [F.col("offset")], cfg)
    q = monitor.write_monitor(stream, "key", str(tmp_path / "ev"), str(tmp_path / "snap"), str(tmp_path / "cp"))
    q.awaitTermination(240)
    drift_row = spark.read.parquet(str(tmp_path / "ev")).filter("event = 'drift' and key = 'k1'").first()
    window = spark.read.parquet(str(tmp_path / "snap")).filter("key = 'k1'").withColumnRenamed("label", "y")
    base = network.Network.create(2, (64, 32), seed=1)
    result = retrain.two_stage_search(window, ["pos"], drift_row.tier, baseline=base).cache()
    publish_version(str(tmp_path / "reg"), retrain.registry_entry(result, 99))
    scorer = scoring.DualScorer(base, StandardScaler(("a", "b"), (0.0, 0.0), (1.0, 1.0)), str(tmp_path / "reg"), str(tmp_path / "out"))
    scorer(records.decode_stream(raw, ["a", "b"], default_label=0.0), 0)
    assert spark.read.parquet(str(tmp_path / "out" / "totals")).first().model_key in ("model_99", "baseline")
    assert result.first().rmse <= result.first().baseline_rmse


def plain_monitor(rows, done, cfg):
    """Record by record: (event, at, row_no, js) of records (at, x) and completion times."""
    marks = sorted([(a, 0, i) for i, (a, _) in enumerate(rows)] + [(t, 1, 0) for t in done])
    win, base, seen, since, locked, until, out = [], None, 0, 0, False, 0.0, []
    for at, kind, i in marks:
        if kind:
            if locked:
                locked, until = False, at + cfg.cooldown_seconds
                base = list(win) if len(win) == cfg.size else base
                out.append(("retrain_done_seen", at, seen, None))
            continue
        win = [*win, rows[i][1]][-cfg.size :]
        seen += 1
        if base is None:
            base = list(win) if len(win) == cfg.size else None
            continue
        since += 1
        if locked or at < until or since < cfg.stride:
            continue
        since = 0
        js = monitor.window_divergence(np.array(base), np.array(win), cfg.bins)
        drifted = js >= cfg.tiers[-1][1]
        out.append(("drift" if drifted else "js_tick", at, seen, js))
        locked = drifted and cfg.lock_on_drift
    return out


@pytest.mark.parametrize("cooldown,size,stride", [(0.0, 30, 7), (25.0, 30, 7), (40.0, 20, 20), (5.0, 10, 1)])
def test_lock_cooldown_and_refresh_equal_a_plain_replay(cooldown, size, stride):
    cfg = monitor.MonitorConfig(size=size, stride=stride, bins=8, tiers=(("A", 0.12),), cooldown_seconds=cooldown)
    rng = np.random.default_rng(int(cooldown) + size)
    for _ in range(10):
        n = int(rng.integers(5, 400))
        at = np.sort(rng.integers(0, n, n)).astype(float)
        x = rng.normal(size=(n, 2)) + np.sin(np.arange(n) / 30)[:, None]
        done = np.sort(rng.integers(0, n, 12)).astype(float)
        want = plain_monitor(list(zip(at, x, strict=True)), done, cfg)
        cuts = sorted(rng.integers(0, n + 1, 3))
        for pieces in ([n], [*cuts, n]):  # the state carries over micro-batches, which do not split equal times
            pieces = sorted({int(np.searchsorted(at, at[p])) if p < n else n for p in pieces})
            saved, got, a, t = None, [], 0, -1.0
            for z in pieces:
                end = at[z] if z < n else np.inf
                series = monitor._Series(cfg, saved)
                mine = done[(done >= t) & (done < end)] if z < n else done[done >= t]
                got += [(e["event"], e["at"], e["row_no"], e.get("js")) for e in series.advance(at[a:z], x[a:z], [None] * (z - a), mine)]
                saved, a, t = series.saved(), z, end
            assert [g[:3] for g in got] == [w[:3] for w in want]
            assert np.allclose([g[3] for g in got if g[3] is not None], [w[3] for w in want if w[3] is not None])


def test_registered_lock_query_equals_a_plain_replay(spark, sf_dir):
    from tidegauge.functions.scalars import epoch_seconds, first_number
    from tidegauge.plans import streams

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_type", epoch_seconds("ts").alias("at"), "event_id",
        F.array("value", F.hour("ts").cast("double"), first_number("props")).alias("x"), first_number("props").alias("k"),
    )
    cfg = monitor.MonitorConfig(tiers=streams.MONITOR_TIERS, cooldown_seconds=streams.MONITOR_COOLDOWN)
    rows = events.orderBy("at", "event_id").collect()
    got = {}
    for r in streams.drift_lock_stream(spark, sf_dir).collect():
        got.setdefault(r.event_type, []).append(r)
    for kind in {r.event_type for r in rows}:
        own = [r for r in rows if r.event_type == kind]
        want = plain_monitor([(r["at"], r.x) for r in own], [r["at"] for r in own if r.k % 5 == 0], cfg)
        mine = sorted(got[kind], key=lambda r: (r["at"], r.event != "drift", r.row_no))
        assert sorted((r.event, r["at"], r.row_no) for r in mine) == sorted(w[:3] for w in want)
        assert np.allclose(sorted(r.js for r in mine if r.js is not None), sorted(w[3] for w in want if w[3] is not None), atol=1e-9)
        assert {r.event for r in mine} >= {"drift", "retrain_done_seen"}
        for r in mine:  # the snapshot of a window that triggered
            if r.event == "drift":
                last = own[r.row_no - cfg.size : r.row_no]
                assert r.labelled == len(last) and np.isclose(r.mean_label, np.mean([v.x[0] for v in last]), atol=1e-6)


def test_chain_of_drift_retrain_publish_and_swap_equals_a_plain_replay(spark, sf_dir):
    from tidegauge.functions.scalars import epoch_seconds, first_number
    from tidegauge.plans import streams

    got = {(r.part, r.key): r for r in streams.drift_chain(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_type", epoch_seconds("ts").alias("at"), "event_id", "value",
        F.array("value", F.hour("ts").cast("double"), first_number("props")).alias("x"),
    ).orderBy("at", "event_id").collect()
    cfg = monitor.MonitorConfig(tiers=streams.MONITOR_TIERS)
    cuts = np.quantile([r["at"] for r in rows], [0.25, 0.5, 0.75])
    kinds = sorted({r.event_type for r in rows})
    state = {k: {"win": [], "base": None, "since": 0, "locked": None, "until": 0.0} for k in kinds}
    models, version = {}, 0
    for part in range(4):
        here = [r for r in rows if int((cuts <= r["at"]).sum()) == part]
        for k in kinds:
            own = [r for r in here if r.event_type == k]
            used, w, b = models.get(k, (0, None, None))
            assert (got[part, k].n, got[part, k].version) == (len(own), used)
            if used:
                assert np.isclose(got[part, k].mae, np.mean([abs(np.dot(r.x, w) + b - r.value) for r in own]), atol=1e-5)
            else:
                assert got[part, k].mae is None
        trained = {}
        for k in kinds:
            s = state[k]
            if s["locked"] is not None:  # the retrain of the part before is done
                s["until"], s["locked"], s["base"] = s["locked"] + streams.MONITOR_COOLDOWN, None, list(s["win"])
            for r in (r for r in here if r.event_type == k):
                s["win"] = [*s["win"], r][-cfg.size :]
                if s["base"] is None:
                    s["base"] = list(s["win"]) if len(s["win"]) == cfg.size else None
                    continue
                s["since"] += 1
                if s["locked"] is not None or r["at"] < s["until"] or s["since"] < cfg.stride:
                    continue
                s["since"] = 0
                js = monitor.window_divergence(*(np.array([v.x for v in side]) for side in (s["base"], s["win"])), cfg.bins)
                if js >= cfg.tiers[-1][1]:
                    s["locked"] = r["at"]
                    x = np.array([[*v.x, 1.0] for v in s["win"]])
                    *w, b = np.linalg.lstsq(x, np.array([v.value for v in s["win"]]), rcond=None)[0]
                    trained[k] = (np.array(w), b)
        if trained:
            version += 1
            models |= {k: (version, *m) for k, m in trained.items()}
    assert version >= 2 and max(r.version for r in got.values()) >= 2


def test_pieces_of_a_micro_batch_give_the_events_of_the_whole(monkeypatch):
    cfg = monitor.MonitorConfig(size=30, stride=7, bins=8, tiers=(("A", 0.12),), cooldown_seconds=25.0)
    rng = np.random.default_rng(4)
    at = np.sort(rng.integers(0, 150, 300)).astype(float)
    x = rng.normal(size=(300, 2)) + np.sin(np.arange(300) / 30)[:, None]
    done = np.sort(rng.integers(0, 150, 12)).astype(float)
    want = plain_monitor(list(zip(at, x, strict=True)), done, cfg)
    for rows in (1, 7, 100, 1000):
        monkeypatch.setattr(monitor, "STEP_ROWS", rows)
        got = list(monitor._Series(cfg, None).replay(at, x, np.full(300, np.nan), done))
        assert [(e["event"], e["at"], e["row_no"]) for e in got] == [w[:3] for w in want]
        assert all(len(e["_v"]) == 90 for e in got if e["event"] == "drift")


def test_parts_of_events_are_bounded_and_leave_no_gap(spark, tmp_path):
    from tidegauge.plans import streams

    rows = [(i, START.replace(tzinfo=None) + timedelta(seconds=t), k) for i, (k, t) in enumerate([("a", s // 4) for s in range(40)] + [("b", 3), ("b", 1), ("b", 2)])]
    table = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, event_type string").selectExpr("event_id", "ts", "1L AS user_id", "event_type", "0D AS value", "'' AS props")
    table.write.parquet(str(tmp_path / "t" / "events.parquet"))
    where = streams.events_parts(spark, str(tmp_path / "t"), str(tmp_path / "run"), 3)
    got, last = [], {}
    for _, batch in sorted(spark.read.schema(streams.EVENT_SCHEMA).parquet(where).select("*", "_metadata.file_path").toPandas().groupby("file_path")):
        got.append(len(batch))
        for kind, own in batch.groupby("event_type"):
            assert len(own) <= 4 and last.get(kind, (len(got) - 1, own.ts.min() - pd.Timedelta(1)))[0] == len(got) - 1
            assert own.ts.min() > last.get(kind, (0, pd.Timestamp(0)))[1]  # equal times stay together
            last[kind] = (len(got), own.ts.max())
    assert sum(got) == 43 and len(got) == 10 and streams.events_stream(spark, where).isStreaming
