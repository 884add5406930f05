"""Drift monitor of a record stream.

Windows are counted per stream key, so records of one key are processed in order by one
task; load spreads over keys. The state of a key is bounded by two windows of rows, and what a task
holds by the records of a key in one micro-batch, as arrays of numbers.
"""

from __future__ import annotations

import time as clock
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.functions.scalars import DRIFT_TIERS
from tidegauge.operators.drift import HISTOGRAM_BINS, SMOOTHING, WINDOW_SIZE, WINDOW_STRIDE

RECORD = "record"
RETRAIN_DONE = "retrain_done"

EVENT_SCHEMA = (
    "event string, at double, row_no bigint, window_id bigint, js double, tier string, "
    "rows array<struct<x: array<double>, label: double>>"
)
# The rows of a window leave a task as flat arrays, features and label of one row after the other, not
# as an object a row; what is missing is flagged.
_FLAT_SCHEMA = (
    "event string, at double, row_no bigint, window_id bigint, js double, tier string, "
    "_width int, _v array<double>, _gap array<boolean>"
)
STEP_ROWS = 20_000  # records advanced at once
EVENTS_AT_ONCE = 500  # events that leave a task together
STATE_SCHEMA = (
    "window_x array<array<double>>, window_y array<double>, baseline array<array<double>>, "
    "seen bigint, since bigint, locked boolean, cooldown_until double"
)


@dataclass(frozen=True)
class MonitorConfig:
    size: int = WINDOW_SIZE
    stride: int = WINDOW_STRIDE
    bins: int = HISTOGRAM_BINS
    tiers: tuple[tuple[str, float], ...] = DRIFT_TIERS
    lock_on_drift: bool = True
    cooldown_seconds: float = 10.0
    idle_seconds: int | None = None


def window_divergence(base: np.ndarray, window: np.ndarray, bins: int) -> float:
    """Mean divergence over features of two small row blocks, binned over their joint range."""
    scores = []
    for a, b in zip(base.T, window.T):
        lo, hi = min(a.min(), b.min()), max(a.max(), b.max())
        if hi <= lo:
            continue
        dens = []
        for v in (a, b):
            spots = np.minimum(np.floor((v - lo) / (hi - lo) * bins), bins - 1).astype(int)
            counts = np.bincount(spots, minlength=bins) / (len(v) * ((hi - lo) / bins))
            dens.append((counts + SMOOTHING) / (1 / ((hi - lo) / bins) + bins * SMOOTHING))
        p, q = dens
        m = (p + q) / 2
        scores.append(np.sum(p * np.log(p / m) + q * np.log(q / m)) / 2)
    return float(np.mean(scores)) if scores else 0.0


class _Series:
    """Window, baseline and trigger state of one stream key, as arrays.

    Nothing happens record by record: from any state the place of the next evaluation, or of the
    completion that ends a lock, follows from counts and times, so there is a step an event.
    """

    def __init__(self, config: MonitorConfig, saved: tuple | None):
        self.config = config
        xs, ys, base, self.seen, self.since, self.locked, self.until = saved or ([], [], [], 0, 0, False, 0.0)
        self.xs, self.ys = [list(v) for v in xs], list(ys)
        self.baseline = np.array([list(v) for v in base], float)

    def saved(self) -> tuple:
        return self.xs, self.ys, self.baseline.tolist(), self.seen, self.since, self.locked, self.until

    def advance(self, at: np.ndarray, x: np.ndarray, labels: list, done: np.ndarray) -> Iterator[dict]:
        """Events of further records in order of time, and of the times at which retrains were completed."""
        c, n, held = self.config, len(at), len(self.xs)
        rows = np.array(self.xs, float) if held else x
        rows = np.concatenate([rows, x]) if held and n else rows
        ys = self.ys + labels
        before = np.searchsorted(at, done, side="right")  # records that come first

        def window(count: int) -> slice:
            return slice(max(0, held + count - c.size), held + count)

        i = 0  # records taken so far
        if not len(self.baseline):
            i = min(n, c.size - held)
            if held + i == c.size:
                self.baseline = rows[: c.size]
        while len(self.baseline):
            if self.locked:
                d = int(np.searchsorted(before, i, side="left"))
                if d == len(done):
                    break
                self.since, i = self.since + int(before[d]) - i, int(before[d])
                self.locked, self.until = False, float(done[d]) + c.cooldown_seconds
                if held + i >= c.size:
                    self.baseline = rows[window(i)]
                yield {"event": "retrain_done_seen", "at": float(done[d]), "row_no": self.seen + i}
            j = max(i + max(1, c.stride - self.since), int(np.searchsorted(at, self.until)) + 1)
            if j > n:
                break
            self.since, i = 0, j
            yield self._evaluate(float(at[j - 1]), rows[window(j)], ys[window(j)], self.seen + j)
        self.since += (n - i) if len(self.baseline) else 0
        self.seen += n
        last = window(n)
        self.xs, self.ys = rows[last].tolist(), ys[last]

    def replay(self, at: np.ndarray, x: np.ndarray, labels: np.ndarray, done: np.ndarray) -> Iterator[dict]:
        """``advance`` in pieces of a bounded number of records; a completion goes with the records before it."""
        before = np.searchsorted(at, done, side="right")
        d = 0
        for a in range(0, max(len(at), 1), STEP_ROWS):
            z = min(a + STEP_ROWS, len(at))
            e = len(done) if z == len(at) else int(np.searchsorted(before, z, side="right"))
            known = [None if v != v else v for v in labels[a:z].tolist()]
            yield from self.advance(at[a:z], x[a:z], known, done[d:e])
            d = e

    def _evaluate(self, at: float, rows: np.ndarray, labels: list, row_no: int) -> dict:
        c = self.config
        js = window_divergence(self.baseline, rows, c.bins)
        tier = next((name for name, threshold in c.tiers if js >= threshold), None)
        event = {"event": "js_tick", "js": js, "tier": tier, "at": at, "row_no": row_no}
        if tier:
            flat = np.column_stack([rows, np.array(labels, float)])
            event |= {"event": "drift", "_width": flat.shape[1], "_v": np.where(flat != flat, 0.0, flat).ravel(), "_gap": np.isnan(flat).ravel()}
            self.locked = c.lock_on_drift
        return event


def monitor_stream(
    records: DataFrame,
    key: str,
    time: Column,
    order: Sequence[Column],
    config: MonitorConfig = MonitorConfig(),
    completions: DataFrame | None = None,
) -> DataFrame:
    """Events of the drift monitor as ``(key, event, at, row_no, window_id, js, tier, rows)``.

    ``records`` has ``key``, ``x`` and ``label``; ``time`` gives seconds and ``order`` breaks
    ties. ``completions`` is a stream ``(key, at)`` of finished retrains, in the same clock.
    The rows of a micro-batch are sorted per key; bound it by the source's batch options.
    """
    lines = records.select(
        F.col(key).cast("string").alias("_key"),
        F.lit(RECORD).alias("kind"),
        time.cast("double").alias("at"),
        *[c.cast("double").alias(f"_o{i}") for i, c in enumerate(order)],
        "x",
        F.col("label").cast("double").alias("label"),
    )
    orders = [f"_o{i}" for i in range(len(order))]
    if completions is not None:
        done = completions.select(
            F.col(key).cast("string").alias("_key"),
            F.lit(RETRAIN_DONE).alias("kind"),
            F.col("at").cast("double").alias("at"),
            *[F.lit(None).cast("double").alias(o) for o in orders],
            F.lit(None).cast("array<double>").alias("x"),
            F.lit(None).cast("double").alias("label"),
        )
        lines = lines.unionByName(done)

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            saved = state.get
            state.remove()
            yield _events([{"event": "idle_timeout", "row_no": saved[3]}], group[0], config)
            return
        series = _Series(config, state.get if state.exists else None)
        found = []
        for event in series.replay(*_sorted_arrays(batches, orders)):
            found.append(event)
            if len(found) == EVENTS_AT_ONCE:
                yield _events(found, group[0], config)
                found = []
        state.update(series.saved())
        if config.idle_seconds:
            state.setTimeoutDuration(config.idle_seconds * 1000)
        yield _events(found, group[0], config)

    timeout = (
        GroupStateTimeout.ProcessingTimeTimeout if config.idle_seconds else GroupStateTimeout.NoTimeout
    )
    told = lines.groupBy("_key").applyInPandasWithState(step, f"_key string, {_FLAT_SCHEMA}", STATE_SCHEMA, "append", timeout)
    value = lambda k: F.when(~F.get("_gap", k.cast("int")), F.get("_v", k.cast("int")))
    width = F.col("_width")
    row = lambda i: F.struct(
        F.transform(F.sequence(i, i + width - 2), value).alias("x"), value(i + width - 1).alias("label")
    )
    rows = F.transform(F.sequence(F.lit(0), F.size("_v") - width, width), row)
    return told.select(F.col("_key").alias(key), "event", "at", "row_no", "window_id", "js", "tier", rows.alias("rows"))


def _sorted_arrays(batches: Iterator[pd.DataFrame], orders: list[str]) -> tuple[np.ndarray, ...]:
    """Times, features and labels of a key's records in order, and the sorted times of its completions."""
    parts = []
    for batch in batches:
        own = batch[batch.kind == RECORD]
        x = np.array(own.x.tolist(), float).reshape(len(own), -1) if len(own) else np.empty((0, 0))
        ended = batch.loc[batch.kind == RETRAIN_DONE, "at"].to_numpy(float)
        parts.append((own[["at", *orders]].to_numpy(float), x, own.label.to_numpy(float), ended))
    place, labels, done = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3))
    x = np.concatenate([p[1] for p in parts if len(p[1])] or [parts[0][1]])
    del parts
    order = np.lexsort(place.T[::-1])
    return place[order, 0], x[order], labels[order], np.sort(done)


def _events(found: list[dict], key: str, config: MonitorConfig) -> pd.DataFrame:
    """Event rows; ``window_id`` counts windows as the batch operator does."""
    names = ["event", "at", "row_no", "window_id", "js", "tier", "_width", "_v", "_gap"]
    frame = pd.DataFrame(found, columns=names).astype(object)
    frame["window_id"] = [
        (e["row_no"] - config.size) // config.stride if e["event"] in ("js_tick", "drift") else None for e in found
    ]
    frame = frame.where(frame.notna(), None)
    frame.insert(0, "_key", key)
    return frame


def snapshot_rows(events: DataFrame, key: str) -> DataFrame:
    """Labelled rows of the windows that triggered: ``(key, window_id, tier, pos, x, label)``."""
    drifts = events.filter("event = 'drift'")
    return (
        drifts.select(key, "window_id", "tier", F.posexplode("rows").alias("pos", "_row"))
        .select(key, "window_id", "tier", "pos", F.col("_row.x").alias("x"), F.col("_row.label").alias("label"))
        .filter("label is not null")
    )


def write_monitor(events: DataFrame, key: str, events_path: str, snapshot_path: str, checkpoint: str, **trigger):
    """Run the monitor into two folders: all events, and the labelled windows that triggered.

    A repeated micro-batch replaces its own folder.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.drop("rows").write.mode("overwrite").parquet(f"{events_path}/batch_id={batch_id}")
        snapshot_rows(batch, key).write.mode("overwrite").parquet(f"{snapshot_path}/batch_id={batch_id}")
        batch.unpersist()

    return (
        events.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def await_idle(running, seconds: float) -> None:
    """Stop a monitor when the state of all its keys has timed out, or fail so many seconds after its last record."""
    end = clock.monotonic() + seconds
    try:
        while clock.monotonic() < end and running.isActive:
            now, last = running.status, running.lastProgress
            if now["isTriggerActive"] and now["isDataAvailable"]:
                end = clock.monotonic() + seconds
            if last and last["stateOperators"] and last["numInputRows"] == 0 and last["stateOperators"][0]["numRowsTotal"] == 0:
                return
            clock.sleep(0.2)
        if running.exception():
            raise running.exception()
        raise TimeoutError(f"keys still active {seconds} s after the last record")
    finally:
        running.stop()
