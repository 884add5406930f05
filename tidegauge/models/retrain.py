"""Retraining after drift: a quick pass over all candidates, a full fit of the best ones.

One way serves windows of any size, and no row passes through the driver. The training rows are
hashed into blocks of bounded size. In an epoch every block trains every candidate on its rows in
shuffled mini-batches, from the candidate's common weights; the results are averaged by rows. A
window of one block is thus trained as a plain mini-batch loop would. Only weights and sums of
errors, whose size the grid bounds, come back to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.models.mlp import predict_column
from tidegauge.models.network import LOSSES, Adam, Network, fit_epochs
from tidegauge.operators.grids import FINALISTS, tier_grid
from tidegauge.operators.ordering import hash_split
from tidegauge.operators.stats import error_metrics
from tidegauge.session import cut_lineage

# The retrain budget.
WARM_EPOCHS = 3
FULL_EPOCHS = 8
EARLY_PATIENCE = 2
VALID_FRACTION = 0.2
MIN_IMPROVEMENT = 1e-6

BLOCK_ROWS = 4096
_FAN_IN = 32  # results of tasks that one task adds up

RESULT_SCHEMA = (
    "candidate_id int, lr double, batch_size int, hidden array<int>, activation string, loss string, "
    "wd double, mode string, rmse double, mae double, acc_25 double, acc_15 double, network string, error string"
)
_METRICS = ("rmse", "mae", "acc_25", "acc_15")


def can_finetune(current: Network | None, hidden: Sequence[int], activation: str) -> bool:
    return current is not None and tuple(hidden) == current.hidden and activation == current.activation


class _Run:
    """A candidate in training: its weights, the optimizer's state and the best so far."""

    def __init__(self, row, in_dim: int, current: Network | None, freeze: int, seed: int):
        self.row, self.error = row, None
        self.tune = can_finetune(current, row.hidden, row.activation)
        try:
            if row.loss not in LOSSES:
                raise ValueError(f"unsupported loss: {row.loss}")
            self.net = current.copy() if self.tune else Network.create(in_dim, row.hidden, row.activation, seed)
            self.opt = Adam(len(self.net.params), row.lr, row.wd, self.net.frozen(freeze) if self.tune else 0)
            self.best, self.best_metrics, self.bad = self.net.copy(), None, 0
        except ValueError as e:
            self.error = str(e)

    def set(self, sums: np.ndarray, rows: int, steps: int) -> None:
        n = len(self.net.params)
        self.net.params, self.opt.m, self.opt.v = sums[:n] / rows, sums[n : 2 * n] / rows, sums[2 * n :] / rows
        self.opt.t = steps

    def result(self, full: bool) -> tuple:
        r = self.row
        base = (r.candidate_id, r.lr, r.batch_size, list(r.hidden), r.activation, r.loss, r.wd)
        if self.error:
            return (*base, None, *[float("inf")] * 4, None, self.error)
        mode = "finetune" if self.tune else "scratch"
        return (*base, mode, *[self.best_metrics[m] for m in _METRICS], self.best.to_json() if full else None, None)


_BLOCK = "block int, n int, x binary, y binary"
_SUMS = "candidate_id int, part int, n long, steps long, sums array<double>"
_PARTS_A_CORE = 4


def pack_blocks(rows: DataFrame) -> DataFrame:
    """Rows ``(block, h, x, y)`` written once, a row a block: its matrix and labels in order of ``h``.

    Every epoch reads them where they lie; nothing is sorted, shuffled or unpacked row by row again.
    """
    schema = pa.schema([("block", pa.int32()), ("n", pa.int32()), ("x", pa.binary()), ("y", pa.binary())])

    def pack(key, table):
        table = table.sort_by("h")
        x, y = np.asarray(table["x"].combine_chunks().flatten(), dtype=float), np.asarray(table["y"], dtype=float)
        cell = {"block": key[0].as_py(), "n": table.num_rows, "x": x.tobytes(), "y": y.tobytes()}
        return pa.Table.from_pylist([cell], schema)

    packed = rows.select("block", "h", "x", "y").groupBy("block").applyInArrow(pack, _BLOCK)
    # A fixed number of parts: few bytes, but much work.
    last = rows.agg(F.max("block")).first()[0] or 0
    return cut_lineage(packed.repartition(min(last + 1, _PARTS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism)))


def batch_epoch(blocks: DataFrame, runs: list[_Run], epoch: int, seed: int) -> None:
    """One epoch of all candidates over packed blocks, averaged over them."""
    shared = blocks.sparkSession.sparkContext.broadcast([(r.row, r.net, r.opt) for r in runs])
    schema = pa.schema([("candidate_id", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("steps", pa.int64()), ("sums", pa.list_(pa.float64()))])

    def train(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for b in batch.to_pylist():
                n = b["n"]
                x, y = np.frombuffer(b["x"]).reshape(n, -1), np.frombuffer(b["y"])
                for row, net, opt in shared.value:
                    net, own = net.copy(), Adam(len(net.params), opt.lr, opt.weight_decay, opt.frozen)
                    own.m, own.v, own.t = opt.m.copy(), opt.v.copy(), opt.t
                    rng = np.random.default_rng([seed, epoch, b["block"]])
                    fit_epochs(net, x, y, own, row.loss, int(row.batch_size), rng)
                    sums = np.concatenate([net.params, own.m, own.v]) * n
                    cell = total.setdefault(row.candidate_id, [0, 0, 0.0])
                    total[row.candidate_id] = [cell[0] + n, max(cell[1], own.t), cell[2] + sums]
        part = TaskContext.get().partitionId()
        for i, (n, steps, sums) in total.items():
            yield pa.RecordBatch.from_pylist([{"candidate_id": i, "part": part, "n": n, "steps": steps, "sums": sums.tolist()}], schema)

    def add(key, table):
        table = table.sort_by("part")
        sums = np.sum([np.asarray(v.values) for v in table["sums"]], axis=0)
        cell = {"candidate_id": key[0].as_py(), "part": table["part"][0].as_py(), "n": sum(table["n"].to_pylist()), "steps": max(table["steps"].to_pylist()), "sums": sums.tolist()}
        return pa.Table.from_pylist([cell], schema)

    trained = blocks.mapInArrow(train, _SUMS)
    halfway = trained.groupBy("candidate_id", F.floor(F.col("part") / _FAN_IN)).applyInArrow(add, _SUMS)
    by_id = {r.row.candidate_id: r for r in runs}
    for got in halfway.groupBy("candidate_id").applyInArrow(add, _SUMS).collect():  # a parameter grid
        by_id[got.candidate_id].set(np.array(got.sums), got.n, got.steps)
    shared.unpersist()


def _measure(valid: DataFrame, nets: dict[int, Network]) -> dict[int, dict[str, float]]:
    """Metrics of all candidates from one pass over the validation rows."""
    shared = valid.sparkSession.sparkContext.broadcast(nets)

    def partial(batches):
        total = {i: np.zeros(5) for i in shared.value}
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(0).flatten(), dtype=float).reshape(b.num_rows, -1)
                y = np.asarray(b.column(1), dtype=float)
                for i, net in shared.value.items():
                    err = np.abs(net.predict(x) - y)
                    rel = err / np.maximum(np.abs(y), 1e-6)
                    total[i] += [len(y), (err**2).sum(), err.sum(), (rel <= 0.25).sum(), (rel <= 0.15).sum()]
        ids = list(total)
        cells = np.array([total[i] for i in ids]).reshape(-1, 5)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *[pa.array(c) for c in cells.T]], ["i", "n", "se", "ae", "a", "b"])

    sums = valid.select("x", "y").mapInArrow(partial, "i int, n double, se double, ae double, a double, b double").groupBy("i")
    out = {}
    for r in sums.agg(*[F.sum(c).alias(c) for c in ("n", "se", "ae", "a", "b")]).collect():
        n = max(1.0, r.n)
        out[r.i] = {"rmse": float(np.sqrt(r.se / n)), "mae": r.ae / n, "acc_25": 100.0 * r.a / n, "acc_15": 100.0 * r.b / n}
    return out


def score_candidates(
    candidates: DataFrame,
    train: DataFrame,
    valid: DataFrame,
    in_dim: int,
    current: Network | None,
    epochs: int,
    full: bool,
    freeze: int = 0,
    seed: int = 0,
) -> DataFrame:
    """One result row per candidate; an invalid candidate carries its error.

    ``train`` has ``(block, h, x, y)`` and ``valid`` ``(x, y)``. A full fit keeps the best epoch and
    stops a candidate that has not improved for longer than the patience; a quick one keeps the
    last epoch.
    """
    runs = [_Run(r, in_dim, current, freeze, seed) for r in candidates.orderBy("candidate_id").collect()]
    active = [r for r in runs if not r.error]
    packed = pack_blocks(train) if active else train
    for epoch in range(max(1, epochs)):
        if not active:
            break
        batch_epoch(packed, active, epoch, seed)
        if not full and epoch < epochs - 1:
            continue
        metrics = _measure(valid, {r.row.candidate_id: r.net for r in active})
        for r in active:
            got = metrics[r.row.candidate_id]
            if r.best_metrics is None or got["rmse"] < r.best_metrics["rmse"] - MIN_IMPROVEMENT:
                r.best, r.best_metrics, r.bad = r.net.copy(), got, 0
            else:
                r.bad += 1
        active = [r for r in active if r.bad <= EARLY_PATIENCE]
    return candidates.sparkSession.createDataFrame([r.result(full) for r in runs], RESULT_SCHEMA)


def finalists(warm: DataFrame, k: int) -> DataFrame:
    """The ``k`` valid candidates with the lowest error, a bounded top-k."""
    return warm.filter("error is null").orderBy("rmse", "candidate_id").limit(k)


def split_window(window: DataFrame, keys: Sequence[str], seed: int = 0, fraction: float = VALID_FRACTION) -> DataFrame:
    return hash_split(window, fraction, keys, seed, round_up=False)


def two_stage_search(
    window: DataFrame,
    keys: Sequence[str],
    tier: str,
    baseline: Network | None = None,
    current: Network | None = None,
    x: str = "x",
    y: str = "y",
    freeze: int = 0,
    seed: int = 0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Best candidate as one row of results, with row counts and baseline metrics.

    ``window`` holds scaled feature arrays ``x`` and labels ``y`` (rows without one are
    skipped); ``keys`` identify its rows for the seeded split.
    """
    labelled = window.filter(F.col(y).isNotNull()).select(*keys, F.col(x).alias("x"), F.col(y).alias("y"))
    # Read in every epoch, so written once.
    labelled = cut_lineage(labelled)
    marked = cut_lineage(split_window(labelled, keys, seed))
    spark = window.sparkSession
    grid = tier_grid(spark, tier, current.hidden if current else None)
    k = FINALISTS.get(tier, FINALISTS["B"])
    facts = marked.agg(
        F.count_if(~F.col("is_valid")).alias("train_rows"),
        F.count_if("is_valid").alias("val_rows"),
        F.max(F.size("x")).alias("width"),
    ).first()
    if facts.train_rows + facts.val_rows < 2:
        raise ValueError("not enough labelled rows to retrain")
    h = F.xxhash64(F.lit(seed), *keys)
    blocks = -(-facts.train_rows // block_rows)
    train = marked.filter("not is_valid").select(
        F.pmod(h, F.lit(blocks)).cast("int").alias("block"), h.alias("h"), "x", "y"
    )
    train = cut_lineage(train)
    valid = marked.filter("is_valid").select("x", "y")
    warm = score_candidates(grid, train, valid, facts.width, current, WARM_EPOCHS, False, freeze, seed)
    best_ids = finalists(warm, k).select("candidate_id")
    chosen = grid.join(F.broadcast(best_ids), "candidate_id", "left_semi")  # k rows
    full = score_candidates(chosen, train, valid, facts.width, current, FULL_EPOCHS, True, freeze, seed)
    best = full.filter("error is null").orderBy("rmse", "candidate_id").limit(1)
    result = best.withColumns(
        {"tier": F.lit(tier), "train_rows": F.lit(facts.train_rows), "val_rows": F.lit(facts.val_rows)}
    )
    if baseline is None:
        return result
    held = marked.filter("is_valid").withColumn("_p", predict_column(baseline, "x"))
    base = error_metrics(held, "y", "_p").first()
    return result.withColumns({f"baseline_{m}": F.lit(base[m]) for m in _METRICS})


def registry_entry(result: DataFrame, ts: int, threshold: float = 0.25) -> DataFrame:
    """A registry row ``(ts, model_key, metrics_key, content, metrics)`` of a search result."""
    pairs = {
        f"acc@{threshold:g}": "acc_25", "acc@0.15": "acc_15",
        f"baseline_acc@{threshold:g}": "baseline_acc_25", "baseline_acc@0.15": "baseline_acc_15",
        "mae": "mae", "rmse": "rmse", "baseline_mae": "baseline_mae", "baseline_rmse": "baseline_rmse",
        "train_rows": "train_rows", "val_rows": "val_rows", "grid": "tier", "lr": "lr",
        "batch_size": "batch_size", "activation": "activation", "loss": "loss", "wd": "wd", "mode": "mode",
    }
    known = {k: c for k, c in pairs.items() if c in result.columns}
    metrics = F.create_map(*[e for k, c in known.items() for e in (F.lit(k), F.col(c).cast("string"))])
    return result.select(
        F.lit(int(ts)).cast("bigint").alias("ts"),
        F.lit(f"model_{ts}").alias("model_key"),
        F.lit(f"metrics_{ts}").alias("metrics_key"),
        F.col("network").alias("content"),
        F.map_filter(metrics, lambda _, v: v.isNotNull()).alias("metrics"),
    )
