"""Dense regression network trained on a distributed table.

In mini-batches, an epoch is one Spark job: rows lie in blocks of bounded size, every block runs
through its own batches from the common weights, and weights and Adam state are averaged by rows. A
table of one block is thus trained as a plain loop would. Without a batch size a step is one job: the
tasks sum the gradient over the whole table, and the driver, which holds only the weights, makes one
Adam step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.models.network import Adam, Network


def rows_frame(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """``(x, y)`` with the features as one array."""
    return df.select(
        F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("x"),
        F.col(f"`{target}`").cast("double").alias("y"),
    )


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(rows, -1)


def gradient_sums(rows: DataFrame, net: Network, loss: str) -> tuple[float, np.ndarray, int]:
    """Loss, gradient and row count summed over the table."""
    size = len(net.params)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2)
        for b in batches:
            if b.num_rows:
                value, grad = net.gradient(
                    _matrix(b.column(0), b.num_rows), np.asarray(b.column(1), dtype=float), loss
                )
                total[0] += value
                total[1] += b.num_rows
                total[2:] += grad
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size + 2), pa.int32()), pa.array(total)], ["pos", "part"]
        )

    summed = rows.select("x", "y").mapInArrow(partial, "pos int, part double").groupBy("pos").agg(F.sum("part"))
    total = np.zeros(size + 2)
    for pos, value in summed.collect():  # one row per parameter
        total[pos] = value
    return total[0], total[2:], int(total[1])


def predictor(net: Network):
    """Vectorised prediction function over an array column."""

    @F.pandas_udf("double")
    def predict(x: pd.Series) -> pd.Series:
        return pd.Series(net.predict(np.stack(x.to_numpy())) if len(x) else np.empty(0))

    return predict


def predict_column(net: Network, x: Column | str) -> Column:
    return predictor(net)(x)


def mean_squared_error(rows: DataFrame, net: Network) -> float:
    """Over the rows with a label."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0.0
        for b in batches:
            if b.num_rows:
                error = net.predict(_matrix(b.column(0), b.num_rows)) - np.asarray(b.column(1), dtype=float)
                error = error[np.asarray(b.column(1).is_valid())]
                n, total = n + len(error), total + float(error @ error)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total])], ["n", "total"])

    sums = rows.select("x", "y").mapInArrow(partial, "n long, total double").agg(F.sum("n"), F.sum("total")).first()
    return sums[1] / sums[0] if sums[0] else None


@dataclass
class Plateau:
    """Halve the rate after ``patience`` epochs without a better value."""

    patience: int = 5
    min_lr: float = 1e-5
    best: float = float("inf")
    bad: int = 0

    def update(self, opt: Adam, value: float) -> None:
        if value < self.best * (1 - 1e-4):
            self.best, self.bad = value, 0
            return
        self.bad += 1
        if self.bad > self.patience:
            opt.lr, self.bad = max(self.min_lr, opt.lr / 2), 0


@dataclass(frozen=True)
class _Settings:
    loss: str
    batch_size: int
    candidate_id: int = 0


@dataclass
class _Trained:
    """The network in training, as ``retrain.batch_epoch`` takes it."""

    row: _Settings
    net: Network
    opt: Adam

    def set(self, sums: np.ndarray, rows: int, steps: int) -> None:
        n = len(self.net.params)
        self.net.params, self.opt.m, self.opt.v = sums[:n] / rows, sums[n : 2 * n] / rows, sums[2 * n :] / rows
        self.opt.t = steps


def in_blocks(train: DataFrame, block_rows: int) -> DataFrame:
    """``(block, h, x, y)``: rows hashed into blocks of about ``block_rows``."""
    n = train.count()
    if not n:
        raise ValueError("no training rows")
    h = F.xxhash64("x", "y")
    return train.select(F.pmod(h, F.lit(-(-n // block_rows))).cast("int").alias("block"), h.alias("h"), "x", "y")


def fit_mlp(
    train: DataFrame,
    valid: DataFrame,
    in_dim: int,
    hidden: Sequence[int] = (64, 32),
    activation: str = "relu",
    loss: str = "smoothl1",
    lr: float = 1e-2,
    weight_decay: float = 0.0,
    epochs: int = 100,
    steps_per_epoch: int = 1,
    patience: int = 10,
    plateau_patience: int = 5,
    start: Network | None = None,
    freeze: int = 0,
    seed: int = 0,
    batch_size: int | None = None,
    block_rows: int | None = None,
) -> tuple[Network, list[float]]:
    """Best network by validation error, and the validation errors of all epochs.

    ``train`` and ``valid`` are ``(x, y)`` tables; persist them, they are read once per step, or once per
    epoch with a ``batch_size``. Rows of equal x and y share a block.
    ``start`` fine-tunes a copy of an existing network, optionally with its first ``freeze``
    layers fixed.
    """
    net = start.copy() if start else Network.create(in_dim, hidden, activation, seed)
    opt = Adam(len(net.params), lr, weight_decay, net.frozen(freeze) if start else 0)
    plateau = Plateau(plateau_patience)
    best, best_value, bad, history = net.copy(), float("inf"), 0, []
    if batch_size:
        from tidegauge.models.retrain import BLOCK_ROWS, batch_epoch, pack_blocks

        blocks = pack_blocks(in_blocks(train, block_rows or BLOCK_ROWS))
        own = _Trained(_Settings(loss, batch_size), net, opt)
    for epoch in range(epochs):
        if batch_size:
            batch_epoch(blocks, [own], epoch, seed)
            net = own.net
        for _ in range(0 if batch_size else steps_per_epoch):
            _, grad, n = gradient_sums(train, net, loss)
            if n == 0:
                raise ValueError("no training rows")
            net.params = opt.step(net.params, grad / n)
        value = mean_squared_error(valid, net)
        history.append(value)
        plateau.update(opt, value)
        if value + 1e-9 < best_value:
            best, best_value, bad = net.copy(), value, 0
        else:
            bad += 1
            if bad >= patience:
                break
    return best, history
