"""Linear and ridge regression from one pass over the rows.

Every penalty and every target column follows from the same sufficient statistics: the centred
``X'X`` and ``X'Y``, added up by the tasks, and one eigen-decomposition of the first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.models.sums import array_matrix, matrix_sums


@dataclass(frozen=True)
class LinearModel:
    """``intercept + coefficients . features`` as a column expression."""

    coefficients: DenseVector
    intercept: float
    prediction: str = "prediction"

    def setPredictionCol(self, name: str) -> LinearModel:  # noqa: N802, as Spark's models have it
        return replace(self, prediction=name)

    def expression(self, x: Column) -> Column:
        terms = F.zip_with(x, F.array(*[F.lit(float(w)) for w in self.coefficients]), lambda a, b: a * b)
        return F.aggregate(terms, F.lit(self.intercept), lambda s, t: s + t)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.prediction, self.expression(vector_to_array("features")))


@dataclass(frozen=True)
class Gramian:
    """Sufficient statistics of rows ``(x, y)`` with several target columns."""

    n: int
    mean_x: np.ndarray
    mean_y: np.ndarray
    values: np.ndarray  # eigenvalues of X'X, centred
    turn: np.ndarray
    turned: np.ndarray  # eigenvectors' times X'Y

    @staticmethod
    def of(rows: DataFrame, x: Column, y: Column) -> Gramian:
        """``x`` and ``y`` are arrays of doubles of one length each, without nulls."""
        source = rows.select(x.cast("array<double>").alias("x"), y.cast("array<double>").alias("y"))
        first = source.first()
        if first is None:
            raise ValueError("no rows to fit on")
        d, h = len(first.x), len(first.y)
        start = np.array([*first.x, *first.y], float)  # near the means, so that the sums stay small

        def shifted(batch):
            both = np.concatenate([array_matrix(batch.column(0)), array_matrix(batch.column(1))], axis=1) - start
            yield 0, np.concatenate([[len(both)], both.sum(axis=0)])

        total = matrix_sums(source, shifted)[0]
        n, mean = int(total[0]), start + total[1:] / total[0]

        def products(batch):
            both = np.concatenate([array_matrix(batch.column(0)), array_matrix(batch.column(1))], axis=1) - mean
            yield 0, both[:, :d].T @ both

        got = matrix_sums(source, products)[0].reshape(d, d + h)
        values, turn = np.linalg.eigh((got[:, :d] + got[:, :d].T) / 2)
        return Gramian(n, mean[:d], mean[d:], values, turn, turn.T @ got[:, d:])

    def weights(self, alpha: float) -> np.ndarray:
        """A column of weights a target; without a penalty directions that do not vary get none."""
        if alpha < 0:
            raise ValueError("the penalty is not negative")
        known = self.values > 1e-12 * max(self.values.max(initial=0), 1e-300)
        scale = np.where(known | (alpha > 0), 1 / np.where(known | (alpha > 0), np.maximum(self.values, 0) + alpha, 1), 0)
        return self.turn @ (scale[:, None] * self.turned)

    def models(self, alpha: float = 0.0) -> list[LinearModel]:
        """One model a target, with the penalty ``alpha * |w|^2`` on the summed squared error."""
        w = self.weights(alpha)
        return [
            LinearModel(DenseVector(w[:, j]), float(self.mean_y[j] - self.mean_x @ w[:, j])) for j in range(w.shape[1])
        ]


def gramian(frame: DataFrame) -> Gramian:
    """Of a ``(features, label)`` frame."""
    return Gramian.of(frame, vector_to_array("features"), F.array("label"))


def ridge_path(rows: DataFrame, x: Column, y: Column, alphas: Sequence[float]) -> DataFrame:
    """(alpha, step, term, value) of every penalty and target from one set of sums."""
    found = Gramian.of(rows, x, y)
    out = []
    for alpha in alphas:
        for step, model in enumerate(found.models(alpha), 1):
            out.append((float(alpha), step, "intercept", model.intercept))
            out += [(float(alpha), step, f"w{i}", float(w)) for i, w in enumerate(model.coefficients)]
    return rows.sparkSession.createDataFrame(out, "alpha double, step int, term string, value double")
