"""Model selection and grid search: all candidates are fitted together on the same split.

Linear candidates share one set of sums, tree candidates one binned table and its chains of trees;
the validation rows are read once for all of them, and combinations of bins pass the trees once.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.models.linear import LinearModel, gramian
from tidegauge.models.regressors import LINEAR, training_frame, tree_settings
from tidegauge.models.sums import array_matrix
from tidegauge.models.trees import TABLE_BYTES, Ensemble, binned, fit_trees, packed, unpacked
from tidegauge.operators.ordering import join_facts
from tidegauge.operators.stats import error_metrics
from tidegauge.session import ship_package

RESULT_SCHEMA = (
    "candidate_id int, family string, params string, mae double, r2 double, acc double, error string"
)

Candidate = tuple[str, dict]


class Fitted:
    """All candidates of a search: what could be fitted, and why the others could not."""

    def __init__(self, train: DataFrame, candidates: Sequence[Candidate], table_bytes: int = TABLE_BYTES):
        self.errors: dict[int, str] = {}
        self.linear: dict[int, LinearModel] = {}
        self.trees: Ensemble | None = None
        self.order: list[int] = []  # of the tree candidates in the ensemble
        settings, sums = [], None
        for i, (family, params) in enumerate(candidates):
            try:  # a candidate may be invalid
                if family in LINEAR:
                    sums = sums or gramian(train.where("label is not null"))
                    self.linear[i] = sums.models(**({"alpha": 1.0} if family == "ridge" else {}) | params)[0]
                else:
                    settings.append(tree_settings(family, params))
                    self.order.append(i)
            except (TypeError, ValueError) as e:
                self.errors[i] = str(e)
        if settings:
            self.trees = fit_trees(train, settings, table_bytes=table_bytes)

    @property
    def ids(self) -> list[int]:
        return [*self.linear, *self.order]

    def predictions(self, rows: DataFrame) -> DataFrame:
        """``(label, __p)`` of ``(features, label)`` rows: an array of the linear candidates' predictions, then the trees'.

        A linear prediction is made row by row. Rows of the same bins are the same to every tree, so each
        combination of bins goes through the trees once, however many rows have it.
        """
        ship_package(rows.sparkSession)
        weights = np.array([list(m.coefficients) for m in self.linear.values()])
        base = np.array([m.intercept for m in self.linear.values()])
        sc = rows.sparkSession.sparkContext
        trees = self.trees
        cuts = trees.cuts if trees else None

        def line(batches):
            for batch in batches:
                if batch.num_rows:
                    x = array_matrix(batch.column(0))
                    guess = x @ weights.T + base if len(base) else np.zeros((len(x), 0))
                    cell = packed(binned(x, cuts)) if cuts else pa.nulls(len(x), pa.binary())
                    yield pa.RecordBatch.from_arrays([cell, batch.column(1), _arrays(guess)], ["cell", "label", "line"])

        plain = rows.select(vector_to_array("features").alias("x"), "label").mapInArrow(line, "cell binary, label double, line array<double>")
        if not trees:
            return plain.select("label", F.col("line").alias("__p"))
        shared = sc.broadcast(trees)

        def grown(batches):
            for batch in batches:
                if batch.num_rows:
                    guess = shared.value.predict_bins(unpacked(batch.column(0)))
                    yield pa.RecordBatch.from_arrays([batch.column(0), _arrays(guess)], ["cell", "trees"])

        # A fixed number of parts: few bytes, but much work.
        cells = plain.select("cell").distinct().repartition(_PARTS_A_CORE * sc.defaultParallelism, "cell")
        known = cells.mapInArrow(grown, "cell binary, trees array<double>")
        return join_facts(plain, known, ["cell"]).select("label", F.concat("line", "trees").alias("__p"))


_PARTS_A_CORE = 4


def _arrays(matrix: np.ndarray) -> pa.ListArray:
    width = matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(matrix).ravel()))


def table_search(
    train: DataFrame,
    valid: DataFrame,
    candidates: Sequence[Candidate],
    threshold: float = 0.05,
    table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """Search over ``(features, label)`` frames; best first by (mae, candidate order).

    A candidate that cannot be fitted gets an infinite error and its message.
    """
    spark = train.sparkSession
    told = [(i, family, json.dumps(params)) for i, (family, params) in enumerate(candidates)]
    fitted = Fitted(train, candidates, table_bytes)
    frame = spark.createDataFrame(told, "candidate_id int, family string, params string")
    bad = spark.createDataFrame(list(fitted.errors.items()), "candidate_id int, error string")
    acc = f"acc_{round(threshold * 100):d}"
    if fitted.ids:
        each = fitted.predictions(valid).select("label", F.posexplode("__p").alias("place", "prediction"))
        ids = F.array(*[F.lit(i) for i in fitted.ids])
        each = each.select(ids[F.col("place")].alias("candidate_id"), "label", "prediction")
        metrics = error_metrics(each, "label", "prediction", ["candidate_id"], (threshold,), eps=1e-8, as_percent=False)
        metrics = metrics.select("candidate_id", "mae", "r2", F.col(acc).alias("acc"))
    else:
        metrics = spark.createDataFrame([], "candidate_id int, mae double, r2 double, acc double")
    joined = frame.join(F.broadcast(metrics), "candidate_id", "left").join(F.broadcast(bad), "candidate_id", "left")
    mae = F.when(F.col("error").isNotNull(), F.lit(float("inf"))).otherwise(F.col("mae")).alias("mae")
    return joined.select("candidate_id", "family", "params", mae, "r2", "acc", "error").orderBy("mae", "candidate_id")


def forecast_search(
    train: DataFrame,
    valid: DataFrame,
    horizon: int,
    candidates: Sequence[Candidate],
    threshold: float = 0.15,
    minimum: int = 32,
    table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """Search over window frames ``(x, y array)`` whose targets reach the horizon.

    Candidates are judged on the first forecast step, so that one is fitted; ``fit_multi_output``
    fits all steps of the winner.
    """
    train, valid = (w.where(F.size("y") >= horizon) for w in (train, valid))
    if train.limit(minimum).count() + valid.limit(minimum).count() < minimum:
        raise ValueError("not enough windows for a search")
    frames = [training_frame(w, F.flatten("x"), F.element_at("y", 1)) for w in (train, valid)]
    return table_search(*frames, candidates, threshold, table_bytes)


def best_candidate(results: DataFrame) -> tuple[str, dict, dict]:
    """Family, parameters and metrics of the winner."""
    best = results.filter(F.col("error").isNull()).orderBy("mae", "candidate_id").limit(1).collect()
    if not best:
        raise ValueError("no candidate could be fitted")
    row = best[0]
    return row["family"], json.loads(row["params"]), {k: row[k] for k in ("mae", "r2", "acc")}


def selection_manifest(
    spark: SparkSession, winner: tuple[str, dict, dict], lookback: int, horizon: int, features: Sequence[str]
) -> DataFrame:
    """One row that tells a later job which forecast model to build."""
    family, params, metrics = winner
    row = (family, json.dumps(params), json.dumps(metrics), lookback, horizon, list(features))
    return spark.createDataFrame(
        [row],
        "selected_kind string, selected_params string, metrics string, lookback int, horizon int, features array<string>",
    )
