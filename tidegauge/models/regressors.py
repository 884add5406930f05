"""Regressors with the parameter meanings that analysts know from scikit-learn.

Linear models come from sufficient statistics (``linear``), trees from histograms (``trees``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.models.linear import Gramian, LinearModel, gramian
from tidegauge.models.trees import Settings, TreeModel, fit_trees

FAMILIES = ("linear", "ridge", "forest", "gbt", "xgboost", "tree")
LINEAR = ("linear", "ridge")

Model = LinearModel | TreeModel


def training_frame(df: DataFrame, x: Column, y: Column, keep: Sequence[str] = ()) -> DataFrame:
    """``(*keep, features, label)`` from an array column and a target."""
    return df.select(
        *keep, array_to_vector(x.cast("array<double>")).alias("features"), y.cast("double").alias("label")
    )


def table_frame(
    df: DataFrame, features: Sequence[str], target: str, scale: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """Training frame of plain columns; ``scale`` divides by population deviations."""
    from tidegauge.operators.stats import StandardScaler

    if scale:
        df = StandardScaler.fit(df, features, with_mean=False).transform(df)
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    return training_frame(df, x, F.col(f"`{target}`"), keep)


def fit_linear(train: DataFrame) -> LinearModel:
    return gramian(train).models()[0]


def fit_ridge(train: DataFrame, alpha: float = 1.0) -> LinearModel:
    """Ridge with the penalty ``alpha * |w|^2`` on the summed squared error; the intercept is not penalised."""
    return gramian(train).models(alpha)[0]


def forest(n_estimators: int = 200, max_depth: int = 8, min_leaf: int = 5, seed: int = 0) -> Settings:
    """Trees on samples with replacement, all features; hash parts of the rows are drawn, not single rows."""
    return Settings("forest", n_estimators, max_depth, least=min_leaf, seed=seed)


def gbt(n_estimators: int = 200, learning_rate: float = 0.05, max_depth: int = 3, seed: int = 0) -> Settings:
    return Settings("boost", n_estimators, max_depth, learning_rate, seed=seed)


def xgboost(
    n_estimators: int = 400,
    max_depth: int = 6,
    learning_rate: float = 0.1,
    subsample: float = 0.8,
    colsample: float = 0.8,
    reg_lambda: float = 1.0,
    reg_alpha: float = 0.0,
    seed: int = 0,
) -> Settings:
    """Boosted trees with leaf penalties, on a share of the rows (hash parts) and of the features, drawn for each tree."""
    return Settings("boost", n_estimators, max_depth, learning_rate, 1.0, reg_lambda, reg_alpha, subsample, colsample, seed)


def tree(max_depth: int = 6, min_leaf: int = 10, seed: int = 0) -> Settings:
    return Settings("tree", 1, max_depth, least=min_leaf, seed=seed)


TREES = {"forest": forest, "gbt": gbt, "xgboost": xgboost, "tree": tree}


def tree_settings(family: str, params: Mapping | None = None) -> Settings:
    if family not in TREES:
        raise ValueError(f"unknown model family: {family}")
    return TREES[family](**(params or {}))


def fit_family(family: str, train: DataFrame, params: Mapping | None = None) -> Model:
    """A model of a ``(features, label)`` frame."""
    if family == "linear":
        return fit_linear(train, **(params or {}))
    if family == "ridge":
        return fit_ridge(train, **(params or {}))
    return TreeModel(fit_trees(train, [tree_settings(family, params)]))


@dataclass(frozen=True)
class MultiStepModel:
    """One model per forecast step on the flattened lookback window."""

    steps: tuple[Model, ...]

    def predict(self, windows: DataFrame, x: str = "x", out: str = "yhat") -> DataFrame:
        keep = windows.columns
        current = windows.withColumn("features", array_to_vector(F.flatten(x)))
        for i, model in enumerate(self.steps):
            current = model.setPredictionCol(f"_p{i}").transform(current)
        preds = F.array(*[F.col(f"_p{i}") for i in range(len(self.steps))])
        return current.select(*keep, preds.alias(out))


def fit_multi_output(
    windows: DataFrame, horizon: int, family: str, params: Mapping | None = None, x: str = "x", y: str = "y"
) -> MultiStepModel:
    """Fit one regressor per step of the target array ``y``; linear ones share one set of sums."""
    if family in LINEAR:
        alpha = {"ridge": {"alpha": 1.0}, "linear": {"alpha": 0.0}}[family] | dict(params or {})
        steps = F.transform(F.slice(y, 1, horizon), lambda v: v.cast("double"))
        return MultiStepModel(tuple(Gramian.of(windows, F.flatten(x), steps).models(**alpha)))
    models = []
    for step in range(horizon):
        train = training_frame(windows, F.flatten(x), F.element_at(y, step + 1))
        models.append(fit_family(family, train, params))
    return MultiStepModel(tuple(models))
