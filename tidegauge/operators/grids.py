"""Parameter grids as small frames."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.scalars import canonical_model
from tidegauge.operators.ordering import first_seen

# The retrain grids per drift tier, and the number of finalists.
HIDDEN_LAYERS = {
    "A": ((32, 16), (64, 32)),
    "B": ((64, 32), (96, 48), (128, 64)),
    "C": ((128, 64), (160, 80), (192, 96)),
}
LEARNING_RATES = {"A": (5e-3, 1e-2), "B": (3e-3, 1e-2), "C": (1e-3, 3e-3, 1e-2)}
BATCH_SIZES = (16, 32)
ACTIVATIONS = {"A": ("relu", "gelu"), "B": ("relu", "gelu"), "C": ("relu", "mse")}
LOSSES = {"A": ("smoothl1",), "B": ("smoothl1", "mse"), "C": ("smoothl1", "mse")}
WEIGHT_DECAYS = (0.0, 1e-4)
FINALISTS = {"A": 2, "B": 3, "C": 3}

# Search grids of the model families.
RIDGE_ALPHAS = (1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0)
FOREST_TREES, FOREST_DEPTHS = (200, 400, 800), (6, 8, 10)
BOOSTING_TREES, BOOSTING_RATES = (200, 400, 800), (0.1, 0.05)
FORECAST_TREES, FORECAST_DEPTHS, FORECAST_RATES = (200, 400), (4, 6, 8), (0.1, 0.05)

GRID_SCHEMA = (
    "candidate_id int, tier string, lr double, batch_size int, hidden array<int>, "
    "activation string, loss string, wd double"
)


def expand_grid(df: DataFrame, axes: Mapping[str, Sequence]) -> DataFrame:
    """Every row with every combination of the axis values."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def prune_grid(grid: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Keep the combinations of families that made the candidate list."""
    return grid.join(candidates.select(key).distinct(), key, "left_semi")


def tier_grid(
    spark: SparkSession, tier: str, current_hidden: Sequence[int] | None = None
) -> DataFrame:
    """Retrain candidates of a drift tier; the current shape comes first.

    Unknown tiers use the middle grid.
    """
    tier = tier if tier in HIDDEN_LAYERS else "B"
    shapes = [tuple(current_hidden)] if current_hidden else []
    shapes += [h for h in HIDDEN_LAYERS[tier] if h not in shapes]
    combos = product(
        LEARNING_RATES[tier], BATCH_SIZES, shapes, ACTIVATIONS[tier], LOSSES[tier], WEIGHT_DECAYS
    )
    rows = [
        (i, tier, lr, bs, list(hidden), act, loss, wd)
        for i, (lr, bs, hidden, act, loss, wd) in enumerate(combos)
    ]
    return spark.createDataFrame(rows, GRID_SCHEMA)


def forecast_grid() -> list[tuple[str, dict]]:
    """Candidates ``(family, params)`` of the forecast search."""
    out: list[tuple[str, dict]] = [("ridge", {"alpha": a}) for a in RIDGE_ALPHAS]
    out += [
        ("xgboost", {"n_estimators": n, "max_depth": d, "learning_rate": lr, "subsample": 0.8})
        for n, d, lr in product(FORECAST_TREES, FORECAST_DEPTHS, FORECAST_RATES)
    ]
    return out


def table_grid() -> list[tuple[str, dict]]:
    """Candidates ``(family, params)`` of the table-regression search."""
    out: list[tuple[str, dict]] = [("linear", {})]
    out += [("ridge", {"alpha": a}) for a in RIDGE_ALPHAS]
    out += [("forest", {"n_estimators": n, "max_depth": d}) for n, d in product(FOREST_TREES, FOREST_DEPTHS)]
    out += [("gbt", {"n_estimators": n, "learning_rate": lr}) for n, lr in product(BOOSTING_TREES, BOOSTING_RATES)]
    out += [
        ("xgboost", {"n_estimators": n, "max_depth": d, "learning_rate": lr, "subsample": 0.8})
        for n, d, lr in product(BOOSTING_TREES, (6, 8), BOOSTING_RATES)
    ]
    return out


def grid_frame(spark: SparkSession, grid: Sequence[tuple[str, dict]]) -> DataFrame:
    """The grid as rows ``(family, params)`` with JSON parameters."""
    return spark.createDataFrame([(k, json.dumps(p)) for k, p in grid], "family string, params string")


def candidate_families(
    ranked: DataFrame, k: int, model: str = "model", rank: str = "rank"
) -> DataFrame:
    """Canonical families of a ranking in order of first appearance, the first ``k``."""
    named = ranked.select(canonical_model(model).alias("family"), F.col(rank).alias("rank"))
    return first_seen(named.filter("family is not null"), "family", "rank").orderBy("rank").limit(k)
