"""Scoring with fitted models: pairs of predictions, table slices, importance, forecasts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.models.mlp import predict_column
from tidegauge.models.network import Network
from tidegauge.models.regressors import MultiStepModel
from tidegauge.operators.ordering import MAX_ROWS_PER_TASK, head_rows, ordered_rows, tail_rows
from tidegauge.operators.sequence import last_window
from tidegauge.operators.stats import StandardScaler, accuracy_within

Predict = Callable[[Column], Column]


def scaled_vector(scaler: StandardScaler) -> Column:
    """Array of the scaler's columns, scaled."""
    return F.array(*[scaler.column(c) for c in scaler.columns])


def scaled_array(x: Column | str, scaler: StandardScaler) -> Column:
    """An array in the scaler's column order, scaled element by element."""
    x = F.col(x) if isinstance(x, str) else x
    return F.array(
        *[(x[i] - F.lit(m)) / F.lit(s) for i, (m, s) in enumerate(zip(scaler.mean, scaler.scale))]
    )


def score_pair(df: DataFrame, x: str, baseline: Network, current: Network) -> DataFrame:
    """Predictions of both models on the same rows."""
    return df.withColumns(
        {"pred_orig": predict_column(baseline, x), "pred_adj": predict_column(current, x)}
    )


def slice_accuracy(
    df: DataFrame, order: Sequence[str], take: str, rows: int, truth: str, pred: str, threshold: float
) -> DataFrame:
    """Percent within the threshold on the first or last rows: ``(n, acc)``."""
    cut = (tail_rows if take == "tail" else head_rows)(df, rows, order)
    return cut.agg(
        F.count(F.lit(1)).alias("n"), accuracy_within(truth, pred, threshold).alias("acc")
    )


def permutation_importance(
    df: DataFrame,
    order: Sequence[str],
    features: Sequence[str],
    x: str,
    y: str,
    predict: Predict,
    repeat: int = 3,
    seed: int = 0,
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """``(feature, mae_increase)``: mean growth of the absolute error when one feature is
    shuffled.

    All features and repetitions come from one seeded order of the rows (the MD5 of the seed and
    the order columns): variant ``v`` gives each row the feature of the row ``v + 1`` places
    before it, and the first rows take it from the end. The order depends on the data and the seed alone, so
    the result does not change with partitions or cluster settings.
    """
    total = df.count()
    if total < 2:
        raise ValueError("not enough rows to shuffle")
    variants = [(j, r) for j in range(len(features)) for r in range(repeat)]
    reach = min(len(variants), total - 1)
    shifts = [1 + v % reach for v in range(len(variants))]
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in order])
    rows = df.select(F.md5(text).alias("_a"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(x).alias("_x"), F.col(y).alias("_y"))
    spots = ["_a", *[f"_o{i}" for i in range(len(order))]]
    ordered = ordered_rows(rows, spots, before=reach, max_rows=max_rows, largest=total)
    w = ordered.window
    placed = ordered.finish(
        ordered.rows.select(
            "*",
            *[F.lag(F.get("_x", F.lit(j)), k).over(w).alias(f"_v{v}") for v, ((j, _), k) in enumerate(zip(variants, shifts))],
        )
    ).withColumn("_n", F.col("row_idx") + 1)
    # As many rows as there are variants.
    last = tail_rows(rows, reach, spots).orderBy(*[F.desc(c) for c in spots]).select("_x").collect()
    ends = F.array(*[F.array(*[F.lit(None if e is None else float(e)) for e in r["_x"]]) for r in last])
    mixed = placed.withColumn("_ends", ends)

    def error(v: int) -> Column:
        j, k = variants[v][0], shifts[v]
        # Row n <= k takes the k - n + 1 th row from the end.
        wrapped = F.get(F.get("_ends", (F.lit(k) - F.col("_n")).cast("int")), F.lit(j))
        new = F.when(F.col("_n") <= k, wrapped).otherwise(F.col(f"_v{v}"))
        swapped = F.concat(F.slice("_x", 1, j), F.array(new), F.slice("_x", j + 2, len(features)))
        return F.abs(predict(swapped) - F.col("_y"))

    base = df.agg(F.avg(F.abs(predict(F.col(x)) - F.col(y)))).first()[0]
    scored = mixed.select(*[error(v).alias(f"_e{v}") for v in range(len(variants))])
    means = scored.agg(*[F.avg(f"_e{v}").alias(f"_e{v}") for v in range(len(variants))])

    def increase(j: int) -> Column:
        own = [F.col(f"_e{v}") for v, (f, _) in enumerate(variants) if f == j]
        return reduce(lambda p, q: p + q, own) / len(own) - F.lit(base)

    table = F.array(
        *[F.struct(F.lit(name).alias("feature"), increase(j).alias("mae_increase")) for j, name in enumerate(features)]
    )
    return means.select(F.inline(table)).orderBy(F.desc("mae_increase"), "feature")


def publish_forecast(
    df: DataFrame,
    order: Sequence[str],
    features: Sequence[str],
    lookback: int,
    model: MultiStepModel,
    group: Sequence[str] = (),
) -> DataFrame:
    """Forecast of every series from its newest window: ``(*group, step, pred)``."""
    from tidegauge.sources.sinks import forecast_steps

    newest = last_window(df, order, features, lookback, group)
    return forecast_steps(model.predict(newest), "yhat", group)
