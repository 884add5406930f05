"""Statistics over whole tables or groups, each in one aggregation pass where possible."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalars import finite, relative_error
from tidegauge.operators.ordering import MAX_ROWS_PER_TASK, exact_quantiles, largest_group


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation, null when either side is constant."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Rows ``(feature, position, abs_corr)``: |Pearson| with the target, 0.0 when undefined."""
    one = df.agg(*[pearson(F.col(f"`{c}`"), F.col(f"`{target}`")).alias(f"c{i}") for i, c in enumerate(features)])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.lit(i).alias("position"),
                F.coalesce(F.abs(finite(F.col(f"c{i}"))), F.lit(0.0)).alias("abs_corr"),
            )
            for i, c in enumerate(features)
        ]
    )
    return one.select(F.inline(rows))


def corr_topk(df: DataFrame, features: Sequence[str], target: str, k: int = 10) -> DataFrame:
    """The ``k`` features with the largest |Pearson|; ties keep column order."""
    return correlations(df, features, target).orderBy(F.desc("abs_corr"), "position").limit(k)


def selected_features(df: DataFrame, features: Sequence[str], target: str, k: int = 10) -> list[str]:
    return [r["feature"] for r in corr_topk(df, features, target, k).collect()]


@dataclass(frozen=True)
class StandardScaler:
    """Column means and population standard deviations; a zero deviation scales by 1."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str], with_mean: bool = True) -> "StandardScaler":
        row = df.agg(
            *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(columns)],
        ).first()
        n = len(columns)
        means = [row[f"m{i}"] or 0.0 if with_mean else 0.0 for i in range(n)]
        scales = [row[f"s{i}"] or 1.0 for i in range(n)]
        return StandardScaler(tuple(columns), tuple(means), tuple(scales))

    def column(self, name: str) -> Column:
        i = self.columns.index(name)
        return (F.col(f"`{name}`") - F.lit(self.mean[i])) / F.lit(self.scale[i])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.column(c) for c in self.columns})


def standardize(df: DataFrame, columns: Sequence[str], with_mean: bool = True) -> DataFrame:
    return StandardScaler.fit(df, columns, with_mean).transform(df)


def accuracy_within(
    truth: Column | str,
    pred: Column | str,
    threshold: float,
    mode: str = "relative",
    eps: float = 1e-6,
    as_percent: bool = True,
) -> Column:
    """Aggregate: share of finite pairs whose error stays within the threshold, 0 if none."""
    y = F.col(truth) if isinstance(truth, str) else truth
    p = F.col(pred) if isinstance(pred, str) else pred
    both = finite(y).isNotNull() & finite(p).isNotNull()
    error = relative_error(p, y, eps) if mode.lower().startswith("rel") else F.abs(p - y)
    hit = F.avg(F.when(both, F.when(error <= threshold, 1.0).otherwise(0.0)))
    return F.coalesce(hit * (100.0 if as_percent else 1.0), F.lit(0.0))


def r_squared(truth: Column | str, pred: Column | str) -> Column:
    """Aggregate: 1 - SSres / SStot, null when the truth is constant."""
    y = F.col(truth) if isinstance(truth, str) else truth
    p = F.col(pred) if isinstance(pred, str) else pred
    y = F.when(p.isNotNull(), y)
    total = F.var_pop(y) * F.count(y)
    return F.when(total > 0, 1 - F.sum(F.pow(p - y, 2)) / total)


def error_metrics(
    df: DataFrame,
    truth: str,
    pred: str,
    group: Sequence[str] = (),
    thresholds: Sequence[float] = (0.25, 0.15),
    eps: float = 1e-6,
    as_percent: bool = True,
) -> DataFrame:
    """mae, rmse, r2, row count and one accuracy per threshold (``acc_25`` for 0.25)."""
    diff = F.col(pred) - F.col(truth)
    return df.groupBy(*group).agg(
        F.count(diff).alias("n"),
        F.avg(F.abs(diff)).alias("mae"),
        F.sqrt(F.avg(diff * diff)).alias("rmse"),
        r_squared(truth, pred).alias("r2"),
        *[
            accuracy_within(truth, pred, t, eps=eps, as_percent=as_percent).alias(
                f"acc_{round(t * 100):d}"
            )
            for t in thresholds
        ],
    )


def forecast_metrics(df: DataFrame, truth: str, pred: str, group: Sequence[str] = ()) -> DataFrame:
    """r2, mae and the share within 15 % on the first step of multi-step arrays."""
    first = df.select(
        *group,
        F.element_at(truth, 1).alias("_y"),
        F.element_at(pred, 1).alias("_p"),
    )
    return error_metrics(
        first, "_y", "_p", group, thresholds=(0.15,), eps=1e-8, as_percent=False
    ).select(*group, "r2", "mae", "acc_15")


def error_quantiles(
    df: DataFrame,
    truth: str,
    pred: str,
    group: Sequence[str] = (),
    quantiles: Sequence[float] = (0.5, 0.8, 0.9, 0.95, 0.99),
    eps: float = 1e-8,
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Exact quantiles of the relative error as rows ``(*group, q, value)``."""
    errors = df.select(*group, relative_error(pred, truth, eps).alias("_err"))
    return exact_quantiles(errors, "_err", quantiles, group, max_rows, largest_group(df, group))


def batch_metrics(
    df: DataFrame, batch: str, truth: str, pred: str, threshold: float = 0.15
) -> DataFrame:
    """Rows, hits and hit rate of each batch."""
    hit = F.when(relative_error(pred, truth) <= threshold, 1).otherwise(0)
    return df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(hit).alias("hits"),
        F.avg(hit).alias("hit_rate"),
    )


def modal_value(df: DataFrame, column: str, group: Sequence[str] = ()) -> DataFrame:
    """Most frequent value; the smallest one among equals.

    Values are counted first, so no single aggregation buffer holds all of them.
    """
    counted = df.groupBy(*group, column).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(F.struct(column, "_n"), F.struct(-F.col("_n"), F.col(column)))
    return (
        counted.groupBy(*group)
        .agg(best.alias("_best"))
        .select(*group, F.col(f"_best.{column}").alias(column), F.col("_best._n").alias("n"))
    )


def median_abs(
    df: DataFrame,
    column: str,
    group: Sequence[str],
    max_rows: int = MAX_ROWS_PER_TASK,
    largest: int | None = None,
) -> DataFrame:
    """Exact median of |value| per group as ``(*group, median_abs)``."""
    absolute = df.select(*group, F.abs(F.col(column)).alias("_abs"))
    found = exact_quantiles(absolute, "_abs", [0.5], group, max_rows, largest)
    return found.select(*group, F.col("value").alias("median_abs"))


def label_coverage(df: DataFrame, label: str, split: Sequence[str] = ()) -> DataFrame:
    """Rows and labelled rows per split."""
    return df.groupBy(*split).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.col(label)).alias("labelled")
    )
