"""Lookback/horizon windows, counters and running accuracy over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalars import relative_error, to_number
from tidegauge.operators.ordering import (
    MAX_ROWS_PER_TASK,
    MAX_TOP_ROWS,
    join_facts,
    largest_group,
    limits_per_task,
    ordered_rows,
    row_index,
    running,
    tail_rows,
)


def _vector(df: DataFrame, features: Sequence[str]) -> Column:
    """Features as an array; what is absent or not a number is 0.0."""
    have = set(df.columns)
    return F.array(
        *[
            F.coalesce(to_number(F.col(f"`{c}`")), F.lit(0.0)) if c in have else F.lit(0.0)
            for c in features
        ]
    )


def sliding_windows(
    df: DataFrame,
    order: Sequence[str],
    features: Sequence[str],
    target: str,
    lookback: int,
    horizon: int,
    multi_output: bool = False,
    take_last: int | None = None,
    group: Sequence[str] = (),
    max_rows: int = MAX_ROWS_PER_TASK,
    require: bool = False,
) -> DataFrame:
    """``(*group, window_start, x, y)`` for every complete window.

    ``x`` holds ``lookback`` feature arrays; ``y`` is the target ``horizon`` rows after them,
    or all ``horizon`` next targets with ``multi_output``. Rows without a target are dropped
    before rows are counted, missing features are 0.0. ``take_last`` keeps the last windows
    of each group. With ``require`` an empty result is an error.
    """
    span = lookback + horizon
    narrow = (
        df.select(*group, *order, _vector(df, features).alias("_x"), to_number(F.col(f"`{target}`")).alias("_y"))
        .na.drop(subset=["_y"])
    )

    shift = 0
    if take_last and not group and take_last + span <= MAX_TOP_ROWS:
        # Only the rows of the wanted windows are sorted.
        shift = max(0, narrow.count() - (take_last + span - 1))
        narrow = tail_rows(narrow, take_last + span - 1, order)
    largest = largest_group(narrow, group)
    ordered = ordered_rows(
        narrow, order, group, after=span - 1, max_rows=max_rows, largest=largest
    )
    w = ordered.window
    if multi_output:
        y = F.collect_list("_y").over(w.rowsBetween(lookback, span - 1))
    else:
        y = F.lead("_y", span - 1).over(w)
    windows = ordered.rows.select(
        *group,
        "row_idx",
        *(["_owned", "_block"] if ordered.blocked else []),
        F.collect_list("_x").over(w.rowsBetween(0, lookback - 1)).alias("x"),
        y.alias("y"),
        F.lead("row_idx", span - 1).over(w).alias("_end"),
    ).filter("_end is not null")
    windows = ordered.finish(windows).select(
        *group, (F.col("row_idx") + shift).alias("window_start"), "x", "y"
    )
    if take_last and not shift:
        sizes = narrow.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
        sized = join_facts(windows, sizes, list(group)) if group else windows.withColumn("_n", sizes.scalar())
        windows = sized.filter(F.col("window_start") > F.col("_n") - span - take_last).drop("_n")
    if require and windows.isEmpty():
        raise ValueError(f"not enough rows for windows of lookback={lookback}, horizon={horizon}")
    return windows


def last_window(
    df: DataFrame,
    order: Sequence[str],
    features: Sequence[str],
    lookback: int,
    group: Sequence[str] = (),
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """The newest ``lookback`` feature rows of each group as ``(*group, x)``.

    Only groups with at least ``lookback`` rows have one.
    """
    rows = df.select(*group, *order, _vector(df, features).alias("_x"))
    if not group:
        newest = tail_rows(rows, lookback, order, max_rows)
    elif limits_per_task(rows, lookback):
        back = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
        newest = rows.withColumn("_n", F.row_number().over(back)).filter(F.col("_n") <= lookback)
    else:
        indexed = row_index(rows, order, group, max_rows=max_rows)
        sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
        newest = join_facts(indexed, sizes, list(group)).filter(F.col("row_idx") >= F.col("_size") - lookback)
    # At most ``lookback`` rows per group are left.
    stamped = F.struct(F.struct(*order).alias("k"), F.col("_x").alias("x"))
    found = newest.groupBy(*group).agg(F.sort_array(F.collect_list(stamped)).alias("_rows"))
    return found.filter(F.size("_rows") == lookback).select(
        *group, F.transform("_rows", lambda r: r["x"]).alias("x")
    )


def moving_mean(
    df: DataFrame,
    order: Sequence[str],
    target: str,
    lookback: int,
    horizon: int,
    group: Sequence[str] = (),
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Mean of the last ``lookback`` targets, repeated ``horizon`` times, per full window."""
    ordered = ordered_rows(df, order, group, before=lookback - 1, max_rows=max_rows)
    mean = F.avg(target).over(ordered.window.rowsBetween(-(lookback - 1), 0))
    out = ordered.rows.withColumn("mean", mean).filter(F.col("row_idx") >= lookback - 1)
    return ordered.finish(out).withColumn("forecast", F.array_repeat("mean", horizon))


def counter_rate(
    df: DataFrame,
    order: str,
    counter: str,
    group: Sequence[str] = (),
    seconds: Column | None = None,
    max_rows: int = MAX_ROWS_PER_TASK,
    tie: str | None = None,
) -> DataFrame:
    """Rate of a monotone counter between neighbouring samples: ``vcpu`` and ``cpu_pct``.

    A counter that falls counts as no progress; samples without elapsed time are dropped.
    ``seconds`` is the time of a row, the order column itself by default. Rows of equal time are
    ordered by the counter, or by ``tie``.
    """
    timed = df.withColumn("_t", (F.col(order) if seconds is None else seconds).cast("double"))
    ordered = ordered_rows(timed, [order, tie or counter], group, before=1, max_rows=max_rows)
    w = ordered.window
    out = ordered.rows.withColumns(
        {
            "_dt": F.col("_t") - F.lag("_t").over(w),
            "_dc": F.greatest(F.lit(0.0), F.col(counter) - F.lag(counter).over(w)),
        }
    )
    rate = F.col("_dc") / F.col("_dt")
    return (
        ordered.finish(out)
        .filter("_dt > 0")
        .withColumns({"vcpu": rate, "cpu_pct": rate * 100})
        .drop("_t", "_dt", "_dc")
    )


def cumulative_accuracy(
    df: DataFrame,
    order: Sequence[str],
    truth: str,
    pred: str,
    threshold: float = 0.25,
    group: Sequence[str] = (),
    eps: float = 1e-8,
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Running share of rows whose relative error stays within the threshold."""
    hit = F.when(relative_error(pred, truth, eps) <= threshold, 1).otherwise(0)
    ran = running(df, order, group, sums={"correct": hit}, max_rows=max_rows)
    return ran.withColumns(
        {"total": F.col("row_idx") + 1, "cum_acc": F.col("correct") / (F.col("row_idx") + 1)}
    )
