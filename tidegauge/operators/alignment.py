"""Bringing series together by position, by availability or by time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.ordering import MAX_ROWS_PER_TASK, join_facts, join_on, running


def zip_inner(series: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Positional inner alignment of a long table ``(*keys, name, row_idx, value)``.

    One output row per position, one column per name, cut to the shortest series present.
    """
    lengths = (
        series.groupBy(*keys, "name")
        .agg((F.max("row_idx") + 1).alias("_len"))
        .groupBy(*keys)
        .agg(F.min("_len").alias("_len"))
    )
    wide = series.groupBy(*keys, "row_idx").pivot("name", list(names)).agg(F.first("value"))
    if not keys:
        return wide.filter(F.col("row_idx") < lengths.scalar())
    return join_facts(wide, lengths, list(keys)).filter("row_idx < _len").drop("_len")


def zip_left(
    series: DataFrame, keys: Sequence[str], names: Sequence[str], anchors: Sequence[str]
) -> DataFrame:
    """Positional left alignment: as many rows as the shortest non-empty anchor series.

    Other series are cut to that length or padded with nulls; keys without an anchor have no
    rows. An absent series is a null column.
    """
    lengths = (
        series.filter(F.col("name").isin(*anchors))
        .groupBy(*keys, "name")
        .agg((F.max("row_idx") + 1).alias("_len"))
        .groupBy(*keys)
        .agg(F.min("_len").alias("_len"))
    )
    spine = lengths.select(
        *keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_len") - 1)).alias("row_idx")
    )
    wide = series.groupBy(*keys, "row_idx").pivot("name", list(names)).agg(F.first("value"))
    return join_on(spine, wide, [*keys, "row_idx"], "left")


def pivot_occurrences(
    long: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]
) -> DataFrame:
    """Series per name side by side, row ``i`` holding each name's ``i``-th value."""
    return long.groupBy(*keys, "row_idx").pivot(name, list(names)).agg(F.first(value))


def first_available(df: DataFrame, keys: Sequence[str], priority: Column, tie: str) -> DataFrame:
    """Per key the row with the lowest priority number, then the lowest ``tie``.

    A partial aggregate, so it does not matter how many candidates a key has.
    """
    best = F.min_by(F.struct(*df.columns), F.struct(priority, F.col(tie)))
    return df.groupBy(*keys).agg(best.alias("_best")).select("_best.*")


def asof_latest(
    left: DataFrame,
    right: DataFrame,
    time: str,
    value: str,
    keys: Sequence[str] = (),
    tie: str | None = None,
    max_age: float | None = None,
    seconds: Column | None = None,
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Attach to each left row the newest right ``value`` at or before its time.

    Both sides are merged into one time line, and the last value seen is carried along it.
    Of right rows of equal time the largest value counts. ``tie`` orders left rows of equal time; with ``max_age`` (in ``seconds``, a column over the
    time column) older values are null.
    """
    tie_cols = [tie] if tie else []
    rest = [c for c in left.columns if c not in (*keys, time, *tie_cols)]
    marked_left = left.select(
        *keys, time, *tie_cols, F.lit(1).alias("_side"), F.struct(F.lit(1).alias("_"), *rest).alias("_row")
    )
    marked_right = right.select(
        *keys, time, F.lit(0).alias("_side"), F.col(value).alias("_value")
    )
    line = marked_left.unionByName(marked_right, allowMissingColumns=True)
    stamp = F.when(F.col("_side") == 0, F.struct(F.col(time).alias("t"), F.col("_value").alias("v")))
    merged = running(
        line, [time, "_side", "_value", *tie_cols], keys, lasts={"_seen": stamp}, max_rows=max_rows
    ).filter("_side = 1")
    found = F.col("_seen.v")
    if max_age is not None:
        at = (lambda c: c.cast("double")) if seconds is None else seconds
        found = F.when(at(F.col(time)) - at(F.col("_seen.t")) <= max_age, found)
    return merged.select(
        *keys, time, *tie_cols, *[F.col(f"_row.{c}").alias(c) for c in rest], found.alias(value)
    )
