"""Drift of a series against its own beginning, over count-based sliding windows.

The first ``size`` rows of a series are its baseline. From then on every ``stride`` rows the
last ``size`` rows are compared with the baseline: window ``k`` (from 1) covers the rows
``k * stride .. k * stride + size - 1``. Each feature is binned, the two histograms are
compared with the Jensen-Shannon divergence, and the divergences are averaged.

Rows travel once, to a block of consecutive windows; they are multiplied into the windows they
belong to only inside that block, and every later grouping contains the block key, so a series
of any length spreads over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.scalars import DRIFT_TIERS, drift_tier
from tidegauge.operators.ordering import (
    MAX_ROWS_PER_TASK,
    exact_quantiles,
    join_facts,
    join_on,
    largest_group,
    limits_per_task,
    ordered_rows,
    row_index,
    running,
)

WINDOW_SIZE = 300
WINDOW_STRIDE = 50
HISTOGRAM_BINS = 64
SMOOTHING = 1e-12

_WINDOWS_PER_BLOCK = 64


def window_span(size: int, stride: int, first: int = 1) -> tuple[Column, Column]:
    """First and last window that contain the row ``row_idx``."""
    idx = F.col("row_idx")
    low = F.greatest(F.lit(first), F.ceil((idx - size + 1) / stride)).cast("bigint")
    high = F.floor(idx / stride).cast("bigint")
    return low, high


def count_windows(
    df: DataFrame,
    order: Sequence[str],
    group: Sequence[str] = (),
    size: int = WINDOW_SIZE,
    stride: int = WINDOW_STRIDE,
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Rows of every complete evaluation window, tagged with ``window_id``.

    The baseline rows appear once more as window 0.
    """
    largest = largest_group(df, group)
    indexed = row_index(df, order, group, max_rows=max_rows, largest=largest)
    low, high = window_span(size, stride, first=0)
    totals = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    if group:
        sized = join_facts(indexed, totals, list(group))
    else:
        sized = indexed.withColumn("_n", totals.scalar())
    last = F.floor((F.col("_n") - size) / stride).cast("bigint")
    return (
        sized.withColumns({"_low": low, "_high": F.least(high, last)})
        .filter("_low <= _high")
        .withColumn("window_id", F.explode(F.sequence("_low", "_high")))
        .drop("_low", "_high", "_n")
    )


@dataclass(frozen=True)
class _Series:
    """Rows of all series, keyed by ``_g`` (a struct, so never null) with features ``_x``."""

    rows: DataFrame
    orders: list[str]
    largest: int
    max_rows: int

    @staticmethod
    def of(df: DataFrame, order: Sequence[str], features: Sequence[str], group: Sequence[str], max_rows: int):
        key = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)], F.lit(0).alias("_"))
        rows = df.select(
            key.alias("_g"),
            *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
            F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("_x"),
        )
        return _Series(rows, [f"_o{i}" for i in range(len(order))], largest_group(df, group), max_rows)

    def indexed(self) -> DataFrame:
        rows = row_index(self.rows, self.orders, ["_g"], max_rows=self.max_rows, largest=self.largest)
        return rows.drop(*self.orders)

    def baselines(self, size: int) -> DataFrame:
        """One row per series with at least ``size`` rows: the first ones as an array.

        The row number is compared directly, so every task passes on its first rows only.
        """
        if limits_per_task(self.rows, size):
            first = Window.partitionBy("_g").orderBy(*self.orders)
            rows = self.rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= size)
        else:
            rows = self.indexed().filter(F.col("row_idx") < size)
        return (
            rows.groupBy("_g")
            .agg(F.collect_list("_x").alias("_base"))
            .filter(F.size("_base") == size)
        )

    def block_baselines(self, baselines: DataFrame, size: int, stride: int, per_block: int) -> DataFrame:
        """Repeat a baseline for each block of windows of its series."""
        totals = self.rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
        last_window = F.floor((F.col("_n") - size) / stride)
        last_block = F.floor(last_window / per_block).cast("bigint")
        return (
            join_on(baselines, totals, ["_g"])
            .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last_block)))
            .drop("_n")
        )


def _in_blocks(indexed: DataFrame, size: int, stride: int, per_block: int) -> DataFrame:
    """Send each row to the blocks of the windows it belongs to (mostly one).

    The number of partitions is fixed: rows are multiplied after this exchange, so its size
    says little about the work to come.
    """
    low, high = window_span(size, stride)
    blocks = F.sequence(F.floor(F.col("_low") / per_block), F.floor(F.col("_high") / per_block))
    n = int(indexed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        indexed.withColumns({"_low": low, "_high": high})
        .filter("_low <= _high")
        .withColumn("_block", F.explode(blocks.cast("array<bigint>")))
        .repartition(n, "_g", "_block")
    )


def _block_windows(per_block: int) -> Column:
    """Windows of the block that contain the row."""
    return F.explode(
        F.sequence(
            F.greatest("_low", F.col("_block") * per_block),
            F.least("_high", F.col("_block") * per_block + (per_block - 1)),
        )
    )


def _extremes(rows: str, j: int) -> tuple[Column, Column]:
    values = F.transform(F.col(rows), lambda x: x[j])
    return F.array_min(values), F.array_max(values)


def _bounds(arrays: Sequence[str], n_features: int) -> dict[str, Column]:
    """Per-feature minimum and maximum over the given arrays of rows."""
    lows, highs = [], []
    for j in range(n_features):
        ends = [_extremes(a, j) for a in arrays]
        lows.append(F.least(*[e[0] for e in ends]) if len(ends) > 1 else ends[0][0])
        highs.append(F.greatest(*[e[1] for e in ends]) if len(ends) > 1 else ends[0][1])
    return {"_lo": F.array(*lows), "_hi": F.array(*highs)}


def _smoothed(count: Column, n: Column, spread: Column, bins: int) -> Column:
    """Bin probability from a count: density, plus the smoothing term, renormalised."""
    width = spread / bins
    return (count / (n * width) + SMOOTHING) / (1 / width + bins * SMOOTHING)


def _js_term(p: Column, q: Column) -> Column:
    m = (p + q) / 2
    return (p * F.log(p / m) + q * F.log(q / m)) / 2


def score_windows(
    pairs: DataFrame, keys: Sequence[str], n_features: int, bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """Mean divergence per row of ``pairs``, which holds a window (array column ``_rows``) and
    its baseline (``_base``), both arrays of feature arrays.

    Bins span the joint range of both sides. Bins empty on both sides have equal
    probabilities and add nothing, so only occupied bins are formed. Features without spread
    are left out; the score is 0.0 when none is left.
    """
    tagged = F.concat(
        F.transform("_base", lambda x: F.struct(F.lit(1).alias("b"), x.alias("x"))),
        F.transform("_rows", lambda x: F.struct(F.lit(0).alias("b"), x.alias("x"))),
    )
    values = (
        pairs.withColumns(_bounds(["_rows", "_base"], n_features))
        .select(
            *keys, "_lo", "_hi",
            F.size("_base").alias("_nb"), F.size("_rows").alias("_nw"),
            F.explode(tagged).alias("_t"),
        )
        .select(
            *keys, "_lo", "_hi", "_nb", "_nw", F.col("_t.b").alias("_b"),
            F.posexplode("_t.x").alias("_j", "_v"),
        )
        .withColumns(
            {"_l": F.col("_lo")[F.col("_j")], "_d": F.col("_hi")[F.col("_j")] - F.col("_lo")[F.col("_j")]}
        )
        .withColumn(
            "_bin",
            F.when(
                F.col("_d") > 0,
                F.least(F.floor((F.col("_v") - F.col("_l")) / F.col("_d") * bins), F.lit(bins - 1)),
            ),
        )
    )
    counts = values.groupBy(*keys, "_j", "_bin").agg(
        F.sum("_b").alias("_cb"),
        F.sum(1 - F.col("_b")).alias("_cw"),
        F.first("_nb").alias("_nb"),
        F.first("_nw").alias("_nw"),
        F.first("_d").alias("_d"),
    )
    p = _smoothed(F.col("_cb"), F.col("_nb"), F.col("_d"), bins)
    q = _smoothed(F.col("_cw"), F.col("_nw"), F.col("_d"), bins)
    term = F.when(F.col("_d") > 0, _js_term(p, q))
    return (
        counts.groupBy(*keys, "_j")
        .agg(F.sum(term).alias("_js"))
        .groupBy(*keys)
        .agg(F.coalesce(F.avg("_js"), F.lit(0.0)).alias("js"))
    )


def _joint_scores(series: _Series, size, stride, bins, n_features, per_block) -> DataFrame:
    windows = (
        _in_blocks(series.indexed(), size, stride, per_block)
        .withColumn("window_id", _block_windows(per_block))
        .groupBy("_g", "_block", "window_id")
        .agg(F.collect_list("_x").alias("_rows"))
        .filter(F.size("_rows") == size)
    )
    base = series.block_baselines(series.baselines(size), size, stride, per_block)
    # One short row per block; the windows stay where they are.
    pairs = join_on(windows, base, ["_g", "_block"], hint="shuffle_hash")
    return score_windows(pairs, ["_g", "_block", "window_id"], n_features, bins).drop("_block")


def frozen_divergences(base: np.ndarray, rows: np.ndarray, first: int, starts: np.ndarray, size: int, pane: int, bins: int) -> np.ndarray:
    """Divergence of the windows at ``starts`` from the baseline, whose ranges fix the bins.

    ``rows`` are consecutive from row ``first``, a multiple of the pane. Histograms of panes are
    summed up once; those of any window are the difference of two rows of the sums.
    """
    lo, hi = base.min(axis=0), base.max(axis=0)
    used = np.flatnonzero(hi > lo)
    if not len(used):
        return np.zeros(len(starts))
    spread = (hi - lo)[used]

    def spots(x: np.ndarray) -> np.ndarray:
        at = np.floor((x[:, used] - lo[used]) / spread * bins)
        return np.clip(np.where(np.isnan(at), bins - 1, at), 0, bins - 1).astype(np.int64)

    width = len(used) * bins
    cell = np.arange(len(used)) * bins
    panes = -(-len(rows) // pane)
    place = (np.arange(len(rows)) // pane)[:, None] * width + cell + spots(rows)
    counts = np.bincount(place.ravel(), minlength=panes * width).reshape(panes, width)
    sums = np.concatenate([np.zeros((1, width), np.int64), counts.cumsum(axis=0)])
    at = (starts - first) // pane
    window = (sums[at + size // pane] - sums[at]).reshape(len(starts), len(used), bins)
    whole = np.bincount((cell + spots(base)).ravel(), minlength=width).reshape(len(used), bins)
    step = (spread / bins)[:, None]
    p, q = ((c / (size * step) + SMOOTHING) / (1 / step + bins * SMOOTHING) for c in (whole, window))
    middle = (p + q) / 2
    return ((p * np.log(p / middle) + q * np.log(q / middle)) / 2).sum(axis=2).mean(axis=1)


def _frozen_scores(series: _Series, size, stride, bins, n_features, per_block) -> DataFrame:
    """Bins fixed by the baseline; a task holds the rows of a block of windows, each once."""
    pane = math.gcd(size, stride)
    base = series.block_baselines(series.baselines(size), size, stride, per_block)
    base = base.select(F.col("_g").alias("_h"), F.col("_block").alias("_c"), "_base")
    blocked = _in_blocks(series.indexed(), size, stride, per_block).select("_g", "_block", "row_idx", "_x")
    schema = T.StructType([blocked.schema["_g"], T.StructField("window_id", T.LongType()), T.StructField("js", T.DoubleType())])

    def score(rows: pa.Table, bases: pa.Table) -> pa.Table:
        ids, js = np.zeros(0, np.int64), np.zeros(0)
        if rows.num_rows and bases.num_rows:
            at = rows["row_idx"].to_numpy()
            order = np.argsort(at)
            x = np.array(rows["_x"].to_pylist(), float)[order]
            first, end = int(at.min()), int(at.max()) + 1
            block = bases["_c"][0].as_py()
            ids = np.arange(max(1, block * per_block), (block + 1) * per_block)
            ids = ids[(ids * stride >= first) & (ids * stride + size <= end)]
            js = frozen_divergences(np.array(bases["_base"][0].as_py(), float), x, first, ids * stride, size, pane, bins)
        group = (bases["_h"] if bases.num_rows else rows["_g"]).take(pa.array(np.zeros(len(ids), np.int64)))
        return pa.table([group, pa.array(ids, pa.int64()), pa.array(js, pa.float64())], names=schema.names)

    return blocked.groupBy("_g", "_block").cogroup(base.groupBy("_h", "_c")).applyInArrow(score, schema)


def drift_windows(
    df: DataFrame,
    order: Sequence[str],
    features: Sequence[str],
    group: Sequence[str] = (),
    size: int = WINDOW_SIZE,
    stride: int = WINDOW_STRIDE,
    bins: int = HISTOGRAM_BINS,
    range_mode: str = "joint",
    log_base: float | None = None,
    tiers: Sequence[tuple[str, float]] = DRIFT_TIERS,
    max_rows: int = MAX_ROWS_PER_TASK,
    windows_per_block: int = _WINDOWS_PER_BLOCK,
) -> DataFrame:
    """``(*group, window_id, js, tier)`` for every complete evaluation window.

    ``range_mode`` is "joint" (bins span baseline and window) or "frozen" (bins span the
    baseline, values outside go to the edge bins). With natural logarithms a score is at most
    ln 2; ``log_base=2`` scales it to [0, 1].
    """
    if range_mode not in ("joint", "frozen"):
        raise ValueError(f"unknown range mode: {range_mode}")
    series = _Series.of(df, order, features, group, max_rows)
    score = _joint_scores if range_mode == "joint" else _frozen_scores
    scored = score(series, size, stride, bins, len(features), windows_per_block)
    js = F.col("js") / math.log(log_base) if log_base else F.col("js")
    return scored.select(
        *[F.col(f"_g.g{i}").alias(c) for i, c in enumerate(group)], "window_id", js.alias("js")
    ).withColumn("tier", drift_tier("js", tiers))


def drift_score(
    baseline: DataFrame,
    window: DataFrame,
    features: Sequence[str],
    keys: Sequence[str] = (),
    bins: int = HISTOGRAM_BINS,
    log_base: float | None = None,
) -> DataFrame:
    """Mean divergence between two tables of rows, per key: ``(*keys, js)``.

    The two sides may have any size: ranges and bin counts are partial aggregates.
    """
    names = [f"_g{i}" for i in range(len(keys))] or ["_g0"]

    def long(df: DataFrame, side: int) -> DataFrame:
        cols = [F.col(c).alias(k) for c, k in zip(keys, names)] or [F.lit(0).alias("_g0")]
        values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
        return df.select(*cols, F.lit(side).alias("_b"), F.posexplode(values).alias("_j", "_v"))

    rows = long(baseline, 1).unionByName(long(window, 0))
    ranges = rows.groupBy(*names, "_j").agg(
        F.min("_v").alias("_lo"),
        (F.max("_v") - F.min("_v")).alias("_d"),
        F.sum("_b").alias("_nb"),
        F.sum(1 - F.col("_b")).alias("_nw"),
    )
    spot = F.least(
        F.floor((F.col("_v") - F.col("_lo")) / F.col("_d") * bins), F.lit(bins - 1)
    )
    counts = (
        join_facts(rows, ranges, [*names, "_j"])
        .withColumn("_bin", F.when(F.col("_d") > 0, spot))
        .groupBy(*names, "_j", "_d", "_nb", "_nw", "_bin")
        .agg(F.sum("_b").alias("_cb"), F.sum(1 - F.col("_b")).alias("_cw"))
        .filter("_nb > 0 and _nw > 0")
    )
    p = _smoothed(F.col("_cb"), F.col("_nb"), F.col("_d"), bins)
    q = _smoothed(F.col("_cw"), F.col("_nw"), F.col("_d"), bins)
    js = F.coalesce(F.avg("_js"), F.lit(0.0))
    return (
        counts.groupBy(*names, "_j")
        .agg(F.sum(F.when(F.col("_d") > 0, _js_term(p, q))).alias("_js"))
        .groupBy(*names)
        .agg((js / math.log(log_base) if log_base else js).alias("js"))
        .select(*[F.col(k).alias(c) for k, c in zip(names, keys)], "js")
    )


def drift_episodes(
    scored: DataFrame,
    group: Sequence[str] = (),
    cooldown: int = 0,
    max_rows: int = MAX_ROWS_PER_TASK,
    largest: int | None = None,
) -> DataFrame:
    """Merge consecutive triggered windows into episodes.

    A trigger at most ``cooldown`` windows after the end of the one before it extends the
    same episode. ``largest`` is a known bound on the windows of one series.
    """
    triggered = scored.filter("tier is not null")
    if largest is None:
        largest = largest_group(triggered, group)
    ordered = ordered_rows(
        triggered, ["window_id"], group, before=1, max_rows=max_rows, largest=largest
    )
    gap = F.col("window_id") - F.lag("window_id").over(ordered.window)
    marked = ordered.finish(
        ordered.rows.withColumn(
            "_new", F.when(gap.isNull() | (gap > 1 + cooldown), 1).otherwise(0)
        )
    ).drop("row_idx")
    numbered = running(
        marked, ["window_id"], group, sums={"episode": F.col("_new")}, max_rows=max_rows, largest=largest
    )
    return numbered.groupBy(*group, F.col("episode").cast("bigint").alias("episode")).agg(
        F.min("window_id").alias("first_window"),
        F.max("window_id").alias("last_window"),
        F.count(F.lit(1)).alias("windows"),
        F.max("js").alias("max_js"),
        F.max("tier").alias("max_tier"),
        F.min_by("tier", "window_id").alias("first_tier"),
    )


def calibrate_thresholds(
    df: DataFrame,
    order: Sequence[str],
    features: Sequence[str],
    size: int = WINDOW_SIZE,
    resamples: int = 200,
    quantiles: Sequence[tuple[str, float]] = (("A", 0.9), ("B", 0.95), ("C", 0.99)),
    bins: int = HISTOGRAM_BINS,
    seed: int = 0,
    max_rows: int = MAX_ROWS_PER_TASK,
    draw: Column | None = None,
) -> DataFrame:
    """Thresholds from undrifted data, as rows ``(tier, threshold)``.

    Contiguous windows at seeded random starts are scored against the first window; the
    requested quantiles of those scores are the cut-offs. ``draw``, a whole number from the resample's
    ``id``, replaces the hash that the starts come from.
    """
    series = _Series.of(df, order, features, (), max_rows)
    total = series.largest
    if total < size:
        raise ValueError(f"not enough rows to calibrate: rows={total}, size={size}")
    spark = df.sparkSession
    starts = spark.range(resamples).select(
        F.col("id").alias("window_id"),
        F.pmod(F.xxhash64(F.lit(seed), "id") if draw is None else draw, F.lit(total - size + 1)).alias("_start"),
    )
    # resamples * size rows: bounded by the two parameters.
    picks = starts.select(
        "window_id", F.explode(F.sequence("_start", F.col("_start") + (size - 1))).alias("row_idx")
    )
    windows = (
        series.indexed().join(picks, "row_idx").groupBy("window_id").agg(F.collect_list("_x").alias("_rows"))
    )
    base = series.baselines(size).select("_base")
    pairs = windows.withColumn("_base", base.scalar())
    scores = score_windows(pairs, ["window_id"], len(features), bins)
    cut = exact_quantiles(scores, "js", [q for _, q in quantiles], largest=resamples)
    names = F.create_map(*[F.lit(x) for name, q in quantiles for x in (float(q), name)])
    return cut.select(names[F.col("q")].alias("tier"), F.col("value").alias("threshold"))
