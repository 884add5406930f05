"""Equal-width histograms and divergences between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.ordering import join_facts, join_on


def bin_of(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based bin; the right edge belongs to the last bin, values outside have none."""
    spot = F.floor((value - lo) / (hi - lo) * bins)
    inside = (value >= lo) & (value <= hi) & (hi > lo)
    return F.when(inside, F.least(spot, F.lit(bins - 1)).cast("int"))


def with_range(
    df: DataFrame, value: str, group: Sequence[str] = (), lo: float | None = None, hi: float | None = None
) -> DataFrame:
    """Attach ``_lo`` and ``_hi``: the given range, or the range of each group's values.

    A group without spread gets half a unit to either side.
    """
    if lo is not None and hi is not None:
        return df.withColumns({"_lo": F.lit(float(lo)), "_hi": F.lit(float(hi))})
    bounds = df.groupBy(*group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    if group:
        ranged = join_facts(df, bounds, list(group))
    else:
        ranged = df.withColumns(
            {"_lo": bounds.select("_lo").scalar(), "_hi": bounds.select("_hi").scalar()}
        )
    flat = F.col("_lo") == F.col("_hi")
    half = F.when(flat, 0.5).otherwise(0.0)
    return ranged.withColumn("_hi", F.col("_hi") + half).withColumn("_lo", F.col("_lo") - half)


def histogram(
    df: DataFrame,
    value: str,
    bins: int,
    lo: float | None = None,
    hi: float | None = None,
    group: Sequence[str] = (),
) -> DataFrame:
    """Counts of the occupied bins as ``(*group, bin, n)``."""
    ranged = with_range(df.select(*group, value).filter(F.col(value).isNotNull()), value, group, lo, hi)
    spot = bin_of(F.col(value), F.col("_lo"), F.col("_hi"), bins)
    return (
        ranged.select(*group, spot.alias("bin"))
        .filter("bin is not null")
        .groupBy(*group, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def prob_hist(
    df: DataFrame,
    value: str,
    bins: int,
    lo: float | None = None,
    hi: float | None = None,
    group: Sequence[str] = (),
) -> DataFrame:
    """All bins with probabilities ``(*group, bin, p)``; uniform when no value is in range."""
    counts = histogram(df, value, bins, lo, hi, group)
    keys = df.select(*group).distinct() if group else df.sparkSession.range(1).select()
    spine = keys.select(*group, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = join_on(spine, counts, [*group, "bin"], "left")
    total = F.sum("n").over(Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0)))
    share = F.when(total > 0, F.coalesce(F.col("n"), F.lit(0)) / total).otherwise(F.lit(1.0 / bins))
    return full.select(*group, "bin", share.alias("p"))


def kl_term(p: Column, q: Column, eps: float = 1e-12) -> Column:
    """One bin's share of the Kullback-Leibler divergence, probabilities clipped to [eps, 1]."""
    p = F.greatest(F.least(p, F.lit(1.0)), F.lit(eps))
    q = F.greatest(F.least(q, F.lit(1.0)), F.lit(eps))
    return p * (F.log(p) - F.log(q))


def kl_divergence(p: Column, q: Column) -> Column:
    """Aggregate over the rows of all bins."""
    return F.sum(kl_term(p, q))


def js_divergence(p: Column, q: Column) -> Column:
    """Aggregate over the rows of all bins; natural logarithm, so at most ln 2."""
    m = (p + q) / 2
    return (F.sum(kl_term(p, m)) + F.sum(kl_term(q, m))) / 2


def compare_histograms(
    left: DataFrame, right: DataFrame, group: Sequence[str] = (), right_group: Sequence[str] = ()
) -> DataFrame:
    """Divergences between probability histograms that share ``bin`` (and ``right_group``)."""
    keys = [*right_group, "bin"]
    pairs = join_on(left, right.withColumnRenamed("p", "q"), keys)
    p, q = F.col("p"), F.col("q")
    return pairs.groupBy(*group).agg(
        kl_divergence(p, q).alias("kl"),
        js_divergence(p, q).alias("js"),
    )
