"""Row order as data.

Many telemetry operators identify a row by its position in a series. A series (or the whole
table) can be far larger than one task should hold, so nothing here sorts an unbounded group
in one task. The largest group is counted first:

* up to ``max_rows`` a plain window partitioned by the group is used;
* beyond it the rows are range-partitioned by (group, order), numbered inside their partition,
  and shifted by the sizes of the partitions before them. Frames and running values are then
  evaluated in blocks of consecutive rows, with neighbouring rows copied into a block where a
  frame reaches over its edge.

Both ways give the same result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidegauge.session import cut_lineage

MAX_ROWS_PER_TASK = 2_000_000
MAX_TOP_ROWS = 5_000  # each input partition sends so many rows to one task
MAX_FACT_ROWS = 100_000  # one-row-per-group results that every task may hold
FACT_SALTS = 16  # parts of a group where there are more

_POSITION_BITS = 33  # monotonically_increasing_id keeps the partition above these bits
_HASH_BITS, _RANGE_BITS = 64, 16


def largest_group(df: DataFrame, group: Sequence[str] = ()) -> int:
    """Row count of the largest group (of the table, without a group)."""
    if not group:
        return df.count()
    return df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0


def join_on(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", hint: str | None = None
) -> DataFrame:
    """Equi-join that also matches null keys; keeps the key columns of the left side.

    Keys that cannot be null on one side are compared plainly, which keeps an existing
    partitioning by these columns usable.
    """
    solid = {f.name for df in (left, right) for f in df.schema.fields if not f.nullable}
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    if hint:
        renamed = renamed.hint(hint)
    on = reduce(
        lambda a, b: a & b,
        [
            F.col(k) == F.col(f"_r_{k}") if k in solid else F.col(k).eqNullSafe(F.col(f"_r_{k}"))
            for k in keys
        ],
    )
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def join_facts(
    left: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "inner", rows: int = MAX_FACT_ROWS
) -> DataFrame:
    """``join_on`` for one narrow row per key on the right and hot keys on the left.

    The facts are materialised and counted. Up to ``rows`` of them travel to the tasks, so the
    left side stays where it is; with more every key is split into salted parts.
    """
    facts = cut_lineage(facts)
    if facts.limit(rows + 1).count() <= rows:
        return join_on(left, facts, keys, how, hint="broadcast")
    # Any part will do, so a recomputed row may land in another one.
    salted = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(FACT_SALTS)).cast("int"))
    parts = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(FACT_SALTS - 1))))
    return join_on(salted, parts, [*keys, "_salt"], how).drop("_salt")


def row_index(
    df: DataFrame,
    order: Sequence[str],
    group: Sequence[str] = (),
    name: str = "row_idx",
    max_rows: int = MAX_ROWS_PER_TASK,
    largest: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Append the 0-based position of each row in its group.

    ``order`` must be a total order inside a group. ``largest`` is the known size of the
    largest group; without it one aggregation finds it out. Beyond ``max_rows`` the whole table
    is cut into ranges of about that many rows, however its groups are sized.
    """
    total = None
    if largest is None:
        largest, total = _sizes(df, group)
    if largest <= max_rows:
        window = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(window) - 1).cast("bigint"))
    if partitions is None:
        configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        partitions = max(configured, -(-(df.count() if total is None else total) // max_rows))
    return _range_index(df, list(order), list(group), name, partitions)


def _sizes(df: DataFrame, group: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group and of the table."""
    if not group:
        n = df.count()
        return n, n
    counts = df.groupBy(*group).count().agg(F.max("count"), F.sum("count")).first()
    return counts[0] or 0, counts[1] or 0


def _range_index(
    df: DataFrame, order: list[str], group: list[str], name: str, n: int
) -> DataFrame:
    keys = group + order
    placed = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_seq", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_seq", _POSITION_BITS))
        .withColumn("_pos", F.col("_seq").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("_seq")
    )
    # Range bounds come from a sample; a second evaluation could place rows differently.
    placed = cut_lineage(placed)

    # One row per range partition, so both the sort and the broadcast are bounded by n.
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    numbered = placed.join(F.broadcast(offsets), "_part").withColumn(
        "_global", F.col("_pos") + F.col("_offset")
    )
    if not group:
        return numbered.withColumn(name, F.col("_global")).drop(
            "_part", "_pos", "_offset", "_global"
        )
    # A group begins where its partition first has it, unless it was open at the partition's edge:
    # only the first group of a partition can be, so the starts of those are at most n rows.
    edges = placed.groupBy("_part").agg(F.min_by(F.struct(*group), "_pos").alias("_first"))
    edges = edges.select("_first.*").distinct()
    opened = join_on(numbered, edges, group, "left_semi", hint="broadcast")
    starts = opened.groupBy(*group).agg(F.min("_global").alias("_start"))
    inside = F.min("_global").over(Window.partitionBy("_part", *group))
    return (
        join_on(numbered.withColumn("_inside", inside), starts, group, "left", hint="broadcast")
        .withColumn(name, F.col("_global") - F.coalesce("_start", "_inside"))
        .drop("_part", "_pos", "_offset", "_global", "_start", "_inside")
    )


@dataclass(frozen=True)
class OrderedRows:
    """Rows with ``row_idx`` and a window whose partitions are bounded.

    Evaluate frame functions of at most the requested reach over ``window``, then call
    ``finish`` to drop the copied rows and the helper columns.
    """

    rows: DataFrame
    window: WindowSpec
    group: list[str]
    order: list[str]
    blocked: bool
    block_keys: list[str] = field(default_factory=list)

    def finish(self, df: DataFrame) -> DataFrame:
        return df.filter("_owned").drop("_block", "_owned") if self.blocked else df


def ordered_rows(
    df: DataFrame,
    order: Sequence[str],
    group: Sequence[str] = (),
    before: int = 0,
    after: int = 0,
    max_rows: int = MAX_ROWS_PER_TASK,
    block_rows: int | None = None,
    largest: int | None = None,
) -> OrderedRows:
    """Prepare frames that reach ``before`` rows back and ``after`` rows ahead."""
    order, group = list(order), list(group)
    if largest is None:
        largest = largest_group(df, group)
    rows = row_index(df, order, group, max_rows=max_rows, largest=largest)
    if largest <= max_rows:
        window = Window.partitionBy(*group).orderBy(*order)
        return OrderedRows(rows, window, group, order, False, group)
    size = block_rows or max(max_rows, before + after + 1)
    return block_rows_of(rows, group, order, before, after, size)


def block_rows_of(
    rows: DataFrame, group: list[str], order: list[str], before: int, after: int, size: int
) -> OrderedRows:
    """Cut indexed rows into blocks of ``size`` and copy each block's neighbours into it."""
    idx = F.col("row_idx")
    home = F.floor(idx / size).cast("bigint")
    first = F.greatest(F.lit(0), F.floor((idx - after) / size)).cast("bigint")
    last = F.floor((idx + before) / size).cast("bigint")
    if before or after:
        blocked = rows.withColumn("_block", F.explode(F.sequence(first, last)))
    else:
        blocked = rows.withColumn("_block", home)
    blocked = blocked.withColumn("_owned", F.col("_block") == home)
    keys = group + ["_block"]
    window = Window.partitionBy(*keys).orderBy("row_idx")
    return OrderedRows(blocked, window, group, order, True, keys)


def running(
    df: DataFrame,
    order: Sequence[str],
    group: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    max_rows: int = MAX_ROWS_PER_TASK,
    largest: int | None = None,
) -> DataFrame:
    """Running sums and last non-null values from the start of the group to each row."""
    sums, lasts = dict(sums or {}), dict(lasts or {})
    prepared = df.select(
        "*",
        *[c.alias(f"_in_{n}") for n, c in {**sums, **lasts}.items()],
    )
    ordered = ordered_rows(prepared, order, group, max_rows=max_rows, largest=largest)
    upto = ordered.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inputs = [f"_in_{n}" for n in (*sums, *lasts)]

    if not ordered.blocked:
        return ordered.rows.select(
            *df.columns,
            "row_idx",
            *[F.sum(f"_in_{n}").over(upto).alias(n) for n in sums],
            *[F.last(f"_in_{n}", ignorenulls=True).over(upto).alias(n) for n in lasts],
        )

    keys = ordered.block_keys
    totals = ordered.rows.groupBy(*keys).agg(
        *[F.sum(f"_in_{n}").alias(f"_carry_{n}") for n in sums],
        *[
            F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), F.col("row_idx"))).alias(
                f"_carry_{n}"
            )
            for n in lasts
        ],
    )
    earlier = (
        Window.partitionBy(*ordered.group)
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.select(
        *keys,
        *[F.sum(f"_carry_{n}").over(earlier).alias(f"_carry_{n}") for n in sums],
        *[F.last(f"_carry_{n}", ignorenulls=True).over(earlier).alias(f"_carry_{n}") for n in lasts],
    )
    joined = join_on(ordered.rows, carried, keys)  # blocks are bounded, so no key is hot
    result = joined.select(
        *df.columns,
        "row_idx",
        *[
            F.coalesce(  # null until the first value
                F.sum(f"_in_{n}").over(upto) + F.col(f"_carry_{n}"),
                F.sum(f"_in_{n}").over(upto),
                F.col(f"_carry_{n}"),
            ).alias(n)
            for n in sums
        ],
        *[
            F.coalesce(F.last(f"_in_{n}", ignorenulls=True).over(upto), F.col(f"_carry_{n}")).alias(n)
            for n in lasts
        ],
    )
    return result.drop(*inputs)


def exact_quantiles(
    df: DataFrame,
    value: str,
    quantiles: Sequence[float],
    group: Sequence[str] = (),
    max_rows: int = MAX_ROWS_PER_TASK,
    largest: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles as rows ``(*group, q, value)``.

    Large groups are sorted across partitions and only the neighbouring order statistics are
    read; small ones use the built-in aggregate.
    """
    present = df.select(*group, F.col(value).cast("double").alias("_v")).filter(
        "_v is not null and not isnan(_v)"
    )
    qs = [float(q) for q in quantiles]
    if largest is None:
        largest = largest_group(present, group)
    if largest <= max_rows:
        found = present.groupBy(*group).agg(
            F.expr(f"percentile(_v, array({', '.join(f'{q!r}D' for q in qs)}))").alias("_p")
        )
        pairs = F.explode(F.arrays_zip(F.array(*[F.lit(q) for q in qs]).alias("q"), F.col("_p")))
        return found.select(*group, pairs.alias("_z")).select(
            *group, F.col("_z.q").alias("q"), F.col("_z._p").alias("value")
        )

    indexed = row_index(present, ["_v"], group, max_rows=max_rows, largest=largest)
    counts = indexed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    spot = (F.col("_n") - 1) * F.col("q")
    low = F.floor(spot).cast("bigint")
    weight = spot - low
    wanted = (
        counts.withColumn("q", F.explode(F.array(*[F.lit(q) for q in qs])))
        .withColumn(
            "_pair",
            F.explode(
                F.array(
                    F.struct(low.alias("row_idx"), (1 - weight).alias("_w")),
                    F.struct((low + 1).alias("row_idx"), weight.alias("_w")),
                )
            ),
        )
        .select(*group, "q", F.col("_pair.row_idx").alias("row_idx"), F.col("_pair._w").alias("_w"))
        .filter("_w > 0")
    )
    return (
        join_on(indexed, wanted, [*group, "row_idx"])
        .groupBy(*group, "q")
        .agg(F.sum(F.col("_v") * F.col("_w")).alias("value"))
    )


def head_rows(
    df: DataFrame, n: int, order: Sequence[str], max_rows: int = MAX_ROWS_PER_TASK
) -> DataFrame:
    """First ``n`` rows in the given order; all rows when ``n`` is not positive."""
    if n <= 0:
        return df
    if n <= MAX_TOP_ROWS:
        return df.orderBy(*order).limit(n)
    return row_index(df, order, max_rows=max_rows).filter(F.col("row_idx") < n).drop("row_idx")


def tail_rows(
    df: DataFrame, n: int, order: Sequence[str], max_rows: int = MAX_ROWS_PER_TASK
) -> DataFrame:
    """Last ``n`` rows in the given order; all rows when ``n`` is not positive."""
    if n <= 0:
        return df
    if n <= MAX_TOP_ROWS:
        return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
    total = df.count()
    indexed = row_index(df, order, max_rows=max_rows, largest=total)
    return indexed.filter(F.col("row_idx") >= total - n).drop("row_idx")


def chronological_split(
    df: DataFrame,
    fraction: float,
    order: Sequence[str],
    group: Sequence[str] = (),
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Mark the last ``max(1, int(n * fraction))`` rows of each group as validation rows."""
    indexed = row_index(df, order, group, max_rows=max_rows)
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    first_valid = F.col("_n") - F.greatest(F.lit(1), F.floor(F.col("_n") * fraction))
    if group:
        sized = join_facts(indexed, sizes, list(group))
    else:
        sized = indexed.withColumn("_n", sizes.scalar())
    return sized.withColumn("is_valid", F.col("row_idx") >= first_valid).drop("_n")


def hash_split(
    df: DataFrame,
    fraction: float,
    keys: Sequence[str],
    seed: int = 0,
    round_up: bool = True,
    hashes: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Seeded random split with an exact validation count, independent of partitioning.

    ``keys`` identify a row. The validation rows are those with the smallest key hashes; the
    cut is found by counting hash ranges, so no row moves. The validation share is rounded up,
    or down to at least 1. ``hashes`` are two bigint columns to use in place of hashes of the keys.
    """
    h, h2 = hashes or (F.xxhash64(F.lit(seed), *keys), F.xxhash64(*keys, F.lit(seed + 1)))
    hashes = df.select(h.alias("_h"), h2.alias("_h2"))
    inside, wanted = F.lit(True), None
    for shift in (_HASH_BITS - _RANGE_BITS, _HASH_BITS - 2 * _RANGE_BITS):
        bucket = F.shiftright("_h", shift)
        counts = hashes.filter(inside).groupBy(bucket.alias("b")).count()
        ranges = sorted(counts.collect())  # at most 2 ** _RANGE_BITS rows
        if wanted is None:
            total = sum(n for _, n in ranges)
            wanted = math.ceil(total * fraction) if round_up else max(1, int(total * fraction))
            if not total or wanted <= 0:
                return df.withColumn("is_valid", F.lit(False))
        for b, n in ranges:
            if n >= wanted:
                break
            wanted -= n
        inside = bucket == b
    # The last range holds about 2 ** -32 of the rows.
    cut = hashes.filter(inside).orderBy("_h", "_h2").limit(wanted).agg(F.max(F.struct("_h", "_h2"))).first()[0]
    below = (h < F.lit(cut[0])) | ((h == F.lit(cut[0])) & (h2 <= F.lit(cut[1])))
    return df.withColumn("is_valid", below)


def micro_batches(
    df: DataFrame,
    size: int,
    order: Sequence[str],
    group: Sequence[str] = (),
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Number consecutive batches of ``size`` rows; the last one holds the remainder."""
    indexed = row_index(df, order, group, max_rows=max_rows)
    return indexed.withColumn("batch_id", F.floor(F.col("row_idx") / size).cast("bigint"))


def occurrence_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    max_rows: int = MAX_ROWS_PER_TASK,
    name: str = "occurrence",
    largest: int | None = None,
) -> DataFrame:
    """0-based occurrence number of each row among the rows with the same keys."""
    return row_index(df, order, keys, name=name, max_rows=max_rows, largest=largest)


def rank_candidates(
    df: DataFrame,
    by: Sequence[str],
    k: int | None = None,
    group: Sequence[str] = (),
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Ascending rank with nulls last, optionally the first ``k`` of each group.

    A small ``k`` is pushed into every task, so only its first rows of each group travel;
    otherwise rows are numbered as in ``row_index``.
    """
    if k is not None and limits_per_task(df, k):
        ordering = [F.col(c).asc_nulls_last() for c in by]
        window = Window.partitionBy(*group).orderBy(*ordering)
        return df.withColumn("rank", F.row_number().over(window).cast("bigint")).filter(F.col("rank") <= k)
    flags = [f"_null_{i}" for i in range(len(by))]
    flagged = df.select("*", *[F.col(c).isNull().alias(f) for f, c in zip(flags, by)])
    order = [name for pair in zip(flags, by) for name in pair]
    indexed = row_index(flagged, order, group, name="rank", max_rows=max_rows)
    ranked = indexed.withColumn("rank", F.col("rank") + 1).drop(*flags)
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def limits_per_task(df: DataFrame, k: int) -> bool:
    """Whether the optimizer turns ``row_number() <= k`` into a limit before the shuffle."""
    threshold = df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    return k <= int(threshold)


def first_seen(df: DataFrame, value: str, rank: str) -> DataFrame:
    """Distinct values with the lowest rank at which each was seen."""
    return df.groupBy(value).agg(F.min(rank).alias(rank))
