"""As-of look-up between two streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def asof_stream(
    left: DataFrame, right: DataFrame, key: str, time: str, value: str, max_age: float = 1.0, delay: str = "10 seconds"
) -> DataFrame:
    """``(key, time, value)``: for each left row the newest right ``value`` at or before its time, null if older than ``max_age`` seconds.

    Both streams carry a timestamp ``time`` and may be late by ``delay``. Rows meet in ranges of time
    as long as ``max_age``: a right row goes to its own range and the next one, so the state is spread
    and either side is kept no longer than the interval asks. The rows of a range are kept as two lists
    and looked up once, when the watermark has passed it, so the work grows with the rows and not with
    their pairs. ``key`` identifies a left row. Of right rows of equal time the largest value
    counts, as in ``asof_latest``.
    """
    micros = int(max_age * 1e6)
    own, at = F.col(key).alias("_k"), F.col(time).alias("_t")
    lefts = left.select(F.col(time).alias("_w"), F.struct(at, own).alias("_l"), F.lit(None).alias("_r")).withWatermark("_w", delay)
    ages = F.array(F.col(time), F.col(time) + F.expr(f"INTERVAL {micros} MICROSECONDS"))
    rights = right.select(F.explode(ages).alias("_w"), F.lit(None).alias("_l"), F.struct(at, F.col(value).alias("_v")).alias("_r"))
    # The copy in the next range is that much ahead of the stream.
    both = lefts.unionByName(rights.withWatermark("_w", f"{delay} {micros} microseconds"))
    met = both.groupBy(F.window("_w", f"{micros} microseconds")).agg(
        F.collect_set("_l").alias("_l"), F.sort_array(F.collect_set("_r")).alias("_r")
    )
    kinds = [StructField(key, left.schema[key].dataType), StructField(time, left.schema[time].dataType), StructField(value, right.schema[value].dataType)]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, known in zip(batch.column(0), batch.column(1), strict=True):
                (t, k), (s, v) = (side.values.flatten() for side in (asked, known))
                if len(t):
                    yield pa.RecordBatch.from_arrays([k, t, _newest(t, s, v, micros)], [key, time, value])

    return met.where(F.size("_l") > 0).select("_l", "_r").mapInArrow(look_up, StructType(kinds))


def _newest(t: pa.Array, s: pa.Array, v: pa.Array, micros: int) -> pa.Array:
    """For each time of ``t`` the value of the last of the sorted times ``s`` up to it, null if that is too old."""
    at, known = (np.asarray(x.cast(pa.int64())) for x in (t, s))
    spot = np.searchsorted(known, at, side="right") - 1
    seen = spot >= 0
    if len(known):
        seen &= at - known[spot] <= micros
    return v.take(pa.array(np.where(seen, spot, 0), mask=~seen))
