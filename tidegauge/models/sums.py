"""Sums of small matrices over a distributed table."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FEW_PARTS = 64  # partial sums that the driver adds itself


def matrix_sums(df: DataFrame, of: Callable[[pa.RecordBatch], Iterable[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """Flat sums by key of what ``of`` makes of the Arrow batches of ``df``.

    Every task adds up its own; if there are many tasks their sums are added in tasks once more,
    a key at a time, before the few that are left reach the driver.
    """
    schema = pa.schema([("key", pa.int64()), ("part", pa.binary())])

    def rows(sums: dict[int, np.ndarray]):
        if sums:
            cells = [pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, schema=schema)

    def task(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, got in of(batch):
                flat = np.ascontiguousarray(got, np.float64).ravel()
                sums[key] = sums[key] + flat if key in sums else flat
        yield from rows(sums)

    def again(key, table):
        total = sum(np.frombuffer(x) for x in table["part"].to_pylist())
        return pa.table({"key": [key[0].as_py()], "part": [total.tobytes()]}, schema=schema)

    parts = df.mapInArrow(task, "key long, part binary")
    if df.rdd.getNumPartitions() > FEW_PARTS:
        parts = parts.groupBy("key").applyInArrow(again, "key long, part binary")
    out: dict[int, np.ndarray] = {}
    for r in parts.collect():
        got = np.frombuffer(r.part)
        out[r.key] = out[r.key] + got if r.key in out else got
    return out


def array_matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles, null entries as NaN."""
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
