"""Vector columns: which vectors count, and how a task reads them as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """The array is there and holds finite numbers only (never null; true for an empty one)."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def nonzero(v: Column) -> Column:
    return F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row places, matrix) for each length of vectors in a list column without nulls."""
    starts = column.offsets.to_numpy()
    lengths = np.diff(starts)
    values = column.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        places = np.flatnonzero(lengths == dim)
        yield places, values[starts[places][:, None] + np.arange(dim)]


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square over- or underflows."""
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]
