"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.session import checkpoint_dir, cut_lineage

__all__ = ["col", "checkpoint_dir", "cut_lineage", "drawn", "held_out", "map_texts", "others", "same", "slices", "with_facts"]

TEXT = "__text"


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, taken: Sequence[str]) -> list[str]:
    """Columns of ``df`` whose names do not clash with ``taken`` (Spark ignores case)."""
    low = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in low]


BROADCAST_ROWS = 100_000  # rows of narrow facts that every task may hold


def same(left: str, right: str) -> Column:
    return col(left).eqNullSafe(col(right))


def with_facts(df: DataFrame, facts: DataFrame, key: str, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join one narrow row a key (null is a key) to the rows of ``df``.

    The facts are counted, so cut their lineage before. Up to ``rows`` of them travel to the
    tasks and a hot key moves nothing; more are joined by shuffle, where adaptive execution
    splits hot keys.
    """
    right = facts.withColumnRenamed(key, "__key")
    few = facts.limit(rows + 1).count() <= rows
    return df.join(F.broadcast(right) if few else right, same(key, "__key"), how).drop("__key")


def held_out(id_col: str) -> Column:
    """Evaluation rows: the CRC-32 of the id's text is divisible by five (null id: false)."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def drawn(id_col: str, wanted: int, rows: int, seed: int = 0) -> Column:
    """About ``wanted`` of ``rows`` rows by a hash of their id; all if there are no more."""
    if rows <= wanted:
        return F.lit(True)
    # The whole hash is compared, so that a small share of very many rows is not rounded to none.
    return F.xxhash64(col(id_col), F.lit(seed)) < F.lit((wanted << 64) // rows - (1 << 63))


def slices(texts: Sequence[str | None], limit: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about ``limit`` characters, null read as empty, with their start."""
    start, size, run = 0, 0, []
    for i, text in enumerate(texts):
        if run and size + len(text or "") > limit:
            yield start, run
            start, size, run = i, 0, []
        run.append(text or "")
        size += len(text or "")
    if run:
        yield start, run


def map_texts(
    df: DataFrame,
    text_col: str,
    keep: Sequence[str],
    added: T.StructType,
    make: Callable[[], Callable[[list[str | None]], list[list]]],
) -> DataFrame:
    """Append columns computed from a text column, in Arrow batches, without a shuffle.

    ``make`` runs once per task and returns a function from texts to one list per added
    column. Kept columns pass through; those that clash with an added one are replaced.
    """
    kept = [c for c in keep if c.lower() not in {f.name.lower() for f in added.fields}]
    source = df.select(*[col(c) for c in kept], col(text_col).cast("string").alias(TEXT))
    schema = T.StructType([source.schema[c] for c in kept] + list(added.fields))
    names, width = [f.name for f in schema.fields], len(kept)
    kinds = [_arrow(f.dataType) for f in added.fields]

    def run(batches):
        work = make()
        for batch in batches:
            if batch.num_rows:
                made = work(batch.column(width).to_pylist())
                arrays = [pa.array(v, kind) for v, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(width)] + arrays, names)

    return source.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
