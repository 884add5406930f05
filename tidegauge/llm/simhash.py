"""Near-duplicates by SimHash fingerprints, with pigeonring filtering of candidate pairs.

A fingerprint is cut into ``d + 1`` segments on a ring. If two differ in ``d`` bits at most, there
is a segment from which, going round, the first ``l`` segments together differ in no more than
``l * d / (d + 1)`` bits for every ``l`` (pigeonring): none in the first, one in the first two and
so on. Fingerprints meet on an equal first segment; pairs whose chain breaks its budget are
dropped before the full Hamming check. Equal fingerprints are one node from the start.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import col, cut_lineage, map_texts
from tidegauge.llm.components import star_components

BITS = 64
SEED = 42
GROUP_ROWS = 128  # fingerprints with an equal segment that are compared pair by pair
_FP = T.StructType([T.StructField("fp", T.LongType())])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of a text: repeats of a shingle count each time."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    ends = starts[shingle:] if len(words) >= shingle else [len(joined) + 1]
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(BITS, np.int64), len(ends)
    for at in range(0, n, 1 << 17):
        part = [digest(joined[a : b - 1], SEED) for a, b in zip(starts[at:], ends[at : at + (1 << 17)])]  # noqa: B905
        bits = np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, keep: Sequence[str], text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``keep`` and the fingerprint ``fp`` of every row."""
    return map_texts(docs, text_col, keep, _FP, lambda: lambda texts: [[fingerprint(t, shingle) for t in texts]])


def hexed(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _segments(d: int) -> list[tuple[int, int]]:
    """(mask, bits) of the d + 1 segments, as signed masks."""
    cuts = [BITS * i // (d + 1) for i in range(d + 2)]
    masks = [sum(1 << b for b in range(a, z)) for a, z in zip(cuts, cuts[1:], strict=False)]
    return [(_signed(m), z - a) for m, a, z in zip(masks, cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def _viable(d: int, start: int):
    """The chain from a segment on keeps its proportional budgets; the last one is the full check."""
    masks = [m for m, _ in _segments(d)]
    differ = F.col("x").bitwiseXOR(F.col("y"))
    ring = [masks[(start + i) % (d + 1)] for i in range(d + 1)]
    covered = list(accumulate(ring, lambda a, b: a | b))
    checks = [F.bit_count(differ.bitwiseAND(F.lit(m))) <= i for i, m in enumerate(covered)]
    return reduce(lambda a, b: a & b, checks)


def hamming_links(fps: DataFrame, d: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints with ``d`` or fewer differing bits.

    Groups of fingerprints with an equal segment are compared pair by pair up to ``group_rows``.
    In a larger one every fingerprint is written at all points within half the distance that keep
    the segment; those that meet at a point are close, and are linked to the smallest there. That
    finds the same links up to connection in time linear in the group.
    """
    if not 0 <= d <= 6:
        raise ValueError("distance from 0 to 6")
    starts = list(range(d + 1))
    segments = _segments(d)
    keyed = fps.select(
        F.col("fp"),
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m, _ in segments])).alias("start", "segment"),
    )
    size = keyed.groupBy("start", "segment").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut_lineage(keyed.join(size, ["start", "segment"]))

    few = met.where(F.col("n") <= group_rows).drop("n")
    pairs = few.withColumnRenamed("fp", "x").join(few.withColumnRenamed("fp", "y"), ["start", "segment"])
    chain = reduce(lambda a, b: a | b, [(F.col("start") == s) & _viable(d, s) for s in starts])
    close = pairs.where((F.col("x") < F.col("y")) & chain).select(F.col("x").alias("a"), F.col("y").alias("b"))

    many = met.where(F.col("n") > group_rows)
    near, far = d // 2, (d + 1) // 2

    def points(start: int, radius: int):
        free = [b for b in range(BITS) if not (segments[start][0] >> b) & 1]
        flips = [_signed(sum(1 << b for b in some)) for r in range(radius + 1) for some in combinations(free, r)]
        return F.array(*[F.lit(f) for f in flips])

    def meet(radius: int, name: str):
        spots = reduce(
            lambda rest, s: F.when(F.col("start") == s, points(s, radius)).otherwise(rest), starts, F.array(F.lit(0))
        )
        out = many.select("start", F.col("fp").alias(name), F.explode(spots).alias("flip"))
        return out.select("start", F.col(name).bitwiseXOR(F.col("flip").cast("bigint")).alias("point"), name)

    anchors = meet(near, "fp").groupBy("start", "point").agg(F.min("fp").alias("b"))
    hot = meet(far, "a").join(anchors, ["start", "point"]).where("a <> b").select("a", "b")
    return close.unionByName(hot)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_distance: int = 2,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(id, fingerprint, component_id, component_fp) of every row.

    Words are lower-cased in A-Z and cut at ASCII white space. A text of fewer words than a shingle
    has one shingle, its words; without words (null, empty) the fingerprint is zero and links like
    any other. ``component_id`` is the smallest id of the rows linked directly or through others,
    null if none has an id; ``component_fp`` is one of the component's fingerprints. Repeated rows and rows with a null id are kept; an empty table gives an
    empty one; other columns, whatever their names, are ignored.
    """
    own = docs.select(col(id_col).alias("doc"), col(text_col).alias("text"))
    rows = cut_lineage(fingerprints(own, ["doc"], "text", shingle))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("doc").alias("least")))
    labels = star_components(hamming_links(nodes.select("fp"), max_distance, group_rows))
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "label", F.coalesce("label", "fp")
    )
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_fp = named.join(ids, "label").select("fp", "component_id", "label")
    return rows.join(of_fp, "fp").select(
        F.col("doc").alias(id_col),
        hexed("fp").alias("fingerprint"),
        "component_id",
        hexed("label").alias("component_fp"),
    )
