"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import cut_lineage


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def star_components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node that has an edge; the label is the smallest node it reaches.

    ``edges`` has the bigint columns ``a`` and ``b`` in any direction; loops and repeats do not
    matter. Each round links neighbours to the smallest one near them and is checkpointed, so a
    lost executor costs one round. The number of rounds grows with the logarithm of the nodes.
    """
    edges = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), "m"
        )
        joined = large.join(floor, "a").select("a", "m")
        edges = cut_lineage(small.union(joined).select("a", F.col("m").alias("b")).where("a <> b").distinct())
        before, state = state, _state(edges)
        if before == state:
            break
    stars = edges.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
