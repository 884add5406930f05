"""Scenario tables out of experiment tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.ordering import join_facts
from tidegauge.sources.text import natural_position


def merge_scenario(table: DataFrame, scenario: str) -> DataFrame:
    """Rows of a scenario with ``exp_order``, the natural-sort place of their experiment.

    Order by ``exp_order, row_idx`` for the concatenation of the experiment tables.
    """
    rows = table.filter(F.col("scenario") == scenario)
    places = natural_position(rows, "exp").withColumnRenamed("position", "exp_order")
    return join_facts(rows, places, ["exp"])


def union_tables(parts: Mapping[str, DataFrame], key: str = "part") -> DataFrame:
    """Union by name of tables with different columns, tagged with their name."""
    merged = None
    for name, df in parts.items():
        tagged = df.withColumn(key, F.lit(name))
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    if merged is None:
        raise ValueError("no tables to merge")
    return merged
