"""Feature frames that several queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.scalars import first_number
from tidegauge.plans.catalog import table

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
EVENT_FEATURES = ["value", "hour", "k"]
LINE_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]

NUMBER_SQL = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
EVENTS_SQL = f"""ev AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(hour(ts) AS DOUBLE) AS hour,
         TRY_CAST(regexp_extract(props, '{NUMBER_SQL}', 0) AS DOUBLE) AS k
  FROM events)"""
PAIRS_SQL = """pairs AS (
  SELECT l.*, l_extendedprice AS y, l_quantity * p_retailprice AS p
  FROM lineitem l JOIN part ON l_partkey = p_partkey)"""
LINE_ORDER_SQL = ", ".join(LINE_ORDER)


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.hour("ts").cast("double").alias("hour"),
        first_number("props").alias("k"),
    )


def price_pairs(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Line items with the truth ``y`` and the prediction ``p`` from the catalogue price."""
    lines = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        *extra,
        F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * F.col("p_retailprice")).alias("p"),
    )
