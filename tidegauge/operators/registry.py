"""Append-only model registry: versions, the latest pointer and the promotion gate.

A registry is a table ``(ts, model_key, metrics_key, content, metrics)`` where ``metrics`` is a
string map; nothing is ever updated in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalars import accuracy_keys, pick_metric
from tidegauge.operators.ordering import MAX_ROWS_PER_TASK, join_on, ordered_rows

# Fixed value: smallest gain, in percentage points, that replaces the current model.
GAIN_THRESHOLD_PP = 0.01


def latest_version(registry: DataFrame, keys: Sequence[str] = (), version: str = "ts") -> DataFrame:
    """The newest version of each model line, a partial aggregate."""
    newest = F.max_by(F.struct(*registry.columns), F.col(version))
    return registry.groupBy(*keys).agg(newest.alias("_v")).select("_v.*")


def with_metrics(pointers: DataFrame, metrics: DataFrame, key: str = "metrics_key") -> DataFrame:
    """Pointers joined to the metrics they name; pointers without metrics are kept."""
    return join_on(pointers, metrics, [key], "left")


def latest_pointer(primary: DataFrame, fallback: DataFrame, version: str = "ts") -> DataFrame:
    """Newest entry of ``primary``, else of ``fallback`` (the two pointer files of a model)."""
    both = primary.withColumn("_rank", F.lit(0)).unionByName(
        fallback.withColumn("_rank", F.lit(1)), allowMissingColumns=True
    )
    best = F.max_by(F.struct(*primary.columns), F.struct(-F.col("_rank"), F.col(version)))
    return both.agg(best.alias("_v")).select("_v.*").filter(F.col(primary.columns[0]).isNotNull())


def promotion_gate(
    versions: DataFrame,
    keys: Sequence[str] = (),
    version: str = "ts",
    content: str = "content",
    threshold: float = 0.25,
    min_gain: float = GAIN_THRESHOLD_PP,
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Decide for every version whether it may replace the one before it.

    Content equal to the previous version is never loaded again. Without a thresholded
    accuracy the version is promoted; otherwise its gain over the baseline must reach
    ``min_gain``.
    """
    ordered = ordered_rows(versions, [version], keys, before=1, max_rows=max_rows)
    seen = ordered.finish(
        ordered.rows.withColumn("_previous", F.lag(F.md5(content)).over(ordered.window))
    )
    m = F.col("metrics")
    gain = pick_metric(m, accuracy_keys(threshold)) - pick_metric(
        m, accuracy_keys(threshold, "baseline_")
    )
    judged = m[f"acc@{threshold:g}"].isNotNull() | m["acc@0.15"].isNotNull()
    changed = ~F.md5(content).eqNullSafe(F.col("_previous"))
    return seen.withColumns(
        {"gain_pp": gain, "changed": changed, "promoted": changed & (~judged | (gain >= min_gain))}
    ).drop("_previous", "row_idx")


def publish_version(registry_path: str, entry: DataFrame) -> None:
    """Append one or more versions to the registry table at ``registry_path``."""
    entry.write.mode("append").parquet(registry_path)
