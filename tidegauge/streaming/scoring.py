"""Online scoring with a baseline and a current model that is swapped between micro-batches."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.scalars import accuracy_keys, relative_error
from tidegauge.models.evaluate import scaled_array, score_pair
from tidegauge.models.network import Network
from tidegauge.operators.registry import GAIN_THRESHOLD_PP, latest_version
from tidegauge.operators.stats import StandardScaler

TOTALS_SCHEMA = (
    "batch_id bigint, n bigint, hits bigint, hit_rate double, correct bigint, cum_correct bigint, "
    "cum_total bigint, cum_acc double, model_key string, content string"
)


def _metric(metrics: dict, keys: list[str]) -> float:
    return next((float(metrics[k]) for k in keys if k in metrics), 0.0)


def may_promote(metrics: dict, threshold: float, min_gain: float) -> bool:
    """Whether a version with changed content may replace the current model."""
    judged = f"acc@{threshold:g}" in metrics or "acc@0.15" in metrics
    gain = _metric(metrics, accuracy_keys(threshold)) - _metric(metrics, accuracy_keys(threshold, "baseline_"))
    return not judged or gain >= min_gain


@dataclass
class DualScorer:
    """``foreachBatch`` function: scores a batch of decoded records with both models.

    Before a batch the newest registry entry is considered once. Everything a later batch
    needs (totals, current model) is read from the totals table of the batch before, so a
    restarted or repeated batch gives the same result.
    """

    baseline: Network
    scaler: StandardScaler
    registry_path: str
    out_path: str
    threshold: float = 0.25
    hit_threshold: float = 0.15
    min_gain: float = GAIN_THRESHOLD_PP
    keep: list[str] = field(default_factory=lambda: ["send_ts", "stage"])

    def _read(self, spark: SparkSession, path: str) -> DataFrame | None:
        """The table at a path, or none if nothing has been written there yet."""
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return spark.read.parquet(path) if system.exists(place) else None

    def previous(self, spark: SparkSession, batch_id: int):
        """Totals of the batch before; only its own folder is read."""
        totals = self._read(spark, f"{self.out_path}/totals/batch_id={batch_id - 1}")
        return None if totals is None else totals.first()

    def current_model(self, spark: SparkSession, previous) -> tuple[str, str]:
        """Key and content of the model to use for this batch."""
        key = previous["model_key"] if previous else "baseline"
        content = previous["content"] if previous else self.baseline.to_json()
        registry = self._read(spark, self.registry_path)
        if registry is None:
            return key, content
        newest = latest_version(registry).first()
        if newest["content"] == content or not may_promote(newest["metrics"], self.threshold, self.min_gain):
            return key, content
        return newest["model_key"], newest["content"]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        previous = self.previous(spark, batch_id)
        key, content = self.current_model(spark, previous)
        scaled = batch.withColumn("_xs", scaled_array("x", self.scaler))
        scored = score_pair(scaled, "_xs", self.baseline, Network.from_json(content))
        error = relative_error("pred_adj", "label")
        trace = scored.select(
            *self.keep, F.col("label").alias("truth"), "pred_orig", "pred_adj",
            F.when(error <= self.hit_threshold, 1).otherwise(0).alias("hit"),
            F.when(error <= self.threshold, 1).otherwise(0).alias("correct"),
        ).persist()
        trace.write.mode("overwrite").parquet(f"{self.out_path}/trace/batch_id={batch_id}")
        sums = trace.agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"),
            F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"),
        ).first()
        trace.unpersist()
        cum_correct = sums.correct + (previous["cum_correct"] if previous else 0)
        cum_total = sums.n + (previous["cum_total"] if previous else 0)
        row = (
            batch_id, sums.n, sums.hits, sums.hits / max(1, sums.n), sums.correct,
            cum_correct, cum_total, cum_correct / max(1, cum_total), key, content,
        )
        spark.createDataFrame([row], TOTALS_SCHEMA).drop("batch_id").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{self.out_path}/totals/batch_id={batch_id}")


def start_scoring(records: DataFrame, scorer: DualScorer, checkpoint: str, **trigger):
    return (
        records.writeStream.foreachBatch(scorer)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
