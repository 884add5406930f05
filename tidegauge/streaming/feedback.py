"""Drift, retraining, publishing and scoring as one loop of streams.

The monitor's events of a micro-batch start a retrain on the windows that drifted. Its models are
published as one version of a commit log, and a completion row for each key goes into a folder that
is a source of the monitor, which ends the key's lock. The scoring stream takes the newest version
of each key at the start of a micro-batch. All of it is named after the batch, so a batch that is
repeated after a failure leaves the same state.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import commits
from tidegauge.streaming.monitor import MonitorConfig, monitor_stream, snapshot_rows

MODEL_SCHEMA = "key string, window_id bigint, tier string, n bigint, weights array<double>, intercept double"
DONE_SCHEMA = "key string, at double"


def fit_windows(rows: DataFrame) -> DataFrame:
    """A least-squares model of every (key, window_id, tier) from rows with x and label; a window is bounded."""

    def solve(key, table):
        x = np.array(table["x"].to_pylist(), float)
        y = np.array(table["label"].to_pylist(), float)
        mean = x.mean(axis=0)
        w = np.linalg.lstsq(x - mean, y - y.mean(), rcond=1e-9)[0]
        cells = [[k.as_py()] for k in key] + [[len(y)], [w.tolist()], [float(y.mean() - mean @ w)]]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.float64()), pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=[f.split()[0] for f in MODEL_SCHEMA.split(", ")])

    return rows.groupBy("key", "window_id", "tier").applyInArrow(solve, MODEL_SCHEMA)


def newest_models(spark: SparkSession, registry: str) -> DataFrame:
    """The newest model of every key with its version."""
    rows = commits.read_versions(spark, registry, MODEL_SCHEMA)
    best = F.max_by(F.struct("weights", "intercept", "version"), "version").alias("m")
    return rows.groupBy("key").agg(best).select("key", "m.*")


class FeedbackLoop:
    """One folder with the events, models, completions and scores of a loop over keyed records ``(key, x, label)``."""

    def __init__(self, spark: SparkSession, folder: str, config: MonitorConfig):
        self.spark, self.folder, self.config = spark, folder, config
        self.registry = f"{folder}/registry"
        # The completions are a source from the start, so their folder has to be there.
        spark.createDataFrame([], DONE_SCHEMA).write.mode("ignore").parquet(f"{folder}/done/batch=none")

    def on_events(self, batch: DataFrame, batch_id: int) -> None:
        """Save the events, retrain on the windows that drifted, publish, tell that it is done."""
        batch.persist()
        batch.drop("rows").write.mode("overwrite").parquet(f"{self.folder}/events/batch_id={batch_id}")
        drifts = batch.where("event = 'drift'")
        if not drifts.isEmpty():
            models = fit_windows(snapshot_rows(batch, "key"))
            commits.publish(models, self.registry, f"drift-{batch_id}")
            drifts.groupBy("key").agg(F.max("at").alias("at")).write.mode("overwrite").parquet(f"{self.folder}/done/batch={batch_id}")
        batch.unpersist()

    def monitor(self, records: DataFrame, time: Column, order: list[Column], **trigger):
        done = self.spark.readStream.schema(DONE_SCHEMA).parquet(f"{self.folder}/done/*")
        events = monitor_stream(records, "key", time, order, self.config, done)
        return self._start(events, self.on_events, "monitor", trigger)

    def on_records(self, batch: DataFrame, batch_id: int) -> None:
        """Score the records of a micro-batch with the newest models; keys without one have no prediction."""
        models = newest_models(self.spark, self.registry).select(F.col("key").alias("_key"), "weights", "intercept", "version")
        scored = batch.join(F.broadcast(models), F.col("key") == F.col("_key"), "left").drop("_key")
        terms = F.zip_with("x", "weights", lambda a, b: a * b)
        prediction = F.aggregate(terms, F.col("intercept"), lambda s, t: s + t)
        scored = scored.select("key", "label", prediction.alias("prediction"), F.coalesce("version", F.lit(0)).alias("version"))
        scored.write.mode("overwrite").parquet(f"{self.folder}/trace/batch_id={batch_id}")

    def score(self, records: DataFrame, **trigger):
        return self._start(records, self.on_records, "score", trigger)

    def _start(self, stream: DataFrame, each, name: str, trigger: dict):
        return (
            stream.writeStream.foreachBatch(each)
            .option("checkpointLocation", f"{self.folder}/checkpoint-{name}")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
