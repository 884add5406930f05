"""Record streams: sources, decoding, end-of-stream tracking, replay safety and rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.scalars import is_sentinel
from tidegauge.sources.replay import decode_records

# Layout of the built-in topic source with headers; file sources use the same.
TOPIC_SCHEMA = (
    "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, "
    "headers array<struct<key string, value binary>>"
)


def topic_options(
    servers: str, topic: str, starting: str = "latest", max_offsets: int | None = None, **extra: str
) -> dict[str, str]:
    """Options of the partitioned topic source. New queries start at the end by default."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        "includeHeaders": "true",
        **extra,
    }
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def read_topic(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """Stream of a partitioned topic (needs the connector package on the cluster)."""
    return spark.readStream.format("kafka").options(**topic_options(servers, topic, **options)).load()


def read_record_files(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The same layout from Parquet files that arrive in a folder."""
    return (
        spark.readStream.schema(TOPIC_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def decode_stream(
    raw: DataFrame, features: Sequence[str], default_label: float | None = None, run_id: str | None = None, **markers
) -> DataFrame:
    """Records of a topic: sentinels and values that are not JSON are dropped."""
    flagged = raw.filter(~is_sentinel("value", "headers", run_id, **markers))
    return decode_records(flagged, features, "value", default_label)


def partition_progress(raw: DataFrame, run_id: str | None = None, **markers) -> DataFrame:
    """Per partition: records, and whether its end marker was seen."""
    mark = is_sentinel("value", "headers", run_id, **markers)
    return raw.groupBy("partition").agg(
        F.count_if(~mark).alias("records"),
        F.count_if(mark).alias("sentinels"),
        F.bool_or(mark).alias("done"),
    )


def stream_done(progress: DataFrame, partitions: int, by: str = "partition") -> DataFrame:
    """Whether the stream has ended: a marker from each partition, or as many markers
    (``by="count"``) as there are partitions."""
    if by == "count":
        return progress.agg((F.coalesce(F.sum("sentinels"), F.lit(0)) >= partitions).alias("done"))
    return progress.agg((F.count_if("done") >= partitions).alias("done"))


def deduplicate(raw: DataFrame, delay: str = "10 minutes", time: str = "timestamp") -> DataFrame:
    """Drop re-delivered records within the watermark."""
    return raw.withWatermark(time, delay).dropDuplicatesWithinWatermark(["partition", "offset"])


def round_trip(records: DataFrame, sent: str = "send_ts", received: str = "timestamp") -> DataFrame:
    """Milliseconds from sending to receiving, null without a send time."""
    micros = F.timestamp_diff("MICROSECOND", F.col(sent), F.col(received))
    return records.withColumn("rtt_ms", micros / 1000.0)


def rate_rollup(
    scored: DataFrame, time: str = "timestamp", width: str = "1 minute", delay: str = "10 minutes"
) -> DataFrame:
    """Throughput and hit rate per stage in tumbling event-time windows.

    Takes scored records with an integer column ``hit``.
    """
    return (
        scored.withWatermark(time, delay)
        .groupBy(F.window(time, width), "stage")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.avg("hit").alias("hit_rate"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "stage", "n", "hits", "hit_rate")
    )
