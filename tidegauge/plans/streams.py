"""Streaming queries run to completion over the tables, and their batch counterparts."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.functions.scalars import epoch_micros, epoch_seconds, first_number
from tidegauge.models.network import Network
from tidegauge.operators.drift import HISTOGRAM_BINS, WINDOW_SIZE, WINDOW_STRIDE
from tidegauge.operators.registry import publish_version
from tidegauge.operators.stats import StandardScaler
from tidegauge.plans.catalog import query, table
from tidegauge.plans.frames import EVENTS_SQL, event_features
from tidegauge.plans.series import drift_sql, tier_sql
from tidegauge.session import checkpoint_dir
from tidegauge.streaming import asof, feedback, monitor, records, scoring, topic_log

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


PART_ROWS = 250_000  # of a type in a micro-batch


def events_parts(spark, sf_dir, folder, rows: int = PART_ROWS) -> str:
    """The events as files of which each is a micro-batch, in order of time; their folder.

    A part has up to about ``rows`` records of every type, which a task holds. Equal times are not
    split, and the parts of a type follow one another without a gap, so no type looks idle between two
    of its own. The files are written one after the other, as the source takes them by their age.
    """
    own = Window.partitionBy("event_type")
    spot = F.rank().over(own.orderBy(F.col("ts").asc_nulls_last()))
    cut = table(spark, sf_dir, "events").withColumn("_c", F.floor((spot - 1) / rows))
    parts = cut.withColumn("part", F.dense_rank().over(own.orderBy("_c"))).drop("_c")
    parts.repartition("part").write.partitionBy("part").parquet(f"{folder}/parts")
    last = spark.read.parquet(f"{folder}/parts").agg(F.max("part")).first()[0] or 0
    for i in range(1, last + 1):
        spark.read.parquet(f"{folder}/parts/part={i}").coalesce(1).write.parquet(f"{folder}/in/{i:06d}")
    return f"{folder}/in/*"


def events_stream(spark, parts):
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(parts)


def _run_folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"


def _records(events):
    """Events as decoded records with features (value, hour, k)."""
    x = F.array(F.col("value"), F.hour("ts").cast("double"), first_number("props"))
    return events.select(
        "event_id", "event_type", F.col("event_type").alias("stage"), F.col("ts").alias("send_ts"), x.alias("x"), F.col("value").alias("label")
    )


@query(
    "drift_stream",
    f"WITH {drift_sql(WINDOW_SIZE, WINDOW_STRIDE, HISTOGRAM_BINS)} SELECT event_type, window_id, round(js, 9) AS js, "
    f"{tier_sql(0.2, 0.5, 0.8)} AS tier FROM scored",
)
def drift_stream(spark, sf_dir):
    folder = _run_folder(spark)
    parts = events_parts(spark, sf_dir, folder)
    events = monitor.monitor_stream(
        _records(events_stream(spark, parts)), "event_type", epoch_seconds("send_ts"), [F.col("event_id")],
        monitor.MonitorConfig(lock_on_drift=False),
    )
    monitor.write_monitor(
        events, "event_type", f"{folder}/events", f"{folder}/windows", f"{folder}/checkpoint"
    ).awaitTermination()
    scored = spark.read.parquet(f"{folder}/events").filter("js is not null")
    return scored.select("event_type", "window_id", F.round("js", 9).alias("js"), "tier")


MONITOR_TIERS = (("B", 0.045), ("A", 0.035))
MONITOR_COOLDOWN = 3_600.0


def completions_stream(spark, parts):
    """(event_type, at): records whose k ends in 0 or 5 stand for the end of a retrain."""
    events = events_stream(spark, parts).where(F.pmod(first_number("props"), F.lit(5.0)) == 0)
    return events.select("event_type", epoch_seconds("ts").alias("at"))


@query("drift_lock_stream")
def drift_lock_stream(spark, sf_dir):
    """The monitor with its lock: drift waits for the end of a retrain, a cooldown follows, the baseline is renewed."""
    folder = _run_folder(spark)
    parts = events_parts(spark, sf_dir, folder)
    events = monitor.monitor_stream(
        _records(events_stream(spark, parts)), "event_type", epoch_seconds("send_ts"), [F.col("event_id")],
        monitor.MonitorConfig(tiers=MONITOR_TIERS, cooldown_seconds=MONITOR_COOLDOWN), completions_stream(spark, parts),
    )
    monitor.write_monitor(
        events, "event_type", f"{folder}/events", f"{folder}/windows", f"{folder}/checkpoint"
    ).awaitTermination()
    # What the snapshots of the triggering windows hold, read back.
    windows = spark.read.parquet(f"{folder}/windows").groupBy("event_type", "window_id").agg(
        F.count(F.lit(1)).alias("labelled"), F.round(F.avg("label"), 6).alias("mean_label")
    )
    told = spark.read.parquet(f"{folder}/events").join(windows, ["event_type", "window_id"], "left")
    return told.select("event_type", "event", "at", "row_no", "window_id", F.round("js", 9).alias("js"), "tier", "labelled", "mean_label")


@query("idle_stream", "SELECT event_type, 'idle_timeout' AS event, COUNT(*) AS row_no FROM events GROUP BY 1")
def idle_stream(spark, sf_dir):
    """Every series ends some time after its last record; its state goes."""
    folder = _run_folder(spark)
    parts = events_parts(spark, sf_dir, folder)
    events = monitor.monitor_stream(
        _records(events_stream(spark, parts)), "event_type", epoch_seconds("send_ts"), [F.col("event_id")],
        monitor.MonitorConfig(lock_on_drift=False, idle_seconds=1),
    )
    running = monitor.write_monitor(
        events, "event_type", f"{folder}/events", f"{folder}/windows", f"{folder}/checkpoint", processingTime="500 milliseconds"
    )
    monitor.await_idle(running, 120)
    return spark.read.parquet(f"{folder}/events").where("event = 'idle_timeout'").select("event_type", "event", "row_no")


# Networks without a hidden layer, which SQL can repeat: weights of value, hour and k, and a shift.
_FIRST, _SECOND = (20.0, 3.0, 1.0, 50.0), (28.0, 0.5, 0.0, 50.0)
_PRED_SQL = " + ".join(f"CASE WHEN b = 0 THEN {x} ELSE {y} END{f}" for x, y, f in zip(_FIRST, _SECOND, (" * v", " * h", " * k", "")))


@query(
    "online_scoring",
    f"""WITH {EVENTS_SQL},
    s AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(hour) AS mh, stddev_pop(hour) AS sh, avg(k) AS mk, stddev_pop(k) AS sk FROM ev),
    x AS (SELECT event_id % 3 AS b, value AS y, (value - mv) / sv AS v, (hour - mh) / sh AS h, (k - mk) / sk AS k FROM ev, s),
    e AS (SELECT b, abs({_PRED_SQL} - y) / greatest(abs(y), 1e-8) AS err FROM x),
    t AS (SELECT b AS batch_id, COUNT(*) AS n, COUNT(*) FILTER (err <= 0.15) AS hits, COUNT(*) FILTER (err <= 0.25) AS correct FROM e GROUP BY 1)
    SELECT batch_id :: BIGINT AS batch_id, n, hits, correct, (SUM(correct) OVER o) :: BIGINT AS cum_correct, (SUM(n) OVER o) :: BIGINT AS cum_total,
           round(hits / n, 9) AS hit_rate, round((SUM(correct) OVER o) / (SUM(n) OVER o), 9) AS cum_acc,
           CASE WHEN batch_id = 0 THEN 'baseline' ELSE 'model_2' END AS model_key
    FROM t WINDOW o AS (ORDER BY batch_id)""",
)
def online_scoring(spark, sf_dir):
    """Three micro-batches; versions published between them, of which only one may be loaded."""
    folder = _run_folder(spark)
    events = table(spark, sf_dir, "events")
    fitted = StandardScaler.fit(event_features(spark, sf_dir), ["value", "hour", "k"])
    first, second, worse = (Network((3, 1), "relu", np.array(p)) for p in (_FIRST, _SECOND, (0.0, 0.0, 0.0, 0.0)))
    published = {
        1: [(1, "model_1", worse, {"acc@0.25": "10", "baseline_acc@0.25": "50"}), (2, "model_2", second, {"acc@0.25": "90", "baseline_acc@0.25": "50"})],
        2: [(3, "model_3", worse, {"acc@0.25": "49", "baseline_acc@0.25": "50"})],
    }
    scorer = scoring.DualScorer(first, fitted, f"{folder}/registry", folder)
    for batch in range(3):
        for ts, key, net, metrics in published.get(batch, []):
            row = [(ts, key, f"metrics_{ts}", net.to_json(), metrics)]
            entry = "ts bigint, model_key string, metrics_key string, content string, metrics map<string,string>"
            publish_version(f"{folder}/registry", spark.createDataFrame(row, entry))
        events.where(F.col("event_id") % 3 == batch).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(EVENT_SCHEMA).parquet(f"{folder}/in")
        scoring.start_scoring(_records(stream), scorer, f"{folder}/checkpoint").awaitTermination()
    totals = spark.read.parquet(f"{folder}/totals").drop("content")
    return totals.withColumns({c: F.round(c, 9) for c in ("hit_rate", "cum_acc")}).withColumn("batch_id", F.col("batch_id").cast("bigint"))


@query(
    "partition_progress",
    """
    WITH last AS (SELECT user_id % 3 AS p, max(event_id) AS e FROM events GROUP BY 1)
    SELECT (user_id % 3) :: INTEGER AS partition, COUNT(*) FILTER (event_id <> e) AS records,
           COUNT(*) FILTER (event_id = e) AS sentinels, 1 AS done
    FROM events JOIN last ON user_id % 3 = p GROUP BY 1""",
)
def partition_progress(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("partition", (F.col("user_id") % 3).cast("int"))
    last = events.groupBy("partition").agg(F.max("event_id").alias("_last"))
    value = F.when(F.col("event_id") == F.col("_last"), "__EOF__").otherwise(F.col("props"))
    raw = events.join(last, "partition").select(
        "partition", value.alias("value"),
        F.array().cast("array<struct<key:string,value:binary>>").alias("headers"),
    )
    got = records.partition_progress(raw)
    return got.withColumn("done", F.col("done").cast("int"))


@query(
    "rate_rollup",
    """
    SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type AS stage, COUNT(*) AS n,
           COUNT(*) FILTER (value <= 10) AS hits, round(avg(CASE WHEN value <= 10 THEN 1 ELSE 0 END), 8) AS hit_rate
    FROM events GROUP BY 1, 2""",
)
def rate_rollup(spark, sf_dir):
    scored = table(spark, sf_dir, "events").select(
        F.timestamp_micros(epoch_micros("ts")).alias("timestamp"),
        F.col("event_type").alias("stage"),
        F.when(F.col("value") <= 10, 1).otherwise(0).alias("hit"),
    )
    got = records.rate_rollup(scored, width="1 day")
    return got.select(
        F.unix_micros("start").alias("start_us"), "stage", "n", "hits", F.round("hit_rate", 8).alias("hit_rate")
    )


@query(
    "round_trip",
    """
    SELECT event_id, (epoch_us(ts) - epoch_us(date_trunc('hour', ts))) / 1000.0 AS rtt_ms FROM events""",
)
def round_trip(spark, sf_dir):
    timed = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("timestamp"), F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("send_ts")
    )
    return records.round_trip(timed).select("event_id", "rtt_ms")


@query(
    "topic_stream",
    """
    WITH r AS (SELECT (user_id % 3) :: INTEGER AS partition, event_type AS stage, value, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1 AS o
               FROM events)
    SELECT partition, stage, COUNT(*) AS n, min(o) AS first_offset, max(o) AS last_offset, round(SUM(value), 4) AS total, 1 AS done
    FROM r GROUP BY 1, 2""",
)
def topic_stream(spark, sf_dir):
    """Events as JSON records in a three-partition topic with end markers: read, deduplicated and decoded as a stream."""
    folder = _run_folder(spark)
    path = f"{folder}/topic" if ":" in folder else f"file://{folder}/topic"
    events = table(spark, sf_dir, "events")
    no_headers = F.array().cast("array<struct<key:string,value:binary>>").alias("headers")
    body = F.to_json(
        F.struct(F.create_map(F.lit("value"), "value").alias("features"), F.col("value").alias("label"), F.col("ts").cast("string").alias("send_ts"), F.col("event_type").alias("stage"))
    )
    lines = events.select(
        (F.col("user_id") % 3).alias("partition"), F.col("event_type").cast("binary").alias("key"), body.cast("binary").alias("value"),
        F.timestamp_micros(epoch_micros("ts")).alias("timestamp"), no_headers, F.col("event_id").alias("o"),
    )
    last = lines.groupBy("partition").agg(F.max("timestamp").alias("timestamp"), (F.max("o") + 1).alias("o"))
    ends = last.select("partition", F.lit(None).cast("binary").alias("key"), F.lit("__EOF__").cast("binary").alias("value"), "timestamp", no_headers, "o")
    topic_log.write_topic(lines.unionByName(ends), path, ["o"])

    def stream():
        return topic_log.read_topic_log(spark, path, "earliest")

    once = records.decode_stream(records.deduplicate(stream(), "365 days"), ["value"])
    once.select("partition", "offset", "stage", "label").writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/c1"
    ).trigger(availableNow=True).start().awaitTermination()
    progress = records.partition_progress(stream()).writeStream.outputMode("complete").foreachBatch(
        lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/progress")
    )
    progress.option("checkpointLocation", f"{folder}/c2").trigger(availableNow=True).start().awaitTermination()
    read = spark.read.parquet(f"{folder}/out").groupBy("partition", "stage").agg(
        F.count(F.lit(1)).alias("n"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.round(F.sum("label"), 4).alias("total")
    )
    done = spark.read.parquet(f"{folder}/progress").select("partition", F.col("done").cast("int").alias("done"))
    return read.join(done, "partition")


@query(
    "asof_streams",
    """
    WITH l AS (SELECT * FROM events WHERE event_type <> 'error'),
    r AS (SELECT ts, value FROM events WHERE event_type = 'error')
    SELECT l.event_id, CASE WHEN epoch_us(l.ts) - epoch_us(r.ts) <= 600000000 THEN r.value END AS js
    FROM l ASOF LEFT JOIN r ON l.ts >= r.ts""",
)
def asof_streams(spark, sf_dir):
    """Two streams joined as of their times; a last record far ahead lets the watermark pass all others."""
    folder = _run_folder(spark)
    events = table(spark, sf_dir, "events").select("event_id", F.timestamp_micros(epoch_micros("ts")).alias("ts"), "event_type", "value")
    events.write.parquet(f"{folder}/in/0")
    far = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("bigint").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    both = far.select("*", F.explode(F.array(F.lit("error"), F.lit("end"))).alias("event_type"), F.lit(0.0).alias("value"))

    def stream():
        return spark.readStream.schema(events.schema).parquet(f"{folder}/in/*")

    def run():
        left, right = stream().where("event_type <> 'error'"), stream().where("event_type = 'error'").withColumnRenamed("value", "js")
        joined = asof.asof_stream(left, right, "event_id", "ts", "js", 600.0, "1 hour")
        joined.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(
            availableNow=True
        ).start().awaitTermination()

    run()
    both.write.parquet(f"{folder}/in/1")
    run()
    return spark.read.parquet(f"{folder}/out").where("event_id >= 0").select("event_id", "js")


CHAIN_PARTS = 4


@query("drift_chain")
def drift_chain(spark, sf_dir):
    """Drift, retrain, publish and swap over the events in four parts; what each part was scored with, and its error."""
    folder = _run_folder(spark)
    events = table(spark, sf_dir, "events")
    cuts = events.select(F.percentile(epoch_seconds("ts"), [i / CHAIN_PARTS for i in range(1, CHAIN_PARTS)])).first()[0]
    part = sum(((epoch_seconds("ts") >= c).cast("int") for c in cuts), F.lit(0))
    config = monitor.MonitorConfig(tiers=MONITOR_TIERS, cooldown_seconds=MONITOR_COOLDOWN)
    loop = feedback.FeedbackLoop(spark, folder, config)
    for i in range(CHAIN_PARTS):
        events.where(part == i).write.parquet(f"{folder}/in/{i}")

        def stream():
            raw = spark.readStream.schema(EVENT_SCHEMA).parquet(f"{folder}/in/*")
            return _records(raw).withColumn("key", F.col("event_type"))

        loop.score(stream()).awaitTermination()
        loop.monitor(stream(), epoch_seconds("send_ts"), [F.col("event_id")]).awaitTermination()
    trace = spark.read.parquet(f"{folder}/trace")
    return trace.groupBy(F.col("batch_id").cast("int").alias("part"), "key", "version").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("prediction") - F.col("label"))), 6).alias("mae")
    )
