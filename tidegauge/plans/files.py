"""Queries that write files under the shared folder and read them back."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from tidegauge.operators import commits, resources, schema
from tidegauge.plans.catalog import query, table
from tidegauge.plans.frames import EVENT_TYPES, event_features
from tidegauge.plans.ingest import USER_SQL, _counter_lines
from tidegauge.session import checkpoint_dir, cut_lineage
from tidegauge.sources import counters, parts, sinks, text


def run_folder(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4()}"


@query(
    "file_lines",
    f"""WITH {USER_SQL}
    SELECT path, event_type AS event, row_number() OVER (PARTITION BY user_id, event_type ORDER BY i) - 1 AS row_idx,
           CASE WHEN k >= 10 THEN value END AS value FROM u""",
)
def file_lines(spark, sf_dir):
    """Counter lines written to one text file per user, read in file order and parsed."""
    folder = run_folder(spark, "lines")
    sinks.write_lines(_counter_lines(spark, sf_dir), folder)
    user = F.regexp_extract("path", r"path=(user\d+)", 1)
    # Written once: the parser reads its lines twice, and each reading opens every file.
    back = cut_lineage(text.read_lines(spark, folder).withColumn("path", user))
    return counters.parse_perf_counters(back, EVENT_TYPES)


@query(
    "file_table",
    """SELECT p_partkey, p_brand, CASE WHEN p_size < 10 THEN NULL ELSE p_size END :: INTEGER AS p_size, p_retailprice FROM part""",
)
def file_table(spark, sf_dir):
    """A table written as CSV with "not counted" cells, and read with them as nulls."""
    folder = run_folder(spark, "table")
    size = F.when(F.col("p_size") < 10, F.lit("<not counted>")).otherwise(F.col("p_size").cast("string"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", size.alias("p_size"), "p_retailprice")
    sinks.write_table(part, folder, fmt="csv")
    back = text.read_table(spark, folder)
    kinds = {"p_partkey": "bigint", "p_size": "int", "p_retailprice": "double"}
    return back.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in back.columns])


@query(
    "metric_shards",
    """SELECT event_type AS component, COUNT(*) AS n, COUNT(DISTINCT event_id) AS ids,
              SUM(event_id % 2) :: BIGINT AS odd FROM events GROUP BY 1""",
)
def metric_shards(spark, sf_dir):
    """Metric events appended in two rounds, read as one table."""
    folder = run_folder(spark, "metrics")
    events = table(spark, sf_dir, "events").select(
        F.col("ts").cast("string").alias("ts"),
        F.col("event_type").alias("component"),
        F.lit("seen").alias("event"),
        F.concat(F.lit("pod"), F.col("user_id") % 3).alias("pod"),
        F.to_json(F.struct("event_id")).alias("kv"),
    )
    number = F.get_json_object("kv", "$.event_id").cast("bigint")
    for rest in (0, 1):
        sinks.append_metrics(events.where(number % 2 == rest), folder)
    back = sinks.read_metrics(spark, folder).withColumn("id", number)
    return back.groupBy("component").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.sum(F.col("id") % 2).alias("odd")
    )


@query(
    "forecast_table",
    """WITH e AS (SELECT user_id, min(value) AS lo, max(value) AS hi, COUNT(*) :: DOUBLE AS n FROM events GROUP BY 1)
    SELECT user_id, 1 :: INTEGER AS step, lo AS pred FROM e UNION ALL SELECT user_id, 2, hi FROM e
    UNION ALL SELECT user_id, 3, n FROM e""",
)
def forecast_table(spark, sf_dir):
    """Arrays of three steps per user, published as steps and read back."""
    folder = run_folder(spark, "forecast")
    steps = F.array(F.min("value"), F.max("value"), F.count(F.lit(1)).cast("double"))
    sinks.write_forecast(table(spark, sf_dir, "events").groupBy("user_id").agg(steps.alias("yhat")), folder, keys=["user_id"])
    return spark.read.parquet(folder).select("user_id", "step", "pred")


@query(
    "column_forms",
    """SELECT p_size AS std_size, p_partkey AS pre_p_partkey, p_size + 1 AS pre_p_size__dup1, p_retailprice AS pre_p_retailprice FROM part""",
)
def column_forms(spark, sf_dir):
    """Repeated names made unique, prefixed, the standard columns moved to the front."""
    part = table(spark, sf_dir, "part")
    doubled = part.select("p_partkey", "p_size", (F.col("p_size") + 1).alias("p_size"), "p_retailprice")
    named = schema.add_prefix(schema.rename_unique(doubled).withColumnRenamed("p_size", "std_size"), "pre_", ["std_size"])
    return schema.reorder_standard_first(named, ["std_size", "not there"])


@query("first_of_equal_names", """SELECT event_id, value, 'first' AS kind FROM events""")
def first_of_equal_names(spark, sf_dir):
    events = event_features(spark, sf_dir)
    twice = events.select("event_id", "value", F.lit("first").alias("kind"), F.lit("second").alias("kind"), F.lit(0).alias("value"))
    return schema.keep_first_columns(twice)


@query(
    "registry_commits",
    """SELECT (s_suppkey % 6) :: INTEGER AS model, COUNT(*) AS n, 1 :: BIGINT AS versions, round(SUM(s_acctbal), 4) AS total, 6 :: BIGINT AS newest
    FROM supplier GROUP BY 1""",
)
def registry_commits(spark, sf_dir):
    """Six versions published by three writers at once, each of them tried twice."""
    folder = run_folder(spark, "registry")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_suppkey") % 6).cast("int").alias("model"))

    def write(model):
        for _ in range(2):
            commits.publish(rows.where(F.col("model") == model), folder, f"model-{model}")

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(6)))
    back = commits.read_versions(spark, folder, "s_suppkey bigint, s_acctbal double, model int")
    newest = commits.commits(spark, folder).agg(F.max("version").alias("newest"))
    read = back.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("version").alias("versions"), F.round(F.sum("s_acctbal"), 4).alias("total")
    )
    return read.join(F.broadcast(newest))


_BROKEN = {
    "cut.csv.gz": (b"\x1f\x8b\x08\x00broken", "damaged archive"),
    "binary.csv": (b"a,b\n\0\1,2\n", "not text"),
    "ragged.csv": (b"a,b\n1,2,3\n", "more cells than names"),
    "nothing.csv": (b"\n\n", "empty"),
}


def _write_parts(spark, sf_dir):
    """One CSV part for each event type, two columns of which only some have, and broken ones."""
    folder = run_folder(spark, "parts")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 5 == 0, "<not counted>").otherwise(F.col("value").cast("string")).alias("value"), "user_id")
    for i, kind in enumerate(EVENT_TYPES):
        own = events.where(F.col("event_type") == kind).drop("event_type", "user_id" if i % 2 else "event_type")
        own.repartition(1).write.option("header", True).csv(f"{folder}/{kind}")
    for name, (content, _) in _BROKEN.items():
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/broken/{name}")
        out = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(place)
        out.write(bytearray(content))
        out.close()
    return folder


def _part_name(path):
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+/[^/]+)$", 1), r"/part-.*", "")


@query(
    "part_status",
    "SELECT event_type AS part, COUNT(*) AS n_rows, NULL :: VARCHAR AS reason FROM events GROUP BY 1 UNION ALL "
    + " UNION ALL ".join(f"SELECT 'broken/{n}', 0, '{why}'" for n, (_, why) in _BROKEN.items()),
)
def part_status(spark, sf_dir):
    """What could be read of every part, and why not."""
    read = parts.read_parts(spark, _write_parts(spark, sf_dir))
    return read.status.select(_part_name("path").alias("part"), "n_rows", "reason")


@query(
    "part_rows",
    f"""SELECT event_type AS part, event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value,
               CASE WHEN event_type IN ({', '.join(f"'{k}'" for k in EVENT_TYPES[::2])}) THEN user_id END AS user_id FROM events""",
)
def part_rows(spark, sf_dir):
    """The readable parts merged by name."""
    rows = parts.read_parts(spark, _write_parts(spark, sf_dir)).rows
    return rows.select(
        _part_name("path").alias("part"), F.col("event_id").cast("bigint").alias("event_id"), F.col("value").cast("double").alias("value"), F.col("user_id").cast("bigint").alias("user_id")
    )


@query(
    "report_table",
    """WITH r AS (SELECT event_type AS component, COUNT(*) AS n, COUNT(*) FILTER (user_id % 2 = 1) AS odd FROM events GROUP BY 1),
    l AS (SELECT 2 + row_number() OVER (ORDER BY component) - 1 AS line_no, '| ' || component || ' | ' || n || ' | ' || odd || ' |' AS line FROM r)
    SELECT 0 :: BIGINT AS line_no, '| component | n | odd |' AS line UNION ALL SELECT 1, '| --- | --- | --- |' UNION ALL SELECT line_no, line FROM l""",
)
def report_table(spark, sf_dir):
    """A summary written as a table and as the text of a report, and read back from both."""
    folder = run_folder(spark, "report")
    odd = F.count_if(F.col("user_id") % 2 == 1).alias("odd")
    summary = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("component")).agg(F.count(F.lit(1)).alias("n"), odd)
    sinks.write_table(summary, f"{folder}/table", fmt="csv")
    back = text.read_table(spark, f"{folder}/table")
    lines = resources.markdown_table(back, ["component"], 100).split("\n")
    spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.text(f"{folder}/text")
    return text.read_lines(spark, f"{folder}/text").select("line_no", "line")
