"""Queries over resource samples, metric events, registries and grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidegauge.functions.scalars import epoch_seconds, first_number
from tidegauge.operators import grids, ordering, registry, resources
from tidegauge.plans.catalog import query, table
from tidegauge.plans.frames import EVENTS_SQL
from tidegauge.sources import merge


def _samples(spark, sf_dir):
    """Events read as resource samples in other units than the target ones."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("component"),
        F.concat(F.lit("pod"), (F.col("user_id") % 3).cast("string")).alias("pod"),
        (epoch_seconds("ts") * 1000).alias("epoch_ms"),
        F.col("value").alias("cpu_percent"),
        (F.col("user_id") % 2 * 4 + 4).alias("ncpu"),
        (first_number("props") * 1024).alias("rss_kb"),
    )


SAMPLES_SQL = f"""{EVENTS_SQL},
    s AS (SELECT event_type AS component, 'pod' || (user_id % 3) AS pod, epoch_us(ts) / 1e6 AS ts, value AS cpu_pct,
                 value * (user_id % 2 * 4 + 4) / 100.0 AS vcpu, k AS rss_mb, 1.0 :: DOUBLE AS host_cpus FROM ev)"""


@query(
    "resource_units",
    f"""WITH {SAMPLES_SQL} SELECT component, pod, round(ts, 3) AS ts, cpu_pct, round(vcpu, 6) AS vcpu,
           round(rss_mb, 6) AS rss_mb, host_cpus FROM s""",
)
def resource_units(spark, sf_dir):
    got = resources.normalize_resource_units(_samples(spark, sf_dir), ["component", "pod"])
    return got.withColumns({"ts": F.round("ts", 3), "vcpu": F.round("vcpu", 6), "rss_mb": F.round("rss_mb", 6)})


@query(
    "resource_summary",
    f"""WITH {SAMPLES_SQL}
    SELECT component, COUNT(*) AS samples, round(avg(cpu_pct), 6) AS cpu_pct_mean,
           round(quantile_cont(cpu_pct, 0.95), 6) AS cpu_pct_p95, max(cpu_pct) AS cpu_pct_max,
           round(avg(rss_mb), 6) AS rss_mb_mean, round(quantile_cont(rss_mb, 0.95), 6) AS rss_mb_p95,
           max(rss_mb) AS rss_mb_max
    FROM s GROUP BY 1""",
)
def resource_summary(spark, sf_dir):
    samples = resources.normalize_resource_units(_samples(spark, sf_dir), ["component"])
    got = resources.resource_summary(samples)
    rounded = ("cpu_pct_mean", "cpu_pct_p95", "rss_mb_mean", "rss_mb_p95")
    return got.withColumns({c: F.round(c, 6) for c in rounded})


@query(
    "binned_total",
    f"""WITH {SAMPLES_SQL},
    p AS (SELECT pod, round_even(ts * 2, 0) / 2 AS ts, avg(vcpu) AS vcpu, max(rss_mb) AS rss_mb, max(host_cpus) AS host_cpus
          FROM s GROUP BY 1, 2),
    t AS (SELECT ts, sum(vcpu) AS vcpu, sum(rss_mb) AS rss_mb, max(host_cpus) AS host_cpus FROM p GROUP BY 1)
    SELECT ts, round(vcpu, 4) AS vcpu, round(rss_mb, 3) AS rss_mb, host_cpus, round(vcpu / host_cpus * 100, 4) AS cpu_pct
    FROM t""",
)
def binned_total(spark, sf_dir):
    samples = resources.normalize_resource_units(_samples(spark, sf_dir), ["pod"])
    return resources.binned_total(samples)


@query(
    "metrics_pivot",
    """
    SELECT event_id, event_type AS component, 'tick' AS event,
           CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS absent FROM events""",
)
def metrics_pivot(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("component"), F.lit("tick").alias("event"), F.col("props").alias("kv")
    )
    return resources.metrics_pivot(events, ["k", "absent"], keys=["event_id", "component", "event"])


@query(
    "metrics_rollup",
    """
    SELECT event_type AS component, user_id % 4 AS event, COUNT(*) AS n,
           round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS k_mean,
           max(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS k_max
    FROM events GROUP BY 1, 2""",
)
def metrics_rollup(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("component"), (F.col("user_id") % 4).alias("event"), F.col("props").alias("kv")
    )
    pivoted = resources.metrics_pivot(events, ["k"], keys=["component", "event"])
    return resources.metrics_rollup(pivoted, ["k"]).withColumn("k_mean", F.round("k_mean", 6))


@query(
    "metric_lines",
    r"""
    SELECT event_id :: VARCHAR AS ts, event_type AS component, 'tick' AS event, 'pod' || (user_id % 3) AS pod,
           '{"a":1,"k":' || regexp_extract(props, '\d+', 0) || '}' AS kv FROM events""",
)
def metric_lines(spark, sf_dir):
    payload = F.concat(F.lit('{"a":1,"k":'), F.regexp_extract("props", r"\d+", 0), F.lit("}"))
    pod = F.concat(F.lit("pod"), (F.col("user_id") % 3).cast("string"))
    lines = table(spark, sf_dir, "events").select(
        F.concat_ws(",", F.col("event_id").cast("string"), "event_type", F.lit("tick"), pod, payload).alias("line")
    )
    return resources.parse_metric_lines(lines)


@query(
    "latest_version",
    """
    SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice
    FROM orders GROUP BY 1""",
)
def latest_version(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return registry.latest_version(orders, ["o_custkey"], "o_orderkey")


@query(
    "pointer_metrics",
    """
    WITH v AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1)
    SELECT v.o_custkey, v.o_orderkey, m.lines, m.price FROM v
    LEFT JOIN (SELECT l_orderkey AS o_orderkey, COUNT(*) AS lines, round(sum(l_extendedprice), 2) AS price
               FROM lineitem GROUP BY 1) m ON v.o_orderkey = m.o_orderkey""",
)
def pointer_metrics(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    metrics = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price")
    )
    latest = registry.latest_version(orders, ["o_custkey"], "o_orderkey")
    return registry.with_metrics(latest, metrics, "o_orderkey")


@query(
    "promotion",
    """
    WITH v AS (SELECT o_custkey, o_orderkey, o_orderstatus AS content, o_totalprice / 5000 AS acc FROM orders),
    s AS (SELECT *, lag(content) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM v)
    SELECT o_custkey, o_orderkey, round(acc - 50, 6) AS gain_pp,
           (previous IS NULL OR previous <> content) :: INTEGER AS changed,
           ((previous IS NULL OR previous <> content) AND acc - 50 >= 0.01) :: INTEGER AS promoted
    FROM s""",
)
def promotion(spark, sf_dir):
    accuracy = (F.col("o_totalprice") / 5000).cast("string")
    versions = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.col("o_orderstatus").alias("content"),
        F.create_map(
            F.lit("acc@0.25"), accuracy, F.lit("baseline_acc@0.25"), F.lit("50")
        ).alias("metrics"),
    )
    got = registry.promotion_gate(versions, ["o_custkey"], "o_orderkey")
    return got.select(
        "o_custkey", "o_orderkey", F.round("gain_pp", 6).alias("gain_pp"),
        F.col("changed").cast("int").alias("changed"), F.col("promoted").cast("int").alias("promoted"),
    )


@query(
    "grid_expand",
    """
    SELECT b.p_brand, CAST(lr AS DOUBLE) AS lr, bs :: INTEGER AS batch_size
    FROM (SELECT DISTINCT p_brand FROM part) b, (SELECT unnest([0.005, 0.01]) AS lr) l, (SELECT unnest([16, 32]) AS bs) s""",
)
def grid_expand(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    return grids.expand_grid(brands, {"lr": grids.LEARNING_RATES["A"], "batch_size": grids.BATCH_SIZES})


@query(
    "grid_semi",
    """
    WITH few AS (SELECT p_brand FROM part GROUP BY 1 HAVING avg(p_size) > 25)
    SELECT DISTINCT p.p_brand, bs :: INTEGER AS batch_size FROM part p, (SELECT unnest([16, 32]) AS bs) s
    WHERE p.p_brand IN (SELECT p_brand FROM few)""",
)
def grid_semi(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    candidates = part.groupBy("p_brand").agg(F.avg("p_size").alias("s")).filter("s > 25")
    grid = grids.expand_grid(part.select("p_brand").distinct(), {"batch_size": grids.BATCH_SIZES})
    return grids.prune_grid(grid, candidates, "p_brand")


@query(
    "union_by_name",
    """
    SELECT 'customer' AS part, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier""",
)
def union_by_name(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return merge.union_tables({"customer": customers, "supplier": suppliers})


@query(
    "first_seen",
    "SELECT p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY 1",
)
def first_seen(spark, sf_dir):
    return ordering.first_seen(table(spark, sf_dir, "part"), "p_brand", "p_partkey")


@query(
    "merge_traces",
    """
    SELECT user_id % 3 AS replica, event_id, value AS truth, value * 1.1 :: DOUBLE AS pred_adj FROM events""",
)
def merge_traces(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("replica", F.col("user_id") % 3)
    trace = events.select("replica", "event_id", F.col("value").alias("truth"), (F.col("value") * 1.1).alias("pred_adj"))
    return resources.merge_traces(*[trace.filter(F.col("replica") == i) for i in range(3)])


@query(
    "latest_pointer",
    """
    SELECT max(o_orderkey) AS o_orderkey, arg_max(o_custkey, o_orderkey) AS o_custkey FROM orders WHERE o_orderstatus = 'P'""",
)
def latest_pointer(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    pointed = orders.filter("o_orderstatus = 'P'").drop("o_orderstatus")
    fallback = orders.filter("o_orderstatus <> 'P'").drop("o_orderstatus")
    return registry.latest_pointer(pointed, fallback, "o_orderkey")


_GRID_SQL = {
    "A": ("[0.005, 0.01]", "['32,16', '64,32']", "['relu', 'gelu']", "['smoothl1']"),
    "B": ("[0.003, 0.01]", "['64,32', '96,48', '128,64']", "['relu', 'gelu']", "['smoothl1', 'mse']"),
    "C": ("[0.001, 0.003, 0.01]", "['128,64', '160,80', '192,96']", "['relu', 'mse']", "['smoothl1', 'mse']"),
}


def _grid_sql(tier: str, rates: str, shapes: str, activations: str, losses: str) -> str:
    axes = {"lr": f"{rates} :: DOUBLE[]", "batch_size": "[16, 32]", "hidden": shapes, "activation": activations, "loss": losses, "wd": "[0.0, 0.0001] :: DOUBLE[]"}
    tables = ", ".join(f"(SELECT unnest({v}) AS {k}, generate_subscripts({v}, 1) AS i_{k})" for k, v in axes.items())
    order = ", ".join(f"i_{k}" for k in axes)
    return f"SELECT '{tier}' AS tier, (row_number() OVER (ORDER BY {order}) - 1) :: INTEGER AS candidate_id, {', '.join(axes)} FROM {tables}"


@query(
    "tier_grid_rows",
    f"""
    WITH t AS (SELECT event_type, CASE WHEN COUNT(*) % 3 = 0 THEN 'A' WHEN COUNT(*) % 3 = 1 THEN 'B' ELSE 'C' END AS tier FROM events GROUP BY 1),
    g AS ({' UNION ALL '.join(_grid_sql(t, *axes) for t, axes in _GRID_SQL.items())})
    SELECT event_type, t.tier, candidate_id, lr, batch_size, hidden, activation, loss, wd FROM t JOIN g ON t.tier = g.tier""",
)
def tier_grid_rows(spark, sf_dir):
    """The candidates themselves of the tier each event type falls into."""
    rest = F.count(F.lit(1)) % 3
    tiers = table(spark, sf_dir, "events").groupBy("event_type").agg(F.when(rest == 0, "A").when(rest == 1, "B").otherwise("C").alias("tier"))
    grid = reduce(lambda a, b: a.unionByName(b), [grids.tier_grid(spark, t) for t in ("A", "B", "C")])
    rows = tiers.join(F.broadcast(grid), "tier")
    return rows.select("event_type", "tier", "candidate_id", "lr", "batch_size", F.array_join(F.col("hidden").cast("array<string>"), ",").alias("hidden"), "activation", "loss", "wd")


@query(
    "tier_candidates",
    """
    WITH t AS (SELECT event_type, CASE WHEN avg(value) >= 30 THEN 'A' ELSE 'B' END AS tier FROM events GROUP BY 1)
    SELECT event_type, tier, CASE tier WHEN 'A' THEN 32 ELSE 96 END :: BIGINT AS candidates FROM t""",
)
def tier_candidates(spark, sf_dir):
    tiers = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("v")).select(
        "event_type", F.when(F.col("v") >= 30, "A").otherwise("B").alias("tier")
    )
    grid = reduce(lambda a, b: a.unionByName(b), [grids.tier_grid(spark, t) for t in ("A", "B", "C")])
    sizes = grid.groupBy("tier").agg(F.count(F.lit(1)).alias("candidates"))
    return tiers.join(sizes, "tier").select("event_type", "tier", "candidates")
