"""Queries that parse counter files. Their text lines are rendered from the events table, one
file or experiment per user, so the work grows with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators.ordering import row_index
from tidegauge.plans.catalog import query, table
from tidegauge.plans.frames import EVENT_TYPES, EVENTS_SQL, event_features
from tidegauge.sources import counters, hardware, merge, replay, text

EVENT_ORDER = ["ts", "event_id"]
USER_SQL = f"""{EVENTS_SQL},
    u AS (SELECT *, 'user' || user_id AS path,
                 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM ev)"""


def user_rows(spark, sf_dir, group=("user_id",)):
    """Events with their place ``i`` in their series and the user's file name."""
    events = event_features(spark, sf_dir).withColumn(
        "path", F.concat(F.lit("user"), F.col("user_id").cast("string"))
    )
    return row_index(events, EVENT_ORDER, list(group), name="i")


def as_lines(rows, line, line_no="i"):
    return rows.select("path", F.expr(str(line_no)).cast("bigint").alias("line_no"), line.alias("line"))


def with_header(rows, lines, header, shift):
    """Put a header line before each user's lines."""
    heads = rows.select("path").distinct().select(
        "path", F.lit(0).cast("bigint").alias("line_no"), F.lit(header).alias("line")
    )
    return lines.withColumn("line_no", F.col("line_no") + shift).unionByName(heads)


def _counter_lines(spark, sf_dir):
    count = F.when(F.col("k") < 10, F.lit("<not counted>")).otherwise(F.col("value").cast("string"))
    line = F.concat_ws(",", F.lit(" 0.00"), count, F.lit(""), F.upper("event_type"), F.lit("0.00%"), F.col("k").cast("string"))
    return as_lines(user_rows(spark, sf_dir), line)


@query(
    "counter_lines",
    f"""WITH {USER_SQL}
    SELECT path, event_type AS event, row_number() OVER (PARTITION BY user_id, event_type ORDER BY i) - 1 AS row_idx,
           CASE WHEN k >= 10 THEN value END AS value FROM u""",
)
def counter_lines(spark, sf_dir):
    return counters.parse_perf_counters(_counter_lines(spark, sf_dir), EVENT_TYPES)


@query(
    "counter_lines_legacy",
    f"""WITH {USER_SQL},
    n AS (SELECT *, [CASE WHEN k >= 10 THEN value ELSE 0.0 END, 0.0, k] AS nums FROM u)
    SELECT path, event_type AS event, row_number() OVER (PARTITION BY user_id, event_type ORDER BY i) - 1 AS row_idx,
           list_max(list_filter(nums, lambda x: x < 0.1 OR x > 10.0)) :: DOUBLE AS value FROM n""",
)
def counter_lines_legacy(spark, sf_dir):
    return counters.parse_perf_counters(_counter_lines(spark, sf_dir), EVENT_TYPES, "legacy_max")


@query(
    "counter_pivot",
    f"""WITH {USER_SQL},
    s AS (SELECT path, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY i) - 1 AS row_idx FROM u)
    SELECT path, row_idx, max(value) FILTER (event_type = 'click') AS firewall_cycles,
           max(value) FILTER (event_type = 'view') AS bridge_cycles,
           max(value) FILTER (event_type = 'error') AS nf_router_cycles,
           max(value) FILTER (event_type = 'purchase') AS ndpi_stats_cycles,
           max(value) FILTER (event_type = 'signup') AS payload_scan_cycles,
           CAST(NULL AS DOUBLE) AS nf_router_branches
    FROM s GROUP BY 1, 2""",
)
def counter_pivot(spark, sf_dir):
    functions = {"click": "firewall", "view": "bridge", "error": "nf_router", "purchase": "ndpi_stats", "signup": "payload_scan"}
    vnf = F.create_map(*[F.lit(x) for pair in functions.items() for x in pair])[F.col("event_type")]
    rows = event_features(spark, sf_dir).select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("path"),
        vnf.alias("vnf"),
        F.lit("cycles").alias("event"), "value", *EVENT_ORDER,
    )
    long = row_index(rows, EVENT_ORDER, ["path", "vnf", "event"])
    wide = counters.pivot_counters(long, ["path"])
    return wide.select("path", "row_idx", *[f"{f}_cycles" for f in functions.values()], "nf_router_branches")


@query(
    "latency_lines",
    f"""WITH {USER_SQL},
    v AS (SELECT path, i, round(value * 100) AS v FROM u WHERE k <> 7),
    m AS (SELECT path, quantile_cont(v, 0.5) AS med FROM v GROUP BY 1)
    SELECT path, row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS row_idx,
           CASE WHEN med > 1000 THEN v / 1000.0 ELSE v END AS value
    FROM v JOIN m USING (path)""",
)
def latency_lines(spark, sf_dir):
    number = F.concat_ws(" ", F.col("i").cast("string"), F.round(F.col("value") * 100).cast("bigint").cast("string"))
    line = F.when(F.col("k") == 7, "<<<<<<< HEAD").otherwise(number)
    return counters.parse_latency(as_lines(user_rows(spark, sf_dir), line))


@query(
    "latency_plain",
    f"""WITH {USER_SQL}
    SELECT path, i AS row_idx, CASE WHEN k >= 10 THEN value END AS value FROM u""",
)
def latency_plain(spark, sf_dir):
    value = F.when(F.col("k") < 10, "HEAD").otherwise(F.col("value").cast("string"))
    line = F.concat_ws(" ", F.col("i").cast("string"), value)
    got = hardware.parse_latency_plain(as_lines(user_rows(spark, sf_dir), line))
    return got.select("path", "row_idx", "value")


@query(
    "rate_stats",
    f"""WITH {USER_SQL}
    SELECT path, i AS row_idx, CASE WHEN user_id % 3 = 0 THEN value WHEN user_id % 3 = 1 THEN k END AS value
    FROM u WHERE user_id % 3 <> 2
    UNION ALL
    SELECT path, i, value FROM u WHERE user_id % 3 = 2""",
)
def rate_stats(spark, sf_dir):
    rows = user_rows(spark, sf_dir)
    v, k = F.col("value").cast("string"), F.col("k").cast("string")
    body = F.when(F.col("user_id") % 3 == 0, F.concat_ws(",", F.lit("t"), k, v))
    body = body.when(F.col("user_id") % 3 == 1, F.concat_ws(",", F.lit("t"), k, v))
    body = body.otherwise(F.concat_ws(",", *[F.lit("x")] * 5, F.concat(v, F.lit("Mb"))))
    lines = as_lines(rows, body)
    heads = rows.select("path", "user_id").distinct().select(
        "path",
        F.lit(0).cast("bigint").alias("line_no"),
        F.when(F.col("user_id") % 3 == 0, "Time,PacketRate,Mbit")
        .when(F.col("user_id") % 3 == 1, "Time,load,other")
        .otherwise("a,b,c,d,e,f")
        .alias("line"),
    )
    return counters.parse_rate_stats(lines.withColumn("line_no", F.col("line_no") + 1).unionByName(heads))


PERF_FILES = {"click": "firewall", "view": "bridge", "error": "latency", "purchase": "rx_stats", "signup": "tx_stats"}


@query(
    "perf_table",
    f"""WITH {EVENTS_SQL},
    s AS (SELECT 'exp-' || user_id AS exp, event_type, value,
                 row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS row_idx FROM ev),
    n AS (SELECT exp, event_type, COUNT(*) AS n FROM s WHERE event_type <> 'view' GROUP BY 1, 2),
    len AS (SELECT exp, min(n) AS n FROM n GROUP BY 1),
    l AS (SELECT exp, quantile_cont(value, 0.5) AS med FROM s WHERE event_type = 'error' GROUP BY 1)
    SELECT 'perf' AS scenario, s.exp, row_idx,
           max(value) FILTER (event_type = 'signup') AS input_rate,
           max(value) FILTER (event_type = 'purchase') AS output_rate,
           max(CASE WHEN med > 1000 THEN value / 1000 ELSE value END) FILTER (event_type = 'error') AS latency,
           max(value) FILTER (event_type = 'click') AS firewall_instructions,
           max(value) FILTER (event_type = 'view') AS bridge_cycles
    FROM s JOIN len USING (exp) LEFT JOIN l USING (exp) WHERE row_idx < n GROUP BY ALL""",
)
def perf_table(spark, sf_dir):
    rows = user_rows(spark, sf_dir, ["user_id", "event_type"])
    names = F.create_map(*[F.lit(x) for pair in PERF_FILES.items() for x in pair])
    rows = rows.withColumn(
        "path",
        F.concat(F.lit("raw/perf/exp-"), F.col("user_id").cast("string"), F.lit("/"), names[F.col("event_type")], F.lit(".csv")),
    )
    v = F.col("value").cast("string")
    counter = F.when(F.col("event_type") == "click", "instructions").otherwise("cycles")
    line = (
        F.when(F.col("event_type").isin("click", "view"), F.concat_ws(",", F.lit("1.0"), v, F.lit(""), counter))
        .when(F.col("event_type") == "error", F.concat_ws(" ", F.col("i").cast("string"), v))
        .otherwise(F.concat_ws(",", F.lit("t"), v))
    )
    stats = rows.filter("event_type in ('purchase', 'signup')")
    lines = with_header(stats, as_lines(rows, line), "Time,Mbit", 1)
    wide = counters.build_perf_table(lines)
    return wide.select(
        "scenario", "exp", "row_idx", *counters.KPI_COLUMNS, "firewall_instructions", "bridge_cycles"
    )


@query(
    "pcie_blocks",
    f"""WITH {USER_SQL}
    SELECT path, i // 6 AS row_idx,
           'skt-' || ((i % 6) // 3) || '_' || c.name || '-' || ['total', 'miss', 'hit'][(i % 3) + 1] AS name,
           CASE c.name WHEN 'PCIRdCur' THEN round(value) ELSE k END AS value
    FROM u, (SELECT unnest(['PCIRdCur', 'WiL']) AS name) c""",
)
def pcie_blocks(spark, sf_dir):
    rows = user_rows(spark, sf_dir)
    kind = F.get(F.array(F.lit("(Total)"), F.lit("(Miss)"), F.lit("(Hit)")), (F.col("i") % 3).cast("int"))
    socket = F.floor((F.col("i") % 6) / 3).cast("string")
    line = F.concat_ws(
        ",", socket, F.round("value").cast("bigint").cast("string"), F.concat(F.col("k").cast("bigint").cast("string"), kind)
    )
    lines = as_lines(rows, line, "1 + i + floor(i / 6)")
    got = hardware.reshape_pcie(with_header(rows, lines, "Skt,PCIRdCur,WiL", 0))
    return got.select("path", "row_idx", "name", "value")


@query(
    "two_row_header",
    f"""WITH {USER_SQL}
    SELECT path, i AS row_idx, 'S-a' AS name, value FROM u
    UNION ALL SELECT path, i, 'S-a__dup1', k FROM u
    UNION ALL SELECT path, i, 'T-b', NULL FROM u""",
)
def two_row_header(spark, sf_dir):
    rows = user_rows(spark, sf_dir)
    line = F.concat_ws(",", F.col("value").cast("string"), F.concat(F.col("k").cast("string"), F.lit("x")), "event_type")
    lines = with_header(rows, as_lines(rows, line), "S,S,T", 2)
    second = rows.select("path").distinct().select(
        "path", F.lit(1).cast("bigint").alias("line_no"), F.lit("a,a,b").alias("line")
    )
    return hardware.read_two_row_header(lines.unionByName(second), "tx").select("path", "row_idx", "name", "value")


@query(
    "memory_counters",
    f"""WITH {USER_SQL}
    SELECT path, i AS row_idx, 'm' AS name, value FROM u
    UNION ALL SELECT path, i, 'm__dup1', CASE WHEN k >= 10 THEN k END FROM u""",
)
def memory_counters(spark, sf_dir):
    rows = user_rows(spark, sf_dir)
    second = F.when(F.col("k") < 10, "").otherwise(F.col("k").cast("string"))
    line = F.concat_ws(",", F.lit("d"), F.lit("t"), F.col("value").cast("string"), F.lit(""), second)
    lines = with_header(rows, as_lines(rows, line), "-Date,-Time,m,gone,m", 1)
    return hardware.read_memory_counters(lines).select("path", "row_idx", "name", "value")


TAG_OF = dict(zip(EVENT_TYPES, ("router", "ndpi_stat", "bridge", "payload_scan", "firewall")))
TAG_CASE_SQL = "CASE event_type " + " ".join(f"WHEN '{t}' THEN '{g}'" for t, g in TAG_OF.items()) + " END"
TAGS_SQL = f"""{USER_SQL},
    r AS (SELECT path, {TAG_CASE_SQL} AS tag, value, k,
                 row_number() OVER (PARTITION BY user_id, event_type ORDER BY i) - 1 AS row_idx FROM u),
    first_tag AS (SELECT path, tag, COUNT(*) AS n, CASE tag WHEN 'ndpi_stat' THEN 0 WHEN 'router' THEN 1
                  WHEN 'payload_scan' THEN 2 WHEN 'bridge' THEN 3 ELSE 4 END AS p FROM r GROUP BY 1, 2),
    tag_len AS (SELECT path, arg_min(n, p) AS n FROM first_tag GROUP BY 1)"""


def _tag_lines(rows):
    tags = F.create_map(*[F.lit(x) for pair in TAG_OF.items() for x in pair])
    cells = [F.col("value").cast("string"), F.lit("W"), F.col("k").cast("string")]
    line = F.concat_ws(
        ",", tags[F.col("event_type")], F.lit("2"), F.lit("3"), cells[0], cells[2], *[F.lit("0")] * 7, cells[1], *[F.lit("0")] * 8
    )
    return as_lines(rows, line)


@query(
    "tag_series",
    f"""WITH {TAGS_SQL}
    SELECT path, row_idx, tag || '-' || f AS name,
           CASE f WHEN 'thread_info.core' THEN value WHEN 'rx_pps' THEN k ELSE NULL END AS value
    FROM r JOIN tag_len USING (path), (SELECT unnest(['thread_info.core', 'rx_pps', 'state']) AS f) c
    WHERE row_idx < n""",
)
def tag_series(spark, sf_dir):
    got = hardware.widen_by_tag(_tag_lines(user_rows(spark, sf_dir)))
    kept = got.filter(F.col("name").rlike(r"-(thread_info\.core|rx_pps|state)$"))
    return kept.select("path", "row_idx", "name", "value")


@query(
    "hardware_table",
    f"""WITH {TAGS_SQL},
    lat AS (SELECT path, i AS row_idx, value FROM u),
    len AS (SELECT path, least(t.n, (SELECT COUNT(*) FROM u WHERE u.path = t.path)) AS n FROM tag_len t)
    SELECT lat.path, lat.row_idx, lat.value AS latency,
           max(r.value) FILTER (tag = 'router') AS router_core, max(r.k) FILTER (tag = 'bridge') AS bridge_rx
    FROM lat JOIN len USING (path) LEFT JOIN r ON r.path = lat.path AND r.row_idx = lat.row_idx
    WHERE lat.row_idx < n GROUP BY 1, 2, 3""",
)
def hardware_table(spark, sf_dir):
    rows = user_rows(spark, sf_dir)
    latency = hardware.parse_latency_plain(
        as_lines(rows, F.concat_ws(" ", F.col("i").cast("string"), F.col("value").cast("string")))
    )
    wide = hardware.assemble([hardware.widen_by_tag(_tag_lines(rows)), latency])
    return wide.select(
        "path", "row_idx", "latency",
        F.col("`router-thread_info.core`").alias("router_core"),
        F.col("`bridge-rx_pps`").alias("bridge_rx"),
    )


@query(
    "modal_schema_merge",
    f"""
    WITH p AS (SELECT strftime(ts, '%Y-%m-%d %H') AS part, event_type, value,
                      row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d %H'), event_type ORDER BY ts, event_id) - 1 AS row_idx
               FROM events),
    sig AS (SELECT part, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS s FROM p GROUP BY 1),
    best AS (SELECT s FROM sig GROUP BY 1 ORDER BY COUNT(*) DESC, min(part) LIMIT 1)
    SELECT part, row_idx, round(sum(COALESCE(x, 0)), 4) AS total, COUNT(*) AS columns FROM (
      SELECT part, row_idx, t, max(value) FILTER (event_type = t) AS x
      FROM p, (SELECT unnest(string_split(s, ',')) AS t FROM best) b GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def modal_schema_merge(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH").alias("part"),
        F.lit("p").alias("piece"),
        (F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type")) - 1).alias("position"),
        F.col("event_type").alias("name"), "value", *EVENT_ORDER,
    )
    long = row_index(events, EVENT_ORDER, ["part", "name"])
    merged = hardware.merge_modal_schema(long.drop(*EVENT_ORDER), "part")
    cols = merged.columns[2:]
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    return merged.select(
        "part", "row_idx", F.round(total, 4).alias("total"), F.lit(len(cols)).cast("bigint").alias("columns")
    )


@query(
    "discover_experiments",
    """
    SELECT DISTINCT lang AS scenario, 'exp-' || (doc_id % 17) || source AS exp, (doc_id % 17) :: BIGINT AS exp_no
    FROM documents""",
)
def discover_experiments(spark, sf_dir):
    number = (F.col("doc_id") % 17).cast("string")
    paths = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("raw/"), "lang", F.lit("/exp-"), number, "source", F.lit("/a.csv")).alias("path")
    )
    return text.discover_experiments(paths)


@query(
    "merge_scenario",
    """
    WITH d AS (SELECT source AS exp, doc_id AS row_idx FROM documents WHERE lang = 'en'),
    o AS (SELECT exp, row_number() OVER (ORDER BY CAST(regexp_extract(exp, '[0-9]+', 0) AS INTEGER)) :: INTEGER AS exp_order
          FROM (SELECT DISTINCT exp FROM d))
    SELECT 'en' AS scenario, exp, row_idx, exp_order FROM d JOIN o USING (exp)""",
)
def merge_scenario(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("scenario"), F.col("source").alias("exp"), F.col("doc_id").alias("row_idx")
    )
    return merge.merge_scenario(docs, "en")


@query(
    "stage_replay",
    """
    WITH o AS (SELECT o_totalprice AS price, o_orderkey AS k, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS a,
                      row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS z FROM orders),
    c AS (SELECT c_acctbal AS price, row_number() OVER (ORDER BY c_custkey) AS a FROM customer)
    SELECT 0 AS stage_no, 500 - z AS row_idx, 'stage0' AS stage, price, 0.0 :: DOUBLE AS absent, k :: DOUBLE AS target FROM o WHERE z <= 500
    UNION ALL SELECT 1, a - 1, 'stage1', price, 0.0, k FROM o WHERE a <= 1000
    UNION ALL SELECT 2, a - 1, 'stage2', price, 0.0, a FROM c""",
)
def stage_replay(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("target"), "o_orderdate", "o_orderkey"
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_acctbal").alias("price"), (F.col("c_custkey") + 1).alias("target"), "c_custkey"
    )
    order = ("o_orderdate", "o_orderkey")
    stages = [
        replay.Stage("stage0", "orders", "tail", 500, order),
        replay.Stage("stage1", "orders", "head", 1000, order),
        replay.Stage("stage2", "customers", "head", 0, ("c_custkey",)),
    ]
    return replay.stage_replay({"orders": orders, "customers": customers}, stages, ["price", "absent"], "target")


@query(
    "record_round_trip",
    f"""WITH {EVENTS_SQL}
    SELECT event_id, value AS f_value, k AS f_k, 0.0 :: DOUBLE AS f_absent, hour AS label, event_type AS stage,
           epoch_us(date_trunc('second', ts)) AS sent_us FROM ev""",
)
def record_round_trip(spark, sf_dir):
    events = event_features(spark, sf_dir)
    sent = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    messages = events.select(
        "event_id", replay.encode_payload(events, ["value", "k"], "hour", sent, "event_type").alias("value")
    )
    back = replay.decode_records(messages, ["value", "k", "absent"])
    return back.select(
        "event_id",
        F.col("x")[0].alias("f_value"),
        F.col("x")[1].alias("f_k"),
        F.col("x")[2].alias("f_absent"),
        "label",
        "stage",
        F.unix_micros("send_ts").alias("sent_us"),
    )
