"""Queries over ordered series: windows, drift, alignment and running values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.scalars import epoch_seconds
from tidegauge.operators import alignment, drift, sequence, stats
from tidegauge.operators import ordering as o
from tidegauge.plans.catalog import query, table
from tidegauge.plans.frames import (
    EVENT_FEATURES,
    EVENT_TYPES,
    EVENTS_SQL,
    LINE_ORDER,
    LINE_ORDER_SQL,
    PAIRS_SQL,
    event_features,
    price_pairs,
)

SIZE, STRIDE, BINS = drift.WINDOW_SIZE, drift.WINDOW_STRIDE, drift.HISTOGRAM_BINS
EVENT_ORDER = ["ts", "event_id"]


def drift_sql(size: int, stride: int, bins: int, frozen: bool = False, group: str = "event_type", spans: str = "", start: str = "") -> str:
    """CTEs ending in ``scored(event_type, window_id, js)``; ``spans`` may name other windows (g, k) with a ``start``."""
    start = start or f"s.k * {stride}"
    spans = spans or f"SELECT g, unnest(range(1, (n - {size}) // {stride} + 1)) AS k FROM sizes WHERE n >= {size}"
    lo, hi = ("b.lo", "b.hi") if frozen else ("least(min(w.v), b.lo)", "greatest(max(w.v), b.hi)")
    spot = f"least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1})"
    if frozen:
        spot = f"greatest(0, {spot})"
    smooth = lambda c: f"(({c} / ({size} * ((hi - lo) / {bins})) + 1e-12) / (1 / ((hi - lo) / {bins}) + {bins} * 1e-12))"
    return f"""{EVENTS_SQL},
    src AS (SELECT {group} AS g, row_number() OVER (PARTITION BY {group} ORDER BY ts, event_id) - 1 AS i,
                   value, hour, k FROM ev),
    feat AS (SELECT g, i, 0 AS j, value AS v FROM src UNION ALL SELECT g, i, 1, hour FROM src
             UNION ALL SELECT g, i, 2, COALESCE(k, 0.0) FROM src),
    sizes AS (SELECT g, COUNT(*) AS n FROM src GROUP BY 1),
    spans AS ({spans}),
    w AS (SELECT f.g, s.k, f.j, f.v FROM feat f JOIN spans s
          ON f.g = s.g AND f.i >= {start} AND f.i < {start} + {size}),
    base AS (SELECT g, j, v FROM feat WHERE i < {size}),
    ends AS (SELECT g, j, min(v) AS lo, max(v) AS hi FROM base GROUP BY 1, 2),
    rng AS (SELECT w.g, w.k, w.j, {lo} AS lo, {hi} AS hi FROM w JOIN ends b ON w.g = b.g AND w.j = b.j
            GROUP BY w.g, w.k, w.j, b.lo, b.hi),
    hw AS (SELECT g, k, j, {spot} AS b, COUNT(*) AS c FROM w JOIN rng USING (g, k, j) WHERE hi > lo GROUP BY 1, 2, 3, 4),
    hb AS (SELECT g, k, j, {spot} AS b, COUNT(*) AS c FROM base JOIN rng USING (g, j) WHERE hi > lo GROUP BY 1, 2, 3, 4),
    pq AS (SELECT g, k, j, {smooth('COALESCE(hb.c, 0)')} AS p, {smooth('COALESCE(hw.c, 0)')} AS q
           FROM hw FULL JOIN hb USING (g, k, j, b) JOIN rng USING (g, k, j)),
    js AS (SELECT g, k, j, sum((p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2) AS js
           FROM pq GROUP BY 1, 2, 3),
    scored AS (SELECT spans.g AS event_type, spans.k AS window_id, COALESCE(avg(js), 0.0) AS js
               FROM spans LEFT JOIN js ON spans.g = js.g AND spans.k = js.k GROUP BY 1, 2)"""


def tier_sql(a, b, c):
    return f"CASE WHEN js >= {c} THEN 'C' WHEN js >= {b} THEN 'B' WHEN js >= {a} THEN 'A' END"


def _scored(spark, sf_dir, **options):
    return drift.drift_windows(
        event_features(spark, sf_dir), EVENT_ORDER, EVENT_FEATURES, ["event_type"], **options
    )


@query(
    "drift_windows",
    f"WITH {drift_sql(SIZE, STRIDE, BINS)} SELECT event_type, window_id, round(js, 9) AS js, "
    f"{tier_sql(0.2, 0.5, 0.8)} AS tier FROM scored",
)
def drift_windows(spark, sf_dir):
    return _scored(spark, sf_dir).withColumn("js", F.round("js", 9))


@query(
    "drift_frozen",
    f"WITH {drift_sql(SIZE, STRIDE, BINS, True)} SELECT event_type, window_id, round(js, 9) AS js, "
    f"{tier_sql(0.2, 0.5, 0.8)} AS tier FROM scored",
)
def drift_frozen(spark, sf_dir):
    return _scored(spark, sf_dir, range_mode="frozen").withColumn("js", F.round("js", 9))


@query(
    "drift_log2",
    f"WITH {drift_sql(SIZE, 150, 32)} SELECT event_type, window_id, round(js / ln(2), 9) AS js FROM scored",
)
def drift_log2(spark, sf_dir):
    scored = _scored(spark, sf_dir, stride=150, bins=32, log_base=2)
    return scored.select("event_type", "window_id", F.round("js", 9).alias("js"))


# Tier thresholds low enough for the drift present in the events table.
EPISODE_TIERS = (("C", 0.05), ("B", 0.044), ("A", 0.04))


@query(
    "drift_episodes",
    f"""WITH {drift_sql(SIZE, STRIDE, BINS)},
    t AS (SELECT event_type, window_id, js, {tier_sql(0.04, 0.044, 0.05)} AS tier FROM scored),
    m AS (SELECT *, CASE WHEN window_id - lag(window_id) OVER (PARTITION BY event_type ORDER BY window_id) <= 1
                    THEN 0 ELSE 1 END AS fresh FROM t WHERE tier IS NOT NULL),
    e AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY window_id) AS episode FROM m)
    SELECT event_type, episode :: BIGINT AS episode, min(window_id) AS first_window, max(window_id) AS last_window,
           COUNT(*) AS windows, round(max(js), 9) AS max_js, max(tier) AS max_tier,
           arg_min(tier, window_id) AS first_tier
    FROM e GROUP BY 1, 2""",
)
def drift_episodes(spark, sf_dir):
    events = event_features(spark, sf_dir)
    windows = o.largest_group(events, ["event_type"]) // STRIDE + 1
    scored = drift.drift_windows(
        events, EVENT_ORDER, EVENT_FEATURES, ["event_type"], tiers=EPISODE_TIERS
    )
    got = drift.drift_episodes(scored, ["event_type"], largest=windows)
    return got.withColumn("max_js", F.round("max_js", 9))


@query(
    "count_windows",
    f"""
    WITH src AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events),
    sizes AS (SELECT event_type, COUNT(*) AS n FROM src GROUP BY 1),
    spans AS (SELECT event_type, unnest(range(0, (n - {SIZE}) // {STRIDE} + 1)) AS window_id FROM sizes WHERE n >= {SIZE})
    SELECT event_type, window_id, COUNT(*) AS n, round(sum(value), 4) AS total, min(i) AS first_row
    FROM src JOIN spans USING (event_type)
    WHERE i >= window_id * {STRIDE} AND i < window_id * {STRIDE} + {SIZE} GROUP BY 1, 2""",
)
def count_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "value", *EVENT_ORDER)
    tagged = drift.count_windows(events, EVENT_ORDER, ["event_type"])
    return tagged.groupBy("event_type", "window_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("value"), 4).alias("total"),
        F.min("row_idx").alias("first_row"),
    )


@query(
    "drift_score",
    f"""
    WITH {EVENTS_SQL},
    feat AS (SELECT event_type AS g, (ts < TIMESTAMP '2024-01-16') AS base, 0 AS j, value AS v FROM ev
             UNION ALL SELECT event_type, ts < TIMESTAMP '2024-01-16', 1, hour FROM ev
             UNION ALL SELECT event_type, ts < TIMESTAMP '2024-01-16', 2, k FROM ev),
    rng AS (SELECT g, j, min(v) AS lo, max(v) AS hi, COUNT(*) FILTER (base) AS nb, COUNT(*) FILTER (NOT base) AS nw
            FROM feat GROUP BY 1, 2),
    c AS (SELECT g, j, least(floor((v - lo) / (hi - lo) * {BINS}), {BINS - 1}) AS b, lo, hi, nb, nw,
                 COUNT(*) FILTER (base) AS cb, COUNT(*) FILTER (NOT base) AS cw
          FROM feat JOIN rng USING (g, j) WHERE hi > lo GROUP BY 1, 2, 3, 4, 5, 6, 7),
    pq AS (SELECT g, j, (cb / (nb * ((hi - lo) / {BINS})) + 1e-12) / (1 / ((hi - lo) / {BINS}) + {BINS} * 1e-12) AS p,
                  (cw / (nw * ((hi - lo) / {BINS})) + 1e-12) / (1 / ((hi - lo) / {BINS}) + {BINS} * 1e-12) AS q FROM c),
    js AS (SELECT g, j, sum((p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2) AS js FROM pq GROUP BY 1, 2)
    SELECT g AS event_type, round(avg(js), 9) AS js FROM js GROUP BY 1""",
)
def drift_score(spark, sf_dir):
    events = event_features(spark, sf_dir)
    early = F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    got = drift.drift_score(events.filter(early), events.filter(~early), EVENT_FEATURES, ["event_type"])
    return got.withColumn("js", F.round("js", 9))


_RESAMPLES = 200
_STARTS_SQL = f"""SELECT g, id AS k, ('0x' || substr(md5('0|' || id :: VARCHAR), 1, 15)) :: BIGINT % (n - {SIZE} + 1) AS s
    FROM sizes, range({_RESAMPLES}) t(id)"""


@query(
    "drift_calibration",
    f"WITH {drift_sql(SIZE, STRIDE, BINS, False, "'all'", _STARTS_SQL, 's.s')} SELECT unnest(['A', 'B', 'C']) AS tier, "
    "unnest([round(quantile_cont(js :: DOUBLE, 0.9), 9), round(quantile_cont(js :: DOUBLE, 0.95), 9), round(quantile_cont(js :: DOUBLE, 0.99), 9)]) AS threshold FROM scored",
)
def drift_calibration(spark, sf_dir):
    """Thresholds from windows whose starts a hash chooses that SQL has too."""
    digest = F.substring(F.md5(F.concat(F.lit("0|"), F.col("id").cast("string"))), 1, 15)
    found = drift.calibrate_thresholds(
        event_features(spark, sf_dir), EVENT_ORDER, EVENT_FEATURES, resamples=_RESAMPLES, draw=F.conv(digest, 16, 10).cast("bigint")
    )
    return found.withColumn("threshold", F.round("threshold", 9))


DAILY_SQL = """daily AS (
      SELECT o_orderdate AS day, sum(o_totalprice) AS total, COUNT(*) :: DOUBLE AS n FROM orders GROUP BY 1)"""


def daily_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("day")).agg(
        F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).cast("double").alias("n")
    )


def _window_digest(windows, *keys):
    values = F.transform(F.flatten("x"), lambda v: v)
    return windows.select(
        *keys,
        "window_start",
        F.round(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), 4).alias("x_sum"),
        F.round(F.element_at(F.element_at("x", 1), 1), 4).alias("x_first"),
        F.round(F.element_at(F.element_at("x", -1), 1), 4).alias("x_last"),
        "y",
    )


@query(
    "sliding_single",
    f"""
    WITH {DAILY_SQL},
    w AS (SELECT row_number() OVER o - 1 AS window_start,
                 sum(total + n) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS x_sum,
                 total AS x_first, lead(total, 9) OVER o AS x_last, lead(total, 14) OVER o AS y
          FROM daily WINDOW o AS (ORDER BY day))
    SELECT window_start, round(x_sum, 4) AS x_sum, round(x_first, 4) AS x_first, round(x_last, 4) AS x_last,
           round(y, 4) AS y FROM w WHERE y IS NOT NULL""",
)
def sliding_single(spark, sf_dir):
    windows = sequence.sliding_windows(daily_orders(spark, sf_dir), ["day"], ["total", "n"], "total", 10, 5)
    return _window_digest(windows).withColumn("y", F.round("y", 4))


@query(
    "sliding_multi",
    """
    WITH w AS (SELECT user_id, row_number() OVER o - 1 AS window_start,
                      sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS x_sum,
                      value AS x_first, lead(value, 9) OVER o AS x_last, lead(value, 10) OVER o AS y_first,
                      lead(value, 14) OVER o AS y_last,
                      sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 FOLLOWING AND 14 FOLLOWING) AS y_sum
               FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, window_start, round(x_sum, 4) AS x_sum, x_first, x_last, y_first, y_last, round(y_sum, 4) AS y_sum
    FROM w WHERE y_last IS NOT NULL""",
)
def sliding_multi(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    windows = sequence.sliding_windows(
        events, EVENT_ORDER, ["value"], "value", 10, 5, multi_output=True, group=["user_id"]
    )
    digest = _window_digest(windows, "user_id")
    return digest.select(
        "user_id", "window_start", "x_sum", "x_first", "x_last",
        F.element_at("y", 1).alias("y_first"),
        F.element_at("y", -1).alias("y_last"),
        F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v), 4).alias("y_sum"),
    )


@query(
    "sliding_take_last",
    f"""
    WITH {DAILY_SQL},
    w AS (SELECT row_number() OVER o - 1 AS window_start, total AS x_first, lead(total, 14) OVER o AS y
          FROM daily WINDOW o AS (ORDER BY day)),
    f AS (SELECT *, row_number() OVER (ORDER BY window_start DESC) AS back FROM w WHERE y IS NOT NULL)
    SELECT window_start, round(x_first, 4) AS x_first, round(y, 4) AS y FROM f WHERE back <= 400""",
)
def sliding_take_last(spark, sf_dir):
    windows = sequence.sliding_windows(
        daily_orders(spark, sf_dir), ["day"], ["total"], "total", 10, 5, take_last=400
    )
    return _window_digest(windows).select("window_start", "x_first", F.round("y", 4).alias("y"))


@query(
    "last_window",
    """
    WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back,
                      COUNT(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, round(sum(value), 4) AS x_sum, max(value) FILTER (back = 1) AS x_last,
           max(value) FILTER (back = 10) AS x_first
    FROM r WHERE back <= 10 AND n >= 10 GROUP BY 1""",
)
def last_window(spark, sf_dir):
    got = sequence.last_window(table(spark, sf_dir, "events"), EVENT_ORDER, ["value", "absent"], 10, ["user_id"])
    total = F.aggregate(F.flatten("x"), F.lit(0.0), lambda a, v: a + v)
    return got.select(
        "user_id",
        F.round(total, 4).alias("x_sum"),
        F.element_at("x", -1)[0].alias("x_last"),
        F.element_at("x", 1)[0].alias("x_first"),
    )


@query(
    "moving_mean",
    """
    WITH w AS (SELECT event_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mean,
                      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    h AS (SELECT unnest(range(1, 6)) :: INTEGER AS step)
    SELECT event_id, step, round(mean, 6) AS pred FROM w, h WHERE rn >= 10""",
)
def moving_mean(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "value", *EVENT_ORDER)
    got = sequence.moving_mean(events, EVENT_ORDER, "value", 10, 5, ["user_id"])
    return got.select("event_id", F.posexplode("forecast").alias("pos", "pred")).select(
        "event_id", (F.col("pos") + 1).alias("step"), F.round("pred", 6).alias("pred")
    )


@query(
    "cumulative_acc",
    f"""
    WITH {PAIRS_SQL},
    r AS (SELECT *, row_number() OVER (ORDER BY {LINE_ORDER_SQL}) AS total,
                 sum(CASE WHEN abs(p - y) / greatest(abs(y), 1e-8) <= 0.25 THEN 1 ELSE 0 END)
                   OVER (ORDER BY {LINE_ORDER_SQL} ROWS UNBOUNDED PRECEDING) AS correct FROM pairs)
    SELECT l_orderkey, l_linenumber, total, correct :: BIGINT AS correct, round(correct / total, 8) AS cum_acc FROM r""",
)
def cumulative_acc(spark, sf_dir):
    pairs = price_pairs(spark, sf_dir, *LINE_ORDER)
    got = sequence.cumulative_accuracy(pairs, LINE_ORDER, "y", "p")
    return got.select("l_orderkey", "l_linenumber", "total", "correct", F.round("cum_acc", 8).alias("cum_acc"))


COUNTER_SQL = """counter AS (
      SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t,
             sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cpu FROM events)"""


@query(
    "counter_rate",
    f"""
    WITH {COUNTER_SQL},
    d AS (SELECT event_id, t - lag(t) OVER w AS dt, greatest(0.0, cpu - lag(cpu) OVER w) AS dc
          FROM counter WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
    SELECT event_id, round(dc / dt, 6) AS vcpu, round(dc / dt * 100, 4) AS cpu_pct FROM d WHERE dt > 0""",
)
def counter_rate(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", epoch_seconds("ts").alias("t"), "value"
    )
    counter = o.running(events, EVENT_ORDER, ["user_id"], sums={"cpu": F.col("value")}).drop("row_idx")
    got = sequence.counter_rate(counter, "t", "cpu", ["user_id"])
    return got.select("event_id", F.round("vcpu", 6).alias("vcpu"), F.round("cpu_pct", 4).alias("cpu_pct"))


@query(
    "chrono_split",
    """
    WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, COUNT(*) OVER () AS n FROM orders)
    SELECT o_orderkey, (i >= n - greatest(1, floor(n * 0.2))) :: INTEGER AS is_valid FROM r""",
)
def chrono_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    got = o.chronological_split(orders, 0.2, ["o_orderdate", "o_orderkey"])
    return got.select("o_orderkey", F.col("is_valid").cast("int").alias("is_valid"))


@query(
    "hash_split",
    """
    SELECT unnest([1, 0]) AS is_valid,
           unnest([ceil(COUNT(*) * 0.3) :: BIGINT, COUNT(*) - ceil(COUNT(*) * 0.3) :: BIGINT]) AS n FROM orders""",
)
def hash_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    marked = o.hash_split(orders, 0.3, ["o_orderkey"])
    return marked.groupBy(F.col("is_valid").cast("int").alias("is_valid")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "hash_split_rows",
    """
    WITH h AS (SELECT o_orderkey, ('0x' || substr(md5('7|' || o_orderkey :: VARCHAR), 1, 15)) :: BIGINT AS h FROM orders),
    r AS (SELECT o_orderkey, row_number() OVER (ORDER BY h, o_orderkey) AS r, COUNT(*) OVER () AS n FROM h)
    SELECT o_orderkey, (r <= ceil(n * 0.3)) :: INTEGER AS is_valid FROM r""",
)
def hash_split_rows(spark, sf_dir):
    """Which rows a split chooses, by a hash that SQL has too."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    digest = F.substring(F.md5(F.concat(F.lit("7|"), F.col("o_orderkey").cast("string"))), 1, 15)
    marked = o.hash_split(orders, 0.3, ["o_orderkey"], hashes=(F.conv(digest, 16, 10).cast("bigint"), F.col("o_orderkey")))
    return marked.select("o_orderkey", F.col("is_valid").cast("int").alias("is_valid"))


@query(
    "head_tail",
    f"""
    WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY {LINE_ORDER_SQL}) AS a,
                      row_number() OVER (ORDER BY {', '.join(c + ' DESC' for c in LINE_ORDER)}) AS z FROM lineitem)
    SELECT CASE WHEN a <= 500 THEN 'head' ELSE 'tail' END AS part, l_orderkey, l_linenumber, l_extendedprice
    FROM r WHERE a <= 500 OR z <= 1000""",
)
def head_tail(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    head = o.head_rows(lines, 500, LINE_ORDER).select(F.lit("head").alias("part"), "l_orderkey", "l_linenumber", "l_extendedprice")
    tail = o.tail_rows(lines, 1000, LINE_ORDER).select(F.lit("tail").alias("part"), "l_orderkey", "l_linenumber", "l_extendedprice")
    return head.unionByName(tail)


@query(
    "micro_batches",
    f"""
    WITH {PAIRS_SQL},
    b AS (SELECT (row_number() OVER (ORDER BY {LINE_ORDER_SQL}) - 1) // 256 AS batch_id,
                 CASE WHEN abs(p - y) / greatest(abs(y), 1e-8) <= 0.15 THEN 1 ELSE 0 END AS hit FROM pairs)
    SELECT batch_id, COUNT(*) AS n, sum(hit) :: BIGINT AS hits, round(avg(hit), 8) AS hit_rate FROM b GROUP BY 1""",
)
def micro_batches(spark, sf_dir):
    batches = o.micro_batches(price_pairs(spark, sf_dir, *LINE_ORDER), 256, LINE_ORDER)
    got = stats.batch_metrics(batches, "batch_id", "y", "p")
    return got.withColumn("hit_rate", F.round("hit_rate", 8))


def _typed_series(spark, sf_dir, keys):
    events = table(spark, sf_dir, "events").select(*keys, F.col("event_type").alias("name"), "value", *EVENT_ORDER)
    return o.occurrence_index(events, [*keys, "name"], EVENT_ORDER, name="row_idx").select(
        *keys, "name", "row_idx", "value"
    )


def _pivot_sql(keys: str) -> str:
    picks = ", ".join(f"max(value) FILTER (event_type = '{t}') AS {t}" for t in EVENT_TYPES)
    return f"SELECT {keys} row_idx, {picks} FROM r GROUP BY ALL"


@query(
    "occurrence_pivot",
    f"""
    WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS row_idx FROM events)
    {_pivot_sql('')}""",
)
def occurrence_pivot(spark, sf_dir):
    return alignment.pivot_occurrences(_typed_series(spark, sf_dir, []), [], "name", "value", EVENT_TYPES)


PER_USER_SQL = """r AS (SELECT user_id, event_type, value,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS row_idx FROM events)"""


@query(
    "positional_zip_inner",
    f"""
    WITH {PER_USER_SQL},
    n AS (SELECT user_id, event_type, COUNT(*) AS n FROM r GROUP BY 1, 2),
    m AS (SELECT user_id, min(n) AS n FROM n GROUP BY 1),
    p AS ({_pivot_sql('user_id,')})
    SELECT p.* FROM p JOIN m USING (user_id) WHERE row_idx < n""",
)
def positional_zip_inner(spark, sf_dir):
    return alignment.zip_inner(_typed_series(spark, sf_dir, ["user_id"]), ["user_id"], EVENT_TYPES)


@query(
    "positional_left",
    f"""
    WITH {PER_USER_SQL},
    n AS (SELECT user_id, event_type, COUNT(*) AS n FROM r WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
    m AS (SELECT user_id, min(n) AS n FROM n GROUP BY 1),
    p AS ({_pivot_sql('user_id,')})
    SELECT p.* FROM p JOIN m USING (user_id) WHERE row_idx < n""",
)
def positional_left(spark, sf_dir):
    return alignment.zip_left(
        _typed_series(spark, sf_dir, ["user_id"]), ["user_id"], EVENT_TYPES, ["click", "view"]
    )


@query(
    "first_available",
    """
    WITH r AS (SELECT lang, doc_id, source, row_number() OVER (PARTITION BY lang ORDER BY
        CASE source WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END, doc_id) AS rn FROM documents)
    SELECT lang, doc_id, source FROM r WHERE rn = 1""",
)
def first_available(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "source")
    rank = F.when(F.col("source") == "src3", 0).when(F.col("source") == "src1", 1).otherwise(2)
    return alignment.first_available(docs, ["lang"], rank, "doc_id")


@query(
    "asof_score",
    """
    WITH l AS (SELECT * FROM events WHERE event_type <> 'error'),
    r AS (SELECT user_id, ts, value FROM events WHERE event_type = 'error')
    SELECT l.event_id, r.value AS js FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""",
)
def asof_score(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left = events.filter("event_type <> 'error'").select("event_id", "user_id", "ts")
    right = events.filter("event_type = 'error'").select("user_id", "ts", F.col("value").alias("js"))
    return alignment.asof_latest(left, right, "ts", "js", ["user_id"], "event_id").select("event_id", "js")


@query(
    "asof_max_age",
    """
    WITH l AS (SELECT * FROM events WHERE event_type <> 'error'),
    r AS (SELECT ts, value FROM events WHERE event_type = 'error')
    SELECT l.event_id, CASE WHEN epoch_us(l.ts) - epoch_us(r.ts) <= 600000000 THEN r.value END AS js
    FROM l ASOF LEFT JOIN r ON l.ts >= r.ts""",
)
def asof_max_age(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left = events.filter("event_type <> 'error'").select("event_id", "ts")
    right = events.filter("event_type = 'error'").select("ts", F.col("value").alias("js"))
    return alignment.asof_latest(
        left, right, "ts", "js", tie="event_id", max_age=600.0, seconds=epoch_seconds
    ).select("event_id", "js")
