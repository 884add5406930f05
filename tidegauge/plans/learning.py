"""Queries that fit, search, explain and publish models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.models import evaluate, linear, mlp, regressors, retrain, search, trees
from tidegauge.models.network import Network
from tidegauge.operators import grids, sequence
from tidegauge.operators.drift import WINDOW_SIZE, WINDOW_STRIDE, drift_windows
from tidegauge.operators.ordering import chronological_split, hash_split, row_index
from tidegauge.operators.stats import StandardScaler, error_metrics
from tidegauge.plans.catalog import query, table
from tidegauge.plans.frames import (
    EVENT_FEATURES, EVENTS_SQL, LINE_ORDER, LINE_ORDER_SQL, PAIRS_SQL, event_features, price_pairs,
)
from tidegauge.plans.series import DAILY_SQL, daily_orders
from tidegauge.session import spread

EVENT_ORDER = ["ts", "event_id"]
LINE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _coefficients(spark, model):
    rows = [("intercept", float(model.intercept))] + [
        (f"w{i}", float(w)) for i, w in enumerate(model.coefficients)
    ]
    return spark.createDataFrame(rows, "term string, value double").withColumn("value", F.round("value", 4))


@query(
    "linear_fit",
    """
    SELECT 'w0' AS term, round(regr_slope(l_extendedprice, l_quantity), 4) AS value FROM lineitem
    UNION ALL SELECT 'intercept', round(regr_intercept(l_extendedprice, l_quantity), 4) FROM lineitem""",
)
def linear_fit(spark, sf_dir):
    train = regressors.table_frame(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")
    return _coefficients(spark, regressors.fit_linear(train))


@query(
    "ridge_fit",
    """
    WITH s AS (SELECT COUNT(*) AS n, avg(p_size) AS mx, avg(p_retailprice) AS my,
                      covar_pop(p_retailprice, p_size) AS cxy, var_pop(p_size) AS vx FROM part),
    w AS (SELECT cxy * n / (vx * n + 1000.0) AS w, mx, my FROM s)
    SELECT 'w0' AS term, round(w, 4) AS value FROM w UNION ALL SELECT 'intercept', round(my - w * mx, 4) FROM w""",
)
def ridge_fit(spark, sf_dir):
    train = regressors.table_frame(table(spark, sf_dir, "part"), ["p_size"], "p_retailprice")
    return _coefficients(spark, regressors.fit_ridge(train, 1000.0))


@query(
    "ridge_two_features",
    """
    WITH s AS (SELECT COUNT(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my,
                      var_pop(l_quantity) * COUNT(*) + 10.0 AS a, covar_pop(l_quantity, l_discount) * COUNT(*) AS b,
                      var_pop(l_discount) * COUNT(*) + 10.0 AS d, covar_pop(l_quantity, l_extendedprice) * COUNT(*) AS r1,
                      covar_pop(l_discount, l_extendedprice) * COUNT(*) AS r2 FROM lineitem),
    w AS (SELECT (d * r1 - b * r2) / (a * d - b * b) AS w0, (a * r2 - b * r1) / (a * d - b * b) AS w1, m1, m2, my FROM s)
    SELECT 'w0' AS term, round(w0, 4) AS value FROM w UNION ALL SELECT 'w1', round(w1, 4) FROM w
    UNION ALL SELECT 'intercept', round(my - w0 * m1 - w1 * m2, 4) FROM w""",
)
def ridge_two_features(spark, sf_dir):
    train = regressors.table_frame(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return _coefficients(spark, regressors.fit_ridge(train, 10.0))


_PATH_ALPHAS = (1.0, 100.0, 1e4, 1e6, 1e8, 1e10)


def _path_sql(rows: str, y: str) -> str:
    """Closed form of ridge on two features for all penalties; ``rows`` gives step, x1, x2 and y."""
    return f"""
    WITH r AS ({rows}),
    s AS (SELECT step, avg(x1) AS m1, avg(x2) AS m2, avg({y}) AS my, COUNT(*) * var_pop(x1) AS a, COUNT(*) * covar_pop(x1, x2) AS b,
                 COUNT(*) * var_pop(x2) AS d, COUNT(*) * covar_pop(x1, {y}) AS r1, COUNT(*) * covar_pop(x2, {y}) AS r2 FROM r GROUP BY 1),
    p AS (SELECT *, unnest([{', '.join(map(repr, _PATH_ALPHAS))}] :: DOUBLE[]) AS alpha FROM s),
    w AS (SELECT alpha, step, m1, m2, my, ((d + alpha) * r1 - b * r2) / ((a + alpha) * (d + alpha) - b * b) AS w0,
                 ((a + alpha) * r2 - b * r1) / ((a + alpha) * (d + alpha) - b * b) AS w1 FROM p)
    SELECT alpha, step :: INTEGER AS step, 'w0' AS term, round(w0, 4) AS value FROM w UNION ALL SELECT alpha, step :: INTEGER, 'w1', round(w1, 4) FROM w
    UNION ALL SELECT alpha, step :: INTEGER, 'intercept', round(my - w0 * m1 - w1 * m2, 2) FROM w"""


def _rounded_path(rows, x, y):
    found = linear.ridge_path(rows, x, y, _PATH_ALPHAS)
    return found.withColumn("value", F.when(F.col("term") == "intercept", F.round("value", 2)).otherwise(F.round("value", 4)))


@query("ridge_path", _path_sql("SELECT 1 AS step, l_quantity AS x1, l_discount AS x2, l_extendedprice AS y FROM lineitem", "y"))
def ridge_path(spark, sf_dir):
    """Six penalties from one set of sums."""
    return _rounded_path(table(spark, sf_dir, "lineitem"), F.array("l_quantity", "l_discount"), F.array("l_extendedprice"))


@query(
    "forecast_ridge_path",
    _path_sql(
        f"""WITH {DAILY_SQL}, w AS (SELECT total AS x1, n AS x2, [{', '.join(f'lead(total, {h}) OVER o' for h in range(1, 6))}] AS ys
                 FROM daily WINDOW o AS (ORDER BY day))
        SELECT unnest(range(1, 6)) AS step, x1, x2, unnest(ys) AS y FROM w WHERE ys[5] IS NOT NULL""",
        "y",
    ),
)
def forecast_ridge_path(spark, sf_dir):
    """Five forecast steps times six penalties from one set of sums."""
    windows = sequence.sliding_windows(daily_orders(spark, sf_dir), ["day"], ["total", "n"], "total", 1, 5, multi_output=True)
    return _rounded_path(windows, F.flatten("x"), F.col("y"))


def _line_split(spark, sf_dir):
    frame = regressors.table_frame(
        table(spark, sf_dir, "lineitem"), LINE_FEATURES, "l_extendedprice", scale=True, keep=LINE_ORDER
    )
    marked = hash_split(frame, 0.3, LINE_ORDER).select("features", "label", "is_valid")
    marked = spread(marked)
    return marked.filter("not is_valid"), marked.filter("is_valid")


def _fit_report(spark, sf_dir, family, params):
    train, valid = _line_split(spark, sf_dir)
    scored = regressors.fit_family(family, train, params).transform(valid)
    return error_metrics(scored, "label", "prediction", thresholds=(0.05,), eps=1e-8, as_percent=False)


@query("tree_fit")
def tree_fit(spark, sf_dir):
    return _fit_report(spark, sf_dir, "tree", {})


_SPLIT_FEATURES = ["l_quantity", "l_discount", "l_linenumber"]


def _stump_sql(number: int, rows: str, l2: float, l1: float, least: float) -> str:
    """CTEs of the best split of ``rows`` (features c0.. and the label e, counted from its mean)."""
    soft = lambda g: f"(sign({g}) * greatest(abs({g}) - {l1}, 0))"
    score = lambda n, g: f"{soft(g)} * {soft(g)} / ({n} + {l2})"
    union = " UNION ALL ".join(f"SELECT {i} AS f, c{i} AS x, COUNT(*) AS n, SUM(e) AS s FROM {rows} GROUP BY 2" for i in range(len(_SPLIT_FEATURES)))
    return f"""
    g{number} AS ({union}),
    h{number} AS (SELECT f, x, lead(x) OVER w AS nx, SUM(n) OVER w AS ln, SUM(s) OVER w AS ls,
                 SUM(n) OVER (PARTITION BY f) AS tn, SUM(s) OVER (PARTITION BY f) AS ts FROM g{number} WINDOW w AS (PARTITION BY f ORDER BY x)),
    b{number} AS (SELECT f, x, (x + nx) / 2 AS cut, {soft('ls')} / (ln + {l2}) AS lo, {soft('(ts - ls)')} / (tn - ln + {l2}) AS hi FROM h{number}
           WHERE nx IS NOT NULL AND ln >= {least} AND tn - ln >= {least}
           ORDER BY {score('ln', 'ls')} + {score('(tn - ln)', '(ts - ls)')} DESC, f, x LIMIT 1)"""


_SPLIT_ROWS_SQL = f"""SELECT {', '.join(f'{c} :: DOUBLE AS c{i}' for i, c in enumerate(_SPLIT_FEATURES))}, l_extendedprice - m AS e
    FROM lineitem, (SELECT avg(l_extendedprice) AS m FROM lineitem)"""
_SPLIT_SELECT = "SELECT {0} AS tree, f :: INTEGER AS feature, round(cut, 6) AS cut, round(lo, 4) AS left_value, round(hi, 4) AS right_value FROM b{0}"


def _splits(spark, sf_dir, settings):
    frame = regressors.table_frame(table(spark, sf_dir, "lineitem"), _SPLIT_FEATURES, "l_extendedprice")
    nodes = trees.fit_trees(frame, [settings]).nodes()
    value = {(t, i): v for t, i, *_, v in nodes}
    rows = [(t, f, round(c, 6), value[t, left], value[t, left + 1]) for t, _, f, c, left, _ in nodes if f is not None]
    out = spark.createDataFrame(rows, "tree int, feature int, cut double, left_value double, right_value double")
    return out.withColumns({c: F.round(c, 4) for c in ("left_value", "right_value")})


@query("tree_split", f"WITH r0 AS ({_SPLIT_ROWS_SQL}), {_stump_sql(0, 'r0', 0.0, 0.0, 10)} {_SPLIT_SELECT.format(0)}")
def tree_split(spark, sf_dir):
    """The first split of a tree, counted from the mean label."""
    return _splits(spark, sf_dir, regressors.tree(max_depth=1))


_BOOST_RATE, _BOOST_L2, _BOOST_L1 = 0.5, 100.0, 1000.0


@query(
    "boosted_splits",
    f"WITH r0 AS ({_SPLIT_ROWS_SQL}), {_stump_sql(0, 'r0', _BOOST_L2, _BOOST_L1, 1)}, "
    + ", ".join(
        f"""r{k} AS (SELECT r{k - 1}.* REPLACE (e - {_BOOST_RATE} * CASE WHEN CASE f {' '.join(f'WHEN {i} THEN c{i}' for i in range(len(_SPLIT_FEATURES)))} END <= cut
                    THEN lo ELSE hi END AS e) FROM r{k - 1}, b{k - 1}), {_stump_sql(k, f'r{k}', _BOOST_L2, _BOOST_L1, 1)}"""
        for k in (1, 2)
    )
    + " "
    + " UNION ALL ".join(_SPLIT_SELECT.format(k) for k in range(3)),
)
def boosted_splits(spark, sf_dir):
    """Three rounds of boosted trees of one split each, with both leaf penalties."""
    s = trees.Settings("boost", 3, 1, _BOOST_RATE, l2=_BOOST_L2, l1=_BOOST_L1)
    return _splits(spark, sf_dir, s)


@query("forest_fit")
def forest_fit(spark, sf_dir):
    return _fit_report(spark, sf_dir, "forest", {"n_estimators": grids.FOREST_TREES[0]})


@query("gbt_fit")
def gbt_fit(spark, sf_dir):
    return _fit_report(spark, sf_dir, "gbt", {"n_estimators": grids.BOOSTING_TREES[0], "learning_rate": 0.05})


@query("boosted_fit")
def boosted_fit(spark, sf_dir):
    return _fit_report(spark, sf_dir, "xgboost", {"n_estimators": 400, "max_depth": 6})


@query("grid_search")
def grid_search(spark, sf_dir):
    train, valid = _line_split(spark, sf_dir)
    candidates = grids.table_grid() + [("tree", {"max_depth": d}) for d in (4, 6)]
    return search.table_search(train, valid, candidates)


def _daily_windows(spark, sf_dir):
    windows = sequence.sliding_windows(
        daily_orders(spark, sf_dir), ["day"], ["total", "n"], "total", 10, 5, multi_output=True
    )
    marked = spread(chronological_split(windows, 0.2, ["window_start"]))
    return marked.filter("not is_valid"), marked.filter("is_valid")


@query("forecast_search")
def forecast_search(spark, sf_dir):
    train, valid = _daily_windows(spark, sf_dir)
    return search.forecast_search(train, valid, 5, grids.forecast_grid())


@query("forecast")
def forecast(spark, sf_dir):
    train, _ = _daily_windows(spark, sf_dir)
    model = regressors.fit_multi_output(train, 5, "ridge", {"alpha": 1.0})
    return evaluate.publish_forecast(daily_orders(spark, sf_dir), ["day"], ["total", "n"], 10, model)


_ALPHA = 1e12  # of the order of the summed squares of daily totals


@query(
    "forecast_one_feature",
    f"""WITH {DAILY_SQL},
    w AS (SELECT day, total AS x, lead(total, 1) OVER o AS y1, lead(total, 2) OVER o AS y2, lead(total, 3) OVER o AS y3
          FROM daily WINDOW o AS (ORDER BY day)),
    t AS (SELECT * FROM w WHERE y3 IS NOT NULL),
    s AS ("""
    + " UNION ALL ".join(
        f"SELECT {h} AS step, covar_pop(y{h}, x) * COUNT(*) / (var_pop(x) * COUNT(*) + {_ALPHA}) AS b, avg(x) AS mx, avg(y{h}) AS my FROM t"
        for h in (1, 2, 3)
    )
    + """)
    SELECT step :: INTEGER AS step, round(my + b * ((SELECT arg_max(x, day) FROM w) - mx), 2) AS pred FROM s""",
)
def forecast_one_feature(spark, sf_dir):
    """Three steps ahead from the last day alone, one ridge model a step."""
    daily = daily_orders(spark, sf_dir)
    windows = sequence.sliding_windows(daily, ["day"], ["total"], "total", 1, 3, multi_output=True)
    model = regressors.fit_multi_output(windows, 3, "ridge", {"alpha": _ALPHA})
    return evaluate.publish_forecast(daily, ["day"], ["total"], 1, model).withColumn("pred", F.round("pred", 2))


_SHUFFLED = ["l_quantity", "l_discount"]


@query(
    "permutation_importance",
    f"""
    WITH s AS (SELECT avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my,
                      var_pop(l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, var_pop(l_discount) AS d,
                      covar_pop(l_quantity, l_extendedprice) AS r1, covar_pop(l_discount, l_extendedprice) AS r2 FROM lineitem),
    w AS (SELECT (d * r1 - b * r2) / (a * d - b * b) AS w0, (a * r2 - b * r1) / (a * d - b * b) AS w1, m1, m2, my FROM s),
    t AS (SELECT row_number() OVER (ORDER BY md5('0|' || {" || '|' || ".join(f"{c} :: VARCHAR" for c in LINE_ORDER)}), {LINE_ORDER_SQL}) - 1 AS n,
                 COUNT(*) OVER () AS total, l_quantity AS q, l_discount AS d, l_extendedprice AS y FROM lineitem),
    p AS (SELECT t.*, v, o.q AS oq, o.d AS od FROM t, (SELECT unnest(range(6)) AS v) JOIN t o ON o.n = (t.n - v - 1 + t.total) % t.total),
    e AS (SELECT v, avg(abs(my + w0 * (CASE WHEN v < 3 THEN oq ELSE q END - m1) + w1 * (CASE WHEN v < 3 THEN d ELSE od END - m2) - y)) AS mae FROM p, w GROUP BY 1),
    z AS (SELECT avg(abs(my + w0 * (q - m1) + w1 * (d - m2) - y)) AS mae FROM t, w)
    SELECT CASE WHEN v < 3 THEN 'l_quantity' ELSE 'l_discount' END AS feature, round(avg(e.mae - z.mae), 2) AS mae_increase
    FROM e, z GROUP BY 1""",
)
def permutation_importance(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    model = regressors.fit_linear(regressors.table_frame(lines, _SHUFFLED, "l_extendedprice"))
    weights, bias = [float(w) for w in model.coefficients], float(model.intercept)

    def predict(x):
        return sum((x[i] * w for i, w in enumerate(weights)), F.lit(bias))

    vectors = lines.select(
        *LINE_ORDER,
        F.array(*[F.col(c).cast("double") for c in _SHUFFLED]).alias("x"),
        F.col("l_extendedprice").alias("y"),
    )
    found = evaluate.permutation_importance(vectors, LINE_ORDER, _SHUFFLED, "x", "y", predict)
    return found.withColumn("mae_increase", F.round("mae_increase", 2))


@query(
    "slice_accuracy",
    f"""
    WITH {PAIRS_SQL},
    r AS (SELECT y, p, row_number() OVER (ORDER BY {LINE_ORDER_SQL}) AS a,
                 row_number() OVER (ORDER BY {', '.join(c + ' DESC' for c in LINE_ORDER)}) AS z FROM pairs)
    SELECT 'tail' AS part, COUNT(*) AS n,
           round(100 * avg(CASE WHEN abs(p - y) / greatest(abs(y), 1e-6) <= 0.25 THEN 1.0 ELSE 0.0 END), 6) AS acc FROM r WHERE z <= 500
    UNION ALL
    SELECT 'head', COUNT(*), round(100 * avg(CASE WHEN abs(p - y) / greatest(abs(y), 1e-6) <= 0.15 THEN 1.0 ELSE 0.0 END), 6)
    FROM r WHERE a <= 500""",
)
def slice_accuracy(spark, sf_dir):
    pairs = price_pairs(spark, sf_dir, *LINE_ORDER)
    parts = [
        evaluate.slice_accuracy(pairs, LINE_ORDER, take, 500, "y", "p", t).select(F.lit(take).alias("part"), "n", F.round("acc", 6).alias("acc"))
        for take, t in (("tail", 0.25), ("head", 0.15))
    ]
    return parts[0].unionByName(parts[1])


def _scaled_events(spark, sf_dir):
    events = event_features(spark, sf_dir)
    scaler = StandardScaler.fit(events, ["hour", "k"])
    return events.select("event_id", "event_type", *EVENT_ORDER[:1], evaluate.scaled_vector(scaler).alias("x"), F.col("value").alias("y"))


@query("mlp_fit")
def mlp_fit(spark, sf_dir):
    rows = spread(hash_split(_scaled_events(spark, sf_dir), 0.3, ["event_id"]))
    net, history = mlp.fit_mlp(
        rows.filter("not is_valid").select("x", "y"), rows.filter("is_valid").select("x", "y"), 2, (64, 32), epochs=100, batch_size=16
    )
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(history)], "epoch int, mse double")


_PAIR = [Network.create(2, (), seed=s) for s in (0, 1)]
_PAIR_SQL = [f"({a!r} * h + {b!r} * k + {c!r})" for a, b, c in (map(float, net.params) for net in _PAIR)]


@query(
    "score_pair",
    f"""WITH {EVENTS_SQL},
    s AS (SELECT avg(hour) AS mh, stddev_pop(hour) AS sh, avg(k) AS mk, stddev_pop(k) AS sk FROM ev),
    x AS (SELECT event_type, value AS y, (hour - mh) / sh AS h, (k - mk) / sk AS k FROM ev, s)
    SELECT event_type, COUNT(*) AS n, round(avg(abs({_PAIR_SQL[0]} - y)), 6) AS mae_orig,
           round(avg(abs({_PAIR_SQL[1]} - y)), 6) AS mae_adj FROM x GROUP BY 1""",
)
def score_pair(spark, sf_dir):
    """Two networks without a hidden layer, whose predictions SQL can repeat."""
    scored = evaluate.score_pair(_scaled_events(spark, sf_dir), "x", *_PAIR)
    return scored.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.abs(F.col("pred_orig") - F.col("y"))), 6).alias("mae_orig"),
        F.round(F.avg(F.abs(F.col("pred_adj") - F.col("y"))), 6).alias("mae_adj"),
    )


@query("drift_retrain")
def drift_retrain(spark, sf_dir):
    """Retrain on the window of the whole series that drifted most."""
    events = event_features(spark, sf_dir)
    scored = drift_windows(events, EVENT_ORDER, EVENT_FEATURES)
    worst = scored.orderBy(F.desc("js"), "window_id").limit(1).first()
    first = worst.window_id * WINDOW_STRIDE
    window = row_index(_scaled_events(spark, sf_dir), EVENT_ORDER).filter(F.col("row_idx").between(first, first + WINDOW_SIZE - 1))
    base = Network.create(2, (64, 32), seed=0)
    result = retrain.two_stage_search(window, ["event_id"], worst.tier or "A", baseline=base, current=base)
    return result.drop("network")
