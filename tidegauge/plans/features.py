"""Queries over row-level features, statistics and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import scalars as s
from tidegauge.operators import histogram as h
from tidegauge.operators import schema, stats
from tidegauge.operators.ordering import rank_candidates, row_index
from tidegauge.plans.catalog import query, table
from tidegauge.plans.frames import EVENTS_SQL, NUMBER_SQL, PAIRS_SQL, event_features, price_pairs

LINE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "null_token_clean",
    rf"""
    SELECT page_id, TRY_CAST(regexp_extract(url, '{NUMBER_SQL}', 0) AS DOUBLE) AS first_number,
           NULLIF(regexp_extract(url, 'page=(\d+)', 1), '') AS page_param
    FROM pages""",
)
def null_token_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        s.first_number("url").alias("first_number"),
        s.clean_token(F.regexp_extract("url", r"page=(\d+)", 1)).alias("page_param"),
    )


@query(
    "numeric_coerce",
    rf"""
    SELECT event_id, TRY_CAST(replace(props, '{{"k": ', '') AS DOUBLE) AS broken,
           TRY_CAST(regexp_extract(props, '{NUMBER_SQL}', 0) AS DOUBLE) AS k
    FROM events""",
)
def numeric_coerce(spark, sf_dir):
    texts = table(spark, sf_dir, "events").select(
        "event_id",
        F.replace("props", F.lit('{"k": '), F.lit("")).alias("broken"),
        F.regexp_extract("props", NUMBER_SQL, 0).alias("k"),
    )
    return schema.to_numeric(texts, ["broken", "k"])


@query(
    "json_decode",
    """
    SELECT event_id, COALESCE(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS f_k,
           0.0 :: DOUBLE AS f_absent
    FROM events""",
)
def json_decode(spark, sf_dir):
    vec = s.feature_vector(F.from_json("props", "map<string,double>"), ["k", "absent"])
    return (
        table(spark, sf_dir, "events")
        .select("event_id", vec.alias("x"))
        .select("event_id", F.col("x")[0].alias("f_k"), F.col("x")[1].alias("f_absent"))
    )


@query(
    "kv_payload",
    """
    SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS picked,
           COALESCE(TRY_CAST(json_extract_string(props, '$.acc') AS DOUBLE), 0.0) AS defaulted
    FROM events""",
)
def kv_payload(spark, sf_dir):
    kv = s.parse_kv("props")
    return table(spark, sf_dir, "events").select(
        "event_id",
        s.pick_metric(kv, ["absent", "k"]).alias("picked"),
        s.pick_metric(kv, s.accuracy_keys(0.25)).alias("defaulted"),
    )


@query(
    "schema_align",
    f"""
    WITH {EVENTS_SQL}
    SELECT event_id, COALESCE(k, 0.0) AS k, 0.0 :: DOUBLE AS absent, hour, value
    FROM ev WHERE value IS NOT NULL""",
)
def schema_align(spark, sf_dir):
    return schema.align_schema(
        event_features(spark, sf_dir), ["k", "absent", "hour"], "value", keep=["event_id"]
    )


@query(
    "drop_any_null",
    """
    SELECT d.doc_id, quality, toxic, n_chars
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    WHERE quality IS NOT NULL AND toxic IS NOT NULL AND n_chars IS NOT NULL""",
)
def drop_any_null(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return schema.drop_any_null(docs.join(table(spark, sf_dir, "labels"), "doc_id", "left"))


@query(
    "numeric_discovery",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {i} :: INTEGER AS position, "
        f"COUNT(TRY_CAST({c} AS DOUBLE)) AS numeric_count FROM part"
        for i, c in enumerate(["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])
    ),
)
def numeric_discovery(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    texts = part.select(*[F.col(c).cast("string").alias(c) for c in part.columns])
    return schema.numeric_counts(texts)


@query(
    "schema_audit",
    """
    WITH have AS (SELECT DISTINCT user_id, event_type FROM events),
    expected AS (SELECT unnest(['click', 'error', 'refund', 'view']) AS name),
    n AS (SELECT user_id, COUNT(*) AS cols, list(event_type ORDER BY event_type) AS names,
                 COUNT(*) FILTER (event_type NOT IN ('click', 'error', 'refund', 'view')) AS extra_n
          FROM have GROUP BY 1)
    SELECT user_id, cols :: INTEGER AS cols,
           (4 - (cols - extra_n)) :: INTEGER AS missing_n, extra_n :: INTEGER AS extra_n,
           array_to_string(list_filter(['click', 'error', 'refund', 'view'], lambda x: NOT list_contains(names, x)), ',') AS missing,
           array_to_string(list_filter(names, lambda x: NOT list_contains(['click', 'error', 'refund', 'view'], x)), ',') AS extra
    FROM n""",
)
def schema_audit(spark, sf_dir):
    names = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    audit = schema.schema_audit(names, ["click", "error", "refund", "view"], "user_id", "event_type")
    lists = [F.array_join(c, ",").alias(c) for c in ("missing", "extra")]
    return audit.select("user_id", "cols", "missing_n", "extra_n", *lists)


@query(
    "align_dim",
    """
    SELECT vec_id, round(list_sum(embedding[1:8] :: DOUBLE[]), 6) AS head_sum,
           round(list_sum(embedding :: DOUBLE[]), 5) AS padded_sum,
           512 :: INTEGER AS padded_dim
    FROM embeddings""",
)
def align_dim(spark, sf_dir):
    def total(dim):
        return F.aggregate(s.align_dim(vec, dim), F.lit(0.0), lambda a, x: a + x)

    vec = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.round(total(8), 6).alias("head_sum"),
        F.round(total(512), 5).alias("padded_sum"),
        F.size(s.align_dim(vec, 512)).alias("padded_dim"),
    )


@query(
    "sentinel_flags",
    """
    SELECT event_id, (event_type = 'error' OR CAST(json_extract_string(props, '$.k') AS INTEGER) <> 0)
           :: INTEGER AS flagged
    FROM events""",
)
def sentinel_flags(spark, sf_dir):
    value = F.when(F.col("event_type") == "error", "__EOF__").otherwise(F.col("props"))
    flag = s.is_sentinel(value, json_flags=("k",))
    return table(spark, sf_dir, "events").select("event_id", flag.cast("int").alias("flagged"))


@query(
    "canonical_models",
    """
    WITH named AS (
      SELECT CASE p_type WHEN 'ECONOMY' THEN 'ridge' WHEN 'SMALL' THEN 'ridge'
                         WHEN 'LARGE' THEN 'boosted' WHEN 'PROMO' THEN 'mlp' END AS family, p_partkey
      FROM part)
    SELECT family, MIN(p_partkey) AS first_rank, COUNT(*) AS n FROM named
    WHERE family IS NOT NULL GROUP BY 1""",
)
def canonical_models(spark, sf_dir):
    aliases = {"economy": "ridge", "small": "ridge", "large": "boosted", "promo": "mlp"}
    named = table(spark, sf_dir, "part").select(
        s.canonical_model("p_type", aliases).alias("family"), "p_partkey"
    )
    return named.filter("family is not null").groupBy("family").agg(
        F.min("p_partkey").alias("first_rank"), F.count(F.lit(1)).alias("n")
    )


_SPELLINGS = (
    "Ridge", " XGBoost ", "xgb", "XGBRegressor", "TransformerLight1D", "transformerlight", "Transformer", "RandomForest",
    "random_forest", "RF", "GradientBoosting", "gbrt", "GBDT", "LSTM", "svr", "",
)


@query(
    "canonical_names",
    f"""
    WITH n AS (SELECT p_partkey, lower(trim([{', '.join(f"'{x}'" for x in _SPELLINGS)}][(p_partkey % {len(_SPELLINGS)} + 1) :: INT])) AS name FROM part),
    f AS (SELECT p_partkey, CASE WHEN name = 'ridge' THEN 'ridge' WHEN name LIKE 'transformer%' THEN 'transformerlight'
                 WHEN name LIKE 'xgb%' OR name LIKE 'g%b%t%' OR name LIKE 'gradient%' OR name LIKE '%forest' OR name = 'rf' THEN 'xgboost' END AS family FROM n)
    SELECT family, COUNT(*) AS n, min(p_partkey) AS first_rank FROM f GROUP BY 1""",
)
def canonical_names(spark, sf_dir):
    """The shipped map of model names, over all its spellings and some unknown ones."""
    spelled = F.array(*[F.lit(x) for x in _SPELLINGS])
    named = table(spark, sf_dir, "part").select(spelled[(F.col("p_partkey") % len(_SPELLINGS)).cast("int")].alias("name"), "p_partkey")
    families = named.select(s.canonical_model("name").alias("family"), "p_partkey")
    return families.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_rank"))


@query(
    "natural_sort",
    r"""
    SELECT source, row_number() OVER (ORDER BY regexp_extract(source, '^\D*', 0),
           CAST(regexp_extract(source, '\d+', 0) AS BIGINT)) AS position
    FROM (SELECT DISTINCT source FROM documents)""",
)
def natural_sort(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select("source").distinct()
    keyed = names.withColumn("_key", s.natural_sort_key("source"))
    return row_index(keyed, ["_key"]).select(
        "source", (F.col("row_idx") + 1).alias("position")
    )


@query(
    "corr_topk",
    "WITH c AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {i} AS position, COALESCE(abs(corr({c}, l_extendedprice)), 0.0) AS a FROM lineitem"
        for i, c in enumerate(LINE_FEATURES)
    )
    + """), r AS (SELECT *, row_number() OVER (ORDER BY a DESC, position) AS rn FROM c)
    SELECT feature, position :: INTEGER AS position, round(a, 8) AS abs_corr FROM r WHERE rn <= 3""",
)
def corr_topk(spark, sf_dir):
    top = stats.corr_topk(table(spark, sf_dir, "lineitem"), LINE_FEATURES, "l_extendedprice", 3)
    return top.withColumn("abs_corr", F.round("abs_corr", 8))


@query(
    "standardize",
    f"""
    WITH m AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq,
                      avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - mq) / sq, 6) AS l_quantity,
           round((l_extendedprice - mp) / sp, 6) AS l_extendedprice
    FROM lineitem, m""",
)
def standardize(spark, sf_dir):
    cols = ["l_quantity", "l_extendedprice"]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *cols)
    return stats.standardize(lines, cols).withColumns({c: F.round(c, 6) for c in cols})


@query(
    "scale_without_mean",
    """
    WITH m AS (SELECT stddev_pop(p_size) AS s FROM part)
    SELECT p_partkey, round(p_size / s, 6) AS p_size FROM part, m""",
)
def scale_without_mean(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return stats.standardize(part, ["p_size"], with_mean=False).withColumn("p_size", F.round("p_size", 6))


@query(
    "error_metrics",
    f"""
    WITH {PAIRS_SQL}
    SELECT l_returnflag, COUNT(*) AS n, round(avg(abs(p - y)), 4) AS mae,
           round(sqrt(avg((p - y) * (p - y))), 4) AS rmse,
           round(1 - sum((p - y) * (p - y)) / (var_pop(y) * COUNT(*)), 6) AS r2,
           round(100 * avg(CASE WHEN abs(p - y) / greatest(abs(y), 1e-6) <= 0.25 THEN 1.0 ELSE 0.0 END), 6) AS acc_25,
           round(100 * avg(CASE WHEN abs(p - y) / greatest(abs(y), 1e-6) <= 0.15 THEN 1.0 ELSE 0.0 END), 6) AS acc_15
    FROM pairs GROUP BY 1""",
)
def error_metrics(spark, sf_dir):
    got = stats.error_metrics(price_pairs(spark, sf_dir, "l_returnflag"), "y", "p", ["l_returnflag"])
    return got.select(
        "l_returnflag", "n",
        *[F.round(c, 4).alias(c) for c in ("mae", "rmse")],
        *[F.round(c, 6).alias(c) for c in ("r2", "acc_25", "acc_15")],
    )


@query(
    "accuracy_absolute",
    f"""
    WITH {PAIRS_SQL}
    SELECT l_linestatus, round(avg(CASE WHEN abs(p - y) <= 500.0 THEN 1.0 ELSE 0.0 END), 8) AS acc
    FROM pairs GROUP BY 1""",
)
def accuracy_absolute(spark, sf_dir):
    acc = stats.accuracy_within("y", "p", 500.0, mode="absolute", as_percent=False)
    pairs = price_pairs(spark, sf_dir, "l_linestatus")
    return pairs.groupBy("l_linestatus").agg(F.round(acc, 8).alias("acc"))


@query(
    "error_quantiles",
    f"""
    WITH {PAIRS_SQL},
    q AS (SELECT unnest([0.5, 0.8, 0.9, 0.95, 0.99]) :: DOUBLE AS q),
    e AS (SELECT l_returnflag, abs(p - y) / greatest(abs(y), 1e-8) AS err FROM pairs),
    v AS (SELECT l_returnflag, list_sort(list(err)) AS errs, COUNT(*) - 1 AS top FROM e GROUP BY 1)
    SELECT l_returnflag, q, round(
      errs[CAST(floor(top * q) AS BIGINT) + 1] * (1 - (top * q - floor(top * q)))
      + errs[CAST(ceil(top * q) AS BIGINT) + 1] * (top * q - floor(top * q)), 6) AS value
    FROM v, q""",
)
def error_quantiles(spark, sf_dir):
    pairs = price_pairs(spark, sf_dir, "l_returnflag")
    got = stats.error_quantiles(pairs, "y", "p", ["l_returnflag"])
    return got.withColumn("value", F.round("value", 6))


@query(
    "median_abs",
    """SELECT event_type, round(quantile_cont(abs(value), 0.5), 6) AS median_abs FROM events GROUP BY 1""",
)
def median_abs(spark, sf_dir):
    got = stats.median_abs(table(spark, sf_dir, "events"), "value", ["event_type"])
    return got.withColumn("median_abs", F.round("median_abs", 6))


@query(
    "hist",
    """
    WITH r AS (SELECT 0.0 :: DOUBLE AS lo, 0.1 :: DOUBLE AS hi)
    SELECT l_returnflag, least(floor((l_discount - lo) / (hi - lo) * 10), 9) :: INTEGER AS bin, COUNT(*) AS n
    FROM lineitem, r WHERE l_discount BETWEEN lo AND hi GROUP BY 1, 2""",
)
def hist(spark, sf_dir):
    return h.histogram(table(spark, sf_dir, "lineitem"), "l_discount", 10, 0.0, 0.1, ["l_returnflag"])


@query(
    "relerr_hist",
    f"""
    WITH {PAIRS_SQL},
    e AS (SELECT abs(p - y) / greatest(abs(y), 1e-8) AS err FROM pairs),
    r AS (SELECT min(err) AS lo, max(err) AS hi FROM e)
    SELECT least(floor((err - lo) / (hi - lo) * 50), 49) :: INTEGER AS bin, COUNT(*) AS n
    FROM e, r GROUP BY 1""",
)
def relerr_hist(spark, sf_dir):
    errors = price_pairs(spark, sf_dir).select(s.relative_error("p", "y").alias("err"))
    return h.histogram(errors, "err", 50)


PROB_SQL = """r AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
    bins AS (SELECT unnest(range(64)) :: INTEGER AS bin),
    b AS (SELECT event_type, least(floor((value - lo) / (hi - lo) * 64), 63) :: INTEGER AS bin FROM events, r),
    types AS (SELECT DISTINCT event_type FROM events),
    ph AS (SELECT t.event_type, bins.bin, COUNT(b.bin) / SUM(COUNT(b.bin)) OVER (PARTITION BY t.event_type) AS p
           FROM types t CROSS JOIN bins LEFT JOIN b ON b.event_type = t.event_type AND b.bin = bins.bin
           GROUP BY 1, 2),
    qh AS (SELECT bins.bin, COUNT(b.bin) / SUM(COUNT(b.bin)) OVER () AS q
           FROM bins LEFT JOIN b ON b.bin = bins.bin GROUP BY 1)"""


def _type_histograms(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "value")
    ends = events.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    per_type = h.prob_hist(events, "value", 64, ends.lo, ends.hi, ["event_type"])
    return per_type, h.prob_hist(events, "value", 64, ends.lo, ends.hi)


@query(
    "prob_hist",
    f"WITH {PROB_SQL} SELECT event_type, bin, round(p, 9) AS p FROM ph",
)
def prob_hist(spark, sf_dir):
    per_type, _ = _type_histograms(spark, sf_dir)
    return per_type.withColumn("p", F.round("p", 9))


CLIP = "greatest(least({0}, 1.0), 1e-12)"


def _kl_sql(a, b):
    a, b = CLIP.format(a), CLIP.format(b)
    return f"sum({a} * (ln({a}) - ln({b})))"


@query(
    "kl",
    f"WITH {PROB_SQL} SELECT event_type, round({_kl_sql('p', 'q')}, 9) AS kl "
    "FROM ph JOIN qh USING (bin) GROUP BY 1",
)
def kl(spark, sf_dir):
    got = h.compare_histograms(*_type_histograms(spark, sf_dir), ["event_type"])
    return got.select("event_type", F.round("kl", 9).alias("kl"))


@query(
    "js_div",
    f"WITH {PROB_SQL} SELECT event_type, "
    f"round(({_kl_sql('p', '(p + q) / 2')} + {_kl_sql('q', '(p + q) / 2')}) / 2, 9) AS js "
    "FROM ph JOIN qh USING (bin) GROUP BY 1",
)
def js_div(spark, sf_dir):
    got = h.compare_histograms(*_type_histograms(spark, sf_dir), ["event_type"])
    return got.select("event_type", F.round("js", 9).alias("js"))


@query(
    "merge_modal",
    """
    WITH sig AS (SELECT event_type, length(props) AS signature FROM events),
    n AS (SELECT event_type, signature, COUNT(*) AS n FROM sig GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, signature) AS rn FROM n)
    SELECT event_type, signature :: INTEGER AS signature, n FROM r WHERE rn = 1""",
)
def merge_modal(spark, sf_dir):
    signatures = table(spark, sf_dir, "events").select("event_type", F.length("props").alias("signature"))
    return stats.modal_value(signatures, "signature", ["event_type"])


@query(
    "label_coverage",
    """
    SELECT lang, COUNT(*) AS n_rows, COUNT(quality) AS labelled
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""",
)
def label_coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return stats.label_coverage(joined, "quality", ["lang"])


@query(
    "forecast_metrics",
    f"""
    WITH {PAIRS_SQL}
    SELECT l_linestatus, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * COUNT(*)), 6) AS r2,
           round(avg(abs(p - y)), 4) AS mae,
           round(avg(CASE WHEN abs(p - y) / greatest(abs(y), 1e-8) <= 0.15 THEN 1.0 ELSE 0.0 END), 8) AS acc_15
    FROM pairs GROUP BY 1""",
)
def forecast_metrics(spark, sf_dir):
    steps = price_pairs(spark, sf_dir, "l_linestatus").select(
        "l_linestatus", F.array("y", F.lit(0.0)).alias("y"), F.array("p", F.lit(1.0)).alias("p")
    )
    got = stats.forecast_metrics(steps, "y", "p", ["l_linestatus"])
    return got.select(
        "l_linestatus", F.round("r2", 6).alias("r2"), F.round("mae", 4).alias("mae"), F.round("acc_15", 8).alias("acc_15")
    )


@query(
    "rank_topk",
    """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS rank FROM supplier)
    SELECT s_nationkey, s_suppkey, s_acctbal, rank :: INTEGER AS rank FROM r WHERE rank <= 3""",
)
def rank_topk(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return rank_candidates(suppliers, ["s_acctbal", "s_suppkey"], 3, ["s_nationkey"])


@query(
    "rank_all",
    """
    WITH j AS (SELECT d.doc_id, quality, n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT doc_id, row_number() OVER (ORDER BY quality ASC NULLS LAST, n_chars ASC NULLS LAST, doc_id) :: INTEGER AS rank
    FROM j""",
)
def rank_all(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    joined = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rank_candidates(joined, ["quality", "n_chars", "doc_id"]).select("doc_id", "rank")
