"""Both ways of ordering rows (plain windows, range partitions with blocks) must agree."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import ordering as o


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(7)
    n = 1200
    # One group holds a third of the rows, one has a null name.
    names = np.where(rng.random(n) < 0.34, "hot", rng.choice(["a", "b", "c", "d"], n)).astype(object)
    names[:5] = None
    pdf = pd.DataFrame({"g": names, "k": rng.permutation(n), "v": rng.normal(size=n).round(4)})
    return spark.createDataFrame(pdf).repartition(5), pdf


def expected_index(pdf, group):
    ordered = pdf.sort_values("k")
    if group:
        return ordered.groupby("g", dropna=False).cumcount()
    return pd.Series(range(len(ordered)), index=ordered.index)


@pytest.mark.parametrize("group", [[], ["g"]])
@pytest.mark.parametrize("max_rows", [10, 10_000])
@pytest.mark.parametrize("partitions", ["1", "4", "17"])
def test_row_index(spark, series, group, max_rows, partitions):
    df, pdf = series
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = o.row_index(df, ["k"], group, max_rows=max_rows).toPandas().set_index("k")["row_idx"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = pdf.assign(i=expected_index(pdf, group)).set_index("k")["i"]
    assert (got.sort_index() == want.sort_index()).all()


@pytest.mark.parametrize("group", [[], ["g"]])
def test_frames_over_blocks(series, group):
    df, _ = series

    def lagged(max_rows):
        rows = o.ordered_rows(df, ["k"], group, before=3, after=2, max_rows=max_rows)
        out = rows.rows.select(
            "*",
            F.lag("v", 3).over(rows.window).alias("back"),
            F.lead("v", 2).over(rows.window).alias("ahead"),
            F.avg("v").over(rows.window.rowsBetween(-2, 0)).alias("mean"),
        )
        return rows.finish(out).orderBy("k").toPandas()

    pd.testing.assert_frame_equal(lagged(10_000), lagged(17), check_like=True)


@pytest.mark.parametrize("group", [[], ["g"]])
def test_running(series, group):
    df, _ = series

    def run(max_rows):
        out = o.running(
            df, ["k"], group,
            sums={"hits": F.when(F.col("v") > 0, 1).otherwise(0)},
            lasts={"seen": F.when(F.col("v") > 1, F.col("k"))},
            max_rows=max_rows,
        )
        return out.orderBy("k").toPandas()

    small, split = run(10_000), run(19)
    pd.testing.assert_frame_equal(small, split, check_like=True)
    if not group:
        assert small["hits"].iloc[-1] == (small["v"] > 0).sum()


@pytest.mark.parametrize("max_rows", [10, 10_000])
def test_exact_quantiles(series, max_rows):
    df, pdf = series
    qs = [0.0, 0.5, 0.8, 0.95, 1.0]
    got = o.exact_quantiles(df, "v", qs, ["g"], max_rows=max_rows).toPandas()
    assert len(got) == 5 * 6
    for row in got.itertuples():
        part = pdf[pdf.g.isna()] if row.g is None else pdf[pdf.g == row.g]
        assert math.isclose(row.value, np.quantile(part.v, row.q), rel_tol=1e-9, abs_tol=1e-12)


def test_no_single_partition_exchange_when_split(series):
    df, _ = series
    indexed = o.row_index(df, ["k"], max_rows=10)
    plan = indexed._jdf.queryExecution().optimizedPlan().toString()
    # The only un-partitioned window runs over one row per range partition.
    assert plan.count("Window [") == 1 and "sum(_size" in plan


@pytest.mark.parametrize("max_rows", [10, 10_000])
def test_head_tail_split(series, max_rows):
    df, pdf = series
    ordered = pdf.sort_values("k")
    assert sorted(r.k for r in o.head_rows(df, 7, ["k"]).collect()) == list(ordered.k[:7])
    assert sorted(r.k for r in o.tail_rows(df, 7, ["k"]).collect()) == list(ordered.k[-7:])
    marked = o.chronological_split(df, 0.3, ["k"], max_rows=max_rows).filter("is_valid")
    assert sorted(r.k for r in marked.collect()) == list(ordered.k[-360:])
    grouped = o.chronological_split(df, 0.1, ["k"], ["g"], max_rows=max_rows).filter("is_valid")
    counts = {r["g"]: r["count"] for r in grouped.groupBy("g").count().collect()}
    for name, n in pdf.g.value_counts(dropna=False).items():
        assert counts[None if name is None or name != name else name] == max(1, int(n * 0.1))
    hashed = [
        {r.k for r in o.hash_split(d, 0.3, ["k"], 0).filter("is_valid").collect()}
        for d in (df, df.repartition(3))
    ]
    assert len(hashed[0]) == 360 and hashed[0] == hashed[1]
    assert o.hash_split(df.limit(1), 0.2, ["k"], round_up=False).filter("is_valid").count() == 1
    assert o.hash_split(df, 1.0, ["k"]).filter("is_valid").count() == 1200


@pytest.mark.parametrize("k", [None, 3, 1001])
def test_rank(series, k):
    df, pdf = series
    got = o.rank_candidates(df, ["v", "k"], k=k, group=["g"]).toPandas()
    want = pdf.sort_values(["v", "k"])
    want["rank"] = want.groupby("g", dropna=False).cumcount() + 1
    want = want if k is None else want[want["rank"] <= k]
    assert dict(zip(got.k, got["rank"])) == dict(zip(want.k, want["rank"]))
