"""Every registered query runs; those with SQL must give the rows DuckDB gives."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def kind(value):
    return "double" if isinstance(value, float) else type(value).__name__


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, sf_dir, duck, name):
    df = contract.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert rows, f"{name} returned no rows"
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    expected = cur.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    spot = [names.index(c) for c in order]
    want = Counter(tuple(canonical(r[i]) for i in spot) for r in expected)
    have = Counter(tuple(canonical(r[c]) for c in order) for r in rows)
    missing, extra = want - have, have - want
    assert not missing and not extra, (
        f"{name}: {sum(missing.values())} of {len(expected)} rows differ, e.g. "
        f"want {sorted(missing, key=str)[:3]} have {sorted(extra, key=str)[:3]}"
    )
    for i, c in enumerate(order):
        a = {kind(r[i]) for r in want if r[i] is not None}
        b = {kind(r[i]) for r in have if r[i] is not None}
        assert a == b, f"{name}.{c}: {a} against {b}"


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["event_type", "window_id", "js", "tier"] and df.count() > 0
