"""Versions from several writers, parts that cannot be read, topics without a broker, streams joined as of a time."""

import datetime as dt
import gzip
import threading

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import alignment, commits
from tidegauge.sources import parts
from tidegauge.streaming import asof, topic_log

ENTRY = "model string, weight double"


def test_two_writers_never_lose_or_double_a_version(spark, tmp_path):
    path, got = str(tmp_path / "log"), {}

    def work(who):
        got[who] = [commits.publish(spark.createDataFrame([(f"{who}{i}", float(i))], ENTRY), path) for i in range(5)]

    threads = [threading.Thread(target=work, args=(w,)) for w in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got["a"] + got["b"]) == list(range(1, 11)) and got["a"] == sorted(got["a"])
    rows = commits.read_versions(spark, path, ENTRY).collect()
    assert sorted((r.version, r.model) for r in rows) == sorted((v, f"{w}{i}") for w in "ab" for i, v in enumerate(got[w]))
    newest = commits.latest(spark, path, ENTRY).first()
    assert (newest.version, newest.model) in {(10, "a4"), (10, "b4")}


def test_work_is_published_once_and_unfinished_work_is_not_seen(spark, tmp_path):
    path, entry = str(tmp_path / "log"), spark.createDataFrame([("m", 1.0)], ENTRY)
    assert commits.read_versions(spark, path, ENTRY).count() == 0 and commits.latest(spark, path, ENTRY).count() == 0
    assert [commits.publish(entry, path, "x"), commits.publish(entry, path, "x"), commits.publish(entry, path, "y")] == [1, 1, 2]
    entry.write.parquet(f"{path}/rows/commit=lost")
    assert commits.read_versions(spark, path, ENTRY).count() == 2
    assert not commits.create_if_absent(spark, f"{path}/commits/{2:020d}.json", "{}")


def test_parts_are_decoded_and_filled(spark, tmp_path):
    good = {
        "a.csv": "x,y\n1,\"a, b\"\n2\n\n".encode(),
        "b.csv": "x,z\n5,café\n".encode("latin-1"),
        "c.csv.gz": gzip.compress("z\n <not counted> \n7\n".encode()),
    }
    bad = {"d.csv": b"", "e.csv": b"x,x\n1,2\n", "f.csv": b'x\n"open', "g.csv.gz": b"nothing", "h.csv": b"x\n1,2\n", "i.csv": b"x\n\x00"}
    for name, content in (good | bad).items():
        (tmp_path / name).write_bytes(content)
    read = parts.read_parts(spark, str(tmp_path))
    status = {r.path.rsplit("/", 1)[1]: (r.n_rows, r.reason) for r in read.status.collect()}
    assert {k: v[0] for k, v in status.items() if v[1] is None} == {"a.csv": 2, "b.csv": 1, "c.csv.gz": 2}
    assert {k: v[1] for k, v in status.items() if v[1]} == {
        "d.csv": "empty", "e.csv": "unusable header", "f.csv": "broken quotes", "g.csv.gz": "damaged archive",
        "h.csv": "more cells than names", "i.csv": "not text",
    }
    rows = sorted((r.path.rsplit("/", 1)[1], r.row_idx, r.x, r.y, r.z) for r in read.rows.fillna("-").collect())
    assert rows == [("a.csv", 0, "1", "a, b", "-"), ("a.csv", 1, "2", "-", "-"), ("b.csv", 0, "5", "-", "café"), ("c.csv.gz", 0, "-", "-", "-"), ("c.csv.gz", 1, "-", "-", "7")]
    with pytest.raises(ValueError, match="different columns"):
        parts.read_parts(spark, str(tmp_path), max_columns=2)
    for name in good:
        (tmp_path / name).write_bytes(b"")
    with pytest.raises(ValueError, match="no readable part"):
        parts.read_parts(spark, str(tmp_path))


def at(i):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=i)


def read_all(spark, path, name, folder, **options):
    seen = []
    query = topic_log.read_topic_log(spark, path, **options).writeStream.foreachBatch(
        lambda batch, i: seen.append((i, sorted((r.partition, r.offset, bytes(r.value)) for r in batch.collect())))
    )
    query = query.option("checkpointLocation", f"{folder}/{name}").trigger(processingTime="100 milliseconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return seen


def test_topic_from_the_earliest_with_a_bound_and_a_restart(spark, tmp_path):
    path = f"file://{tmp_path}/topic"
    want = []
    for p, n in ((0, 25), (1, 4), (2, 11)):
        for a in range(0, n, 10):
            first = topic_log.append(path, p, [(None, f"{p}-{i}".encode(), at(i), [("run_id", b"r")]) for i in range(a, min(n, a + 10))])
            assert first == a
        want += [(p, i, f"{p}-{i}".encode()) for i in range(n)]
    options = {"starting": "earliest", "max_offsets": 9, "progress": f"file://{tmp_path}/progress"}
    seen = read_all(spark, path, "bounded", tmp_path, **options)
    assert sorted(r for _, rows in seen for r in rows) == sorted(want) and max(len(rows) for _, rows in seen) <= 9
    topic_log.append(path, 1, [(b"k", b"more", at(9), [])] * 3)
    again = read_all(spark, path, "bounded", tmp_path, **options)
    assert [r for _, rows in again for r in rows] == [(1, 4 + i, b"more") for i in range(3)]
    assert again[0][0] == seen[-1][0] + 1
    with pytest.raises(ValueError):
        topic_log.TopicReader({"path": path, "maxoffsetspertrigger": "5"})


def test_topic_from_the_latest_and_written_by_spark(spark, tmp_path):
    path = f"file://{tmp_path}/topic"
    rows = spark.range(100).select(
        (F.col("id") % 3).alias("partition"), F.lit(None).cast("binary").alias("key"), F.col("id").cast("string").cast("binary").alias("value"),
        F.timestamp_seconds("id").alias("timestamp"), F.array().cast("array<struct<key:string,value:binary>>").alias("headers"), "id",
    )
    topic_log.write_topic(rows, path, ["id"])
    assert read_all(spark, path, "late", tmp_path, starting="latest") in ([], [(0, [])])
    topic_log.write_topic(rows.where("id < 3"), path, ["id"])
    assert [r for _, rows in read_all(spark, path, "late", tmp_path, starting="latest") for r in rows] == [(0, 34, b"0"), (1, 33, b"1"), (2, 33, b"2")]
    whole = [r for _, rows in read_all(spark, path, "all", tmp_path, starting="earliest") for r in rows]
    assert [int(v) for p, _, v in whole if p == 1] == [*range(1, 100, 3), 1]


def test_streams_joined_as_of_a_time_equal_the_batch(spark, tmp_path):
    import random

    rng = random.Random(2)
    left = spark.createDataFrame([(i, at(rng.randrange(400) / 4)) for i in range(120)], "id long, ts timestamp")
    right = spark.createDataFrame([(at(rng.randrange(400) / 4), float(i)) for i in range(60)], "ts timestamp, js double")
    seconds = lambda c: c.cast("double")
    want = {r.id: r.js for r in alignment.asof_latest(left, right, "ts", "js", tie="id", max_age=1.5, seconds=seconds).collect()}
    for name, df, far in (("l", left, (-1, at(10_000))), ("r", right, (at(10_000), -1.0))):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}/0")
        spark.createDataFrame([far], df.schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/1")
    streams = [spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{n}/*") for n, d in (("l", left), ("r", right))]
    query = asof.asof_stream(*streams, "id", "ts", "js", 1.5, "200 seconds").writeStream.format("memory").queryName("asof_test")
    query.trigger(availableNow=True).start().awaitTermination(120)
    got = {r.id: r.js for r in spark.table("asof_test").where("id >= 0").collect()}
    assert got == want and None in want.values() and any(v is not None for v in want.values())


def test_reader_of_a_topic_holds_batches_of_bounded_size(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/topic"
    monkeypatch.setattr(topic_log, "READ_ROWS", 10)
    for n in (35, 20):
        topic_log.append(path, 0, [(None, str(i).encode(), at(i), None if i % 2 else [("h", b"x")]) for i in range(n)])
    reader = topic_log.TopicReader({"path": path})
    got = list(reader.read(topic_log.Slice(0, 7, 50)))
    assert max(b.num_rows for b in got) <= 10
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["offset"] for r in rows] == list(range(7, 50)) and [int(r["value"]) for r in rows] == [*range(7, 35), *range(15)]
    assert {len(r["headers"]) for r in rows} == {0, 1} and {r["partition"] for r in rows} == {0}


def test_asof_of_crowded_ranges_makes_no_pairs(spark, tmp_path):
    """20,000 rows a side in one range: pairs would be 200 million."""
    n = 20_000
    left = spark.range(n).select("id", F.timestamp_micros(F.col("id") * 10 + 5).alias("ts"))
    right = spark.range(n).select(F.timestamp_micros(F.col("id") * 10).alias("ts"), F.col("id").cast("double").alias("js"))
    for name, df, far in (("l", left, (-1, at(10_000))), ("r", right, (at(10_000), -1.0))):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}/0")
        spark.createDataFrame([far], df.schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/1")
    streams = [spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{n}/*") for n, d in (("l", left), ("r", right))]
    joined = asof.asof_stream(*streams, "id", "ts", "js", 600.0, "200 seconds")
    query = joined.writeStream.format("memory").queryName("asof_crowded").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert all(op["numRowsTotal"] < 100 for p in query.recentProgress for op in p["stateOperators"])  # a range is a row
    assert spark.table("asof_crowded").where("id >= 0 and js = id").count() == n


def test_rows_of_a_part_are_given_out_in_blocks(monkeypatch):
    import gzip

    import pyarrow as pa

    monkeypatch.setattr(parts, "_ROWS", 4)
    body = "a,b\n" + "".join(f'{i},"x\ny{i}"\n' for i in range(10)) + "10\n"
    for packed in (False, True):
        content = pa.py_buffer(gzip.compress(body.encode()) if packed else body.encode())
        names, blocks = parts.parse_part(content, packed)
        got = list(blocks)
        assert names == ["a", "b"] and [len(b) for b in got] == [4, 4, 3]
        assert [r for b in got for r in b] == [[str(i), f"x\ny{i}"] for i in range(10)] + [["10", None]]
    for late, why in ((b"1,2,3\n", "more cells than names"), (b'"1\n', "broken quotes"), (b"\0", "not text")):
        with pytest.raises(ValueError, match=why):
            parts.parse_part(pa.py_buffer(body.encode() + late))
