"""Parsers against small hand-written files of the same shape as real ones."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidegauge.sources import counters, hardware, merge, replay, sinks, text


def write(root, rel, content):
    p = root / rel
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(p)


def as_lines(spark, content, path="f"):
    rows = [(path, i, ln) for i, ln in enumerate(content.splitlines())]
    return spark.createDataFrame(rows, "path string, line_no long, line string")


LOG = """# started on Thu May 11 00:17:55 2023

     1.0004,1700,,instructions,0.00%,889519,100.00,,
     1.0004,<not counted>,,branch-misses,0.00%,889519,100.00,,
     2.0004,1800,,Instructions,0.00%,12,100.00,1.43,x
     2.0004,55,,branch-misses,0.00%,40,100.00,,
"""


def test_read_lines_over_splits(spark, tmp_path):
    long = "\r\n".join(f"row {i} é" for i in range(400))
    write(tmp_path, "s/exp-1/a.csv", long)
    write(tmp_path, "s/exp-1/b.csv", "x\ny\n")
    write(tmp_path, "s/exp-2/c.csv", "café\nplain\n".encode("latin-1"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512b")
    try:
        got = text.read_lines(spark, str(tmp_path / "s" / "*" / "*.csv")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    by_file = {}
    for r in got:
        by_file.setdefault(os.path.basename(r.path), {})[r.line_no] = r.line
    assert by_file["a.csv"] == dict(enumerate(long.split("\r\n")))
    assert by_file["b.csv"] == {0: "x", 1: "y"}
    assert by_file["c.csv"] == {0: "café", 1: "plain"}


def test_read_table(spark, tmp_path):
    p = write(tmp_path, "t.csv", "Unnamed: 0,a,b\n0,1,<not counted>\n1,2,3\n")
    df = text.read_table(spark, p)
    assert df.columns == ["a", "b"] and [r.b for r in df.collect()] == [None, "3"]


def test_discover(spark):
    paths = ["r/s1/exp-10/a.csv", "r/s1/exp-2/a.csv", "r/s1/exp-2/b.csv", "r/s1/other/a.csv",
             "r/s0/exp1/a.csv", "r/s0/exp-x/a.csv", "r/s0/exp-3/a.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = text.discover_experiments(df).orderBy("scenario", "exp_no").collect()
    assert [(r.scenario, r.exp) for r in got] == [("s0", "exp1"), ("s0", "exp-x"), ("s1", "exp-2"), ("s1", "exp-10")]
    strict = text.discover_experiments(df, r"^exp-").filter("scenario = 's0'").collect()
    assert [r.exp for r in strict] == ["exp-x"]


@pytest.mark.parametrize("max_rows", [1, 1000])
def test_perf_counters(spark, max_rows):
    lines = as_lines(spark, LOG)
    ev = ["instructions", "branch-misses"]
    got = counters.parse_perf_counters(lines, ev, max_rows=max_rows).collect()
    assert {(r.event, r.row_idx): r.value for r in got} == {
        ("instructions", 0): 1700.0, ("instructions", 1): 1800.0, ("branch-misses", 0): None, ("branch-misses", 1): 55.0}
    legacy = counters.parse_perf_counters(lines, ev, "legacy_max", max_rows=max_rows).collect()
    assert {(r.event, r.row_idx): r.value for r in legacy} == {
        ("instructions", 0): 889519.0, ("instructions", 1): 1800.0, ("branch-misses", 0): 889519.0, ("branch-misses", 1): 100.0}


@pytest.mark.parametrize("max_rows", [1, 1000])
def test_latency(spark, max_rows):
    seq = as_lines(spark, "<<<<<<< HEAD\n1 15000\n2 16000\n3 17000\n")
    assert [r.value for r in counters.parse_latency(seq, max_rows=max_rows).orderBy("row_idx").collect()] == [15.0, 16.0, 17.0]
    first = counters.parse_latency(seq, number="first", max_rows=max_rows).orderBy("row_idx").collect()
    assert [r.value for r in first] == [1.0, 2.0, 3.0]
    small = as_lines(spark, "a\nb\nc\nd\n5\n6.5\n")
    assert [r.value for r in counters.parse_latency(small, skip_first4=True, max_rows=max_rows).orderBy("row_idx").collect()] == [5.0, 6.5]
    assert [r.value for r in counters.parse_latency(seq, unit="ms").orderBy("row_idx").collect()][0] == 15000.0
    assert [r.value for r in counters.parse_latency(seq, unit="us").orderBy("row_idx").collect()][0] == 15.0
    comma = as_lines(spark, "1700000000,250\n1700000001,260\n")
    assert [r.value for r in counters.parse_latency(comma).orderBy("row_idx").collect()] == [250.0, 260.0]
    plain = hardware.parse_latency_plain(as_lines(spark, "<<<<<<< HEAD\n1 15000\n7\n1,2\n"), max_rows=max_rows)
    assert [r.value for r in plain.orderBy("row_idx").collect()] == [None, 15000.0, 7.0, None]


def test_rate_stats(spark):
    named = as_lines(spark, "Time,Device,PacketRate,Mbit\n1,d,5,7.5\n2,d,x,8\n")
    assert [r.value for r in counters.parse_rate_stats(named).orderBy("row_idx").collect()] == [7.5, 8.0]
    other = as_lines(spark, "d,load\nq,3\nr,bad\n")
    assert [r.value for r in counters.parse_rate_stats(other).orderBy("row_idx").collect()] == [3.0, None]
    text_only = as_lines(spark, "a,b,c,d,e,f\nu,v,w,x,y,12Mb\nu\n")
    assert [r.value for r in counters.parse_rate_stats(text_only).orderBy("row_idx").collect()] == [12.0, None]


def test_build_perf_table(spark, tmp_path):
    def log(n, start=1):
        return "# c\n\n" + "".join(f" {i}.0,{start + i},,{e},0%,9,100,,\n" for i in range(n) for e in ("instructions", "cycles"))

    for exp in ("exp-2", "exp-10"):
        write(tmp_path, f"sc/{exp}/firewall.csv", log(5))
        write(tmp_path, f"sc/{exp}/bridge.csv", log(2, 50))
        write(tmp_path, f"sc/{exp}/latency_old.csv", "\n".join(f"{i} {5000 + i}" for i in range(4)))
        write(tmp_path, f"sc/{exp}/rx_stats.csv", "Time,Mbit\n1,1.5\n2,2.5\n3,3.5\n4,4.5\n")
    write(tmp_path, "sc/exp-2/latency.csv", "\n".join(f"{i} {7000 + i}" for i in range(3)))
    lines = text.read_lines(spark, str(tmp_path / "sc" / "*" / "*.csv"))
    wide = counters.build_perf_table(lines)
    assert len(wide.columns) == 3 + 63 and wide.columns[3:6] == ["input_rate", "output_rate", "latency"]
    assert wide.columns[6:8] == ["firewall_instructions", "nf_router_instructions"]
    merged = merge.merge_scenario(wide, "sc").orderBy("exp_order", "row_idx").collect()
    assert [(r.exp, r.row_idx) for r in merged] == [("exp-2", 0), ("exp-2", 1), ("exp-2", 2)] + [("exp-10", i) for i in range(4)]
    r = merged[2]
    assert r["firewall_instructions"] == 3.0 and r["bridge_cycles"] is None and r["latency"] == 7.002
    assert r["input_rate"] is None and r["output_rate"] == 3.5 and merged[3]["latency"] == 5.0
    sinks.write_table(wide, str(tmp_path / "out"), ["scenario", "exp"])
    back = spark.read.parquet(str(tmp_path / "out")).filter("exp = 'exp-10'")
    assert back.count() == 4


PCIE = """Skt,PCIRdCur,WiL
0,10,203(Total)
0,11,19(Miss)
0,12,5(Hit)
1,20,32(Total)
1,21,31(Miss)
1,22,3(Hit)
Skt,PCIRdCur,WiL
0,110,1(Total)
0,111,2(Miss)
"""


def test_pcie(spark):
    got = hardware.reshape_pcie(as_lines(spark, PCIE)).collect()
    cells = {(r.row_idx, r.name): r.value for r in got}
    assert cells[(0, "skt-0_PCIRdCur-total")] == 10 and cells[(0, "skt-1_WiL-hit")] == 3 and cells[(0, "skt-0_WiL-total")] == 203
    assert cells[(1, "skt-0_WiL-miss")] == 2 and len(cells) == 12 + 4
    plain = hardware.reshape_pcie(as_lines(spark, "Skt,A\n0,1\n1,2\nSkt,A\n0,3\n1,4\n")).collect()
    assert {(r.row_idx, r.name): r.value for r in plain} == {
        (0, "skt-0_A-total"): 1, (0, "skt-1_A-total"): 2, (1, "skt-0_A-total"): 3, (1, "skt-1_A-total"): 4}
    dated = hardware.reshape_pcie(as_lines(spark, "Date,Time,Skt,A\n2025-01-01,1:2,0,5(Total)\n")).collect()
    assert [(r.name, r.value) for r in dated] == [("skt-0_A-total", 5.0)]


def test_headers_and_memory(spark):
    two = hardware.read_two_row_header(as_lines(spark, "S,S,T\na,a,b\n1,2x,bad\n4,5,6\n"), "tx").collect()
    assert {(r.row_idx, r.name): r.value for r in two} == {
        (0, "S-a"): 1, (0, "S-a__dup1"): 2, (0, "T-b"): None, (1, "S-a"): 4, (1, "S-a__dup1"): 5, (1, "T-b"): 6}
    mem = hardware.read_memory_counters(as_lines(spark, "-Date,-Time,m,m,gone\nd,t,1,2,\nd,t,3,,\n")).collect()
    assert {(r.row_idx, r.name): r.value for r in mem} == {
        (0, "m"): 1, (0, "m__dup1"): 2, (1, "m"): 3, (1, "m__dup1"): None}


def tag_line(tag, base):
    return ",".join([tag, "2", "3"] + [str(base + i) if i != 9 else "W" for i in range(18)])


@pytest.mark.parametrize("max_rows", [1, 1000])
def test_tags_and_assemble(spark, max_rows):
    content = "\n".join([tag_line("router", 100), tag_line("ndpi_stat", 0), tag_line("router", 200),
                         tag_line("ndpi_stat", 50), tag_line("router", 300), tag_line("other", 1)])
    long = hardware.widen_by_tag(as_lines(spark, content), max_rows=max_rows)
    cells = {(r.row_idx, r.name): r.value for r in long.collect()}
    assert cells[(0, "ndpi_stat-rx_pps")] == 1.0 and cells[(1, "router-thread_info.core")] == 200.0
    assert cells[(0, "router-state")] is None and max(i for i, _ in cells) == 1
    lat = hardware.parse_latency_plain(as_lines(spark, "1 5\n2 6\n3 7\n"))
    wide = hardware.assemble([hardware.prefixed(hardware.reshape_pcie(as_lines(spark, PCIE)), "pcie-"), long, lat])
    rows = wide.orderBy("row_idx").collect()
    assert len(rows) == 2 and rows[1]["latency"] == 6.0 and rows[0]["pcie-skt-0_WiL-total"] == 203.0
    assert wide.columns[-1] == "latency" and wide.columns[2] == "pcie-skt-0_PCIRdCur-total"
    legacy = hardware.widen_by_tag(as_lines(spark, content), legacy_header=True, max_rows=max_rows)
    assert {(r.row_idx): r.value for r in legacy.filter("name = 'router-rx_pps'").collect()} == {0: 201.0, 1: 301.0}


def test_modal_merge(spark):
    def part(name, cols, rows):
        return [(name, "p", i, c, r, float(10 * r + i)) for i, c in enumerate(cols) for r in range(rows)]

    data = part("a", ["x", "z"], 1) + part("b", ["x", "y"], 2) + part("c", ["x", "y"], 1) + [("c", "p", 1, "y", 1, None)]
    long = spark.createDataFrame(data, "part string, piece string, position int, name string, row_idx long, value double")
    got = hardware.merge_modal_schema(long, "part").orderBy("part", "row_idx")
    assert got.columns == ["part", "row_idx", "x", "y"]
    assert [tuple(r)[2:] for r in got.collect()] == [(0, 0), (0, 1), (10, 11), (0, 1), (0, 0)]
    assert hardware.sample_head(got, "part", 2).count() == 2
    with pytest.raises(ValueError):
        hardware.modal_signature(long.filter("part = 'q'"), "part")


def test_replay_and_records(spark):
    t = spark.createDataFrame([(i, float(i), str(i * 2)) for i in range(20)], "row_idx long, f double, y string")
    stages = [replay.Stage("s0", "t", "tail", 3, ("row_idx",)), replay.Stage("s1", "t", "head", 2, ("row_idx",)),
              replay.Stage("gone", "nowhere", "head", 2, ("row_idx",))]
    got = replay.stage_replay({"t": t}, stages, ["f", "new"], "y").orderBy("stage_no", "row_idx")
    assert [(r.stage, r.f, r.new, r.y) for r in got.collect()] == [
        ("s0", 17.0, 0.0, 34.0), ("s0", 18.0, 0.0, 36.0), ("s0", 19.0, 0.0, 38.0), ("s1", 0.0, 0.0, 0.0), ("s1", 1.0, 0.0, 2.0)]
    only = replay.stage_replay({"t": t}, stages, ["f"], "y", whitelist=[" S1 "])
    assert only.count() == 2
    sent = got.select(replay.encode_payload(got, ["f", "new"], "y", F.lit("2024-01-02T03:04:05Z")).alias("value"))
    assert json.loads(sent.first().value) == {
        "features": {"f": 17.0, "new": 0.0}, "label": 34.0, "send_ts": "2024-01-02T03:04:05Z", "stage": "s0"}
    broken = spark.createDataFrame([("nonsense",), ('{"features":{"f":2},"send_ts":"bad","stage":"q"}',)], "value string")
    back = replay.decode_records(sent.unionByName(broken), ["f", "zz"]).collect()
    assert len(back) == 6 and back[0].x == [17.0, 0.0] and back[-1].send_ts is None and back[-1].label is None
    assert replay.decode_records(broken, ["f"], default_label=0.0).first().label == 0.0


def test_metric_sink(spark, tmp_path):
    rows = [("t", "infer", "e", "p0", "{}"), ("t", "monitor", "e", "p1", "{}")]
    df = spark.createDataFrame(rows, "ts string, component string, event string, pod string, kv string")
    sinks.append_metrics(df, str(tmp_path / "m"))
    sinks.append_metrics(df, str(tmp_path / "m"))
    assert sinks.read_metrics(spark, str(tmp_path / "m")).filter("component = 'infer'").count() == 2
    f = spark.createDataFrame([([1.0, 2.0],)], "yhat array<double>")
    sinks.write_forecast(f, str(tmp_path / "f"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "f")).collect()) == [(1, 1.0), (2, 2.0)]


def test_more_names_than_columns_is_an_error(spark):
    from tidegauge.sources import hardware

    long = spark.createDataFrame([("mem", i, f"c{i}") for i in range(5)], "piece string, position int, name string")
    assert hardware.column_names(long, ["mem"], 5) == [f"c{i}" for i in range(5)]
    with pytest.raises(ValueError, match="more than 4"):
        hardware.column_names(long, ["mem"], 4)


def test_assembled_rows_are_spread_by_their_cells(spark, monkeypatch):
    cells = spark.range(4_000).select(
        F.lit("f").alias("path"), F.lit("p").alias("piece"), (F.col("id") % 4).cast("int").alias("position"),
        F.concat(F.lit("c"), F.col("id") % 4).alias("name"), F.floor(F.col("id") / 4).alias("row_idx"), F.col("id").cast("double").alias("value"),
    )
    monkeypatch.setattr(hardware, "CELLS_PER_TASK", 100)
    wide = hardware.assemble([cells])
    sizes = wide.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 30 and max(r["count"] for r in sizes) <= 60
    assert wide.columns == ["path", "row_idx", "c0", "c1", "c2", "c3"]
    assert wide.where("c0 = 4 * row_idx and c3 = c0 + 3").count() == 1_000


def test_many_line_files_lie_in_few_folders(spark, tmp_path):
    from tidegauge.plans import files
    from tidegauge.session import checkpoint_dir

    rows = [(i, 1_700_000_000 + i, None if i % 41 == 40 else i % 41, "view", float(i), '{"k": %d}' % (i % 30)) for i in range(410)]
    events = spark.createDataFrame(rows, "event_id long, ts long, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.timestamp_seconds("ts")).write.parquet(str(tmp_path / "events.parquet"))
    root = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    got = files.file_lines(spark, str(tmp_path)).collect()
    (folder,) = (n for n in set(os.listdir(root)) - before if n.startswith("lines-"))
    found = [(d, n) for d, _, names in os.walk(f"{root}/{folder}") for n in names]
    assert len(found) == 41 and len({d for d, _ in found}) <= 8  # a folder, a checksum and a chmod for each file made writing slow
    assert {n for _, n in found} >= {"path=user0.txt", "path=user39.txt", "path=__HIVE_DEFAULT_PARTITION__.txt"}
    assert len(got) == 410 and {r.path for r in got} == {"", *(f"user{u}" for u in range(40))}
    assert sorted((r.row_idx, r.value) for r in got if r.path == "user7") == [(j, float(i) if i % 30 >= 10 else None) for j, i in enumerate(range(7, 410, 41))]


def test_line_files_keep_names_and_order(spark, tmp_path):
    rows = [(p, i, f"{p} {i} é") for p in ("a/b", "c d", "_x") for i in range(50)] + [("a/b", 50, None)]
    lines = spark.createDataFrame(rows, "path string, line_no long, line string").repartition(4)
    sinks.write_lines(lines, str(tmp_path / "lines"))
    back = text.read_lines(spark, str(tmp_path / "lines")).collect()
    assert sorted((r.line_no, r.line) for r in back if "_x" in r.path) == [(i, f"_x {i} é") for i in range(50)]
    assert sorted((r.line_no, r.line) for r in back if "a%" in r.path)[50] == (50, "") and len(back) == 151
    sinks.write_lines(lines.limit(0), str(tmp_path / "none"))
    assert text.read_lines(spark, str(tmp_path / "none")).count() == 0
