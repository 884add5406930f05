"""A partitioned topic kept as files on shared storage, read as a stream without a broker.

``topic/partition=<p>/<first offset>.parquet`` holds consecutive records. Offsets are positions, so
a restarted query reads again exactly what its checkpoint has not seen, whatever has been appended.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "topic_log"
LOG_SCHEMA = (
    "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, "
    "headers array<struct<key string, value binary>>"
)
READ_ROWS = 8_192  # records a reader holds at once
_HEADERS = pa.list_(pa.struct([("key", pa.string()), ("value", pa.binary())]))
_SEGMENT = pa.schema([("key", pa.binary()), ("value", pa.binary()), ("timestamp", pa.timestamp("us", "UTC")), ("headers", _HEADERS)])


def append(path: str, partition: int, records: Sequence[tuple]) -> int:
    """Add ``(key, value, timestamp, headers)`` records to a partition; the first one's offset. One writer a partition."""
    system, root = pafs.FileSystem.from_uri(path)
    folder = f"{root}/partition={partition}"
    system.create_dir(folder, recursive=True)
    first = _ends(system, root).get(partition, 0)
    if records:
        table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*records, strict=True), _SEGMENT, strict=True)], schema=_SEGMENT)
        made = f"{folder}/_{first:020d}-{first + len(records):020d}"
        pq.write_table(table, made, filesystem=system)
        system.move(made, f"{folder}/{first:020d}-{first + len(records):020d}.parquet")  # seen whole or not at all
    return first


def write_topic(df, path: str, order: Sequence[str]) -> None:
    """Append the rows of a frame ``(partition, key, value, timestamp, headers, *order)``, each partition in its order.

    A partition is written by one task, as a topic's partition has one sequence. Its new segment
    has a name that follows from what was there before, so a task that is repeated replaces its own.
    """
    ends = _ends(*pafs.FileSystem.from_uri(path))

    def write(batches):
        import uuid

        system, root = pafs.FileSystem.from_uri(path)
        made: dict[int, list] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for p in table["partition"].unique().to_pylist():
                own = table.filter(pa.compute.equal(table["partition"], p)).select(_SEGMENT.names).cast(_SEGMENT)
                if p not in made:
                    system.create_dir(f"{root}/partition={p}", recursive=True)
                    name = f"{root}/partition={p}/_{uuid.uuid4().hex}"
                    made[p] = [name, pq.ParquetWriter(name, _SEGMENT, filesystem=system), 0]
                made[p][1].write_table(own)
                made[p][2] += own.num_rows
        for p, (name, writer, n) in made.items():
            writer.close()
            first = ends.get(p, 0)
            system.move(name, f"{root}/partition={p}/{first:020d}-{first + n:020d}.parquet")
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([n], pa.int64())], ["partition", "n"])

    spread = df.withColumn("partition", F.col("partition").cast("int")).repartition("partition").sortWithinPartitions("partition", *order)
    spread.select("partition", *_SEGMENT.names).mapInArrow(write, "partition int, n long").collect()  # a row a partition


def _segments(system, root: str) -> dict[int, list[tuple[int, int, str]]]:
    """(first offset, end, path) of the segments of each partition, in order."""
    out: dict[int, list] = {}
    for f in system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
        if f.is_file and f.extension == "parquet":
            first, end = f.base_name.removesuffix(".parquet").split("-")
            out.setdefault(int(f.path.rsplit("/", 2)[-2].removeprefix("partition=")), []).append((int(first), int(end), f.path))
    return {p: sorted(s) for p, s in sorted(out.items())}


def _ends(system, root: str) -> dict[int, int]:
    return {p: s[-1][1] for p, s in _segments(system, root).items()}


def _batches(file: pq.ParquetFile, first: int, lo: int, hi: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(offset, records) of the batches of a segment's row groups that hold offsets from ``lo`` to ``hi``."""
    for g in range(file.num_row_groups):
        end = first + file.metadata.row_group(g).num_rows
        if end > lo and first < hi:
            at = first
            for batch in file.iter_batches(READ_ROWS, [g], _SEGMENT.names):
                yield at, batch
                at += batch.num_rows
        first = end


class Slice(InputPartition):
    def __init__(self, partition: int, start: int, end: int):
        super().__init__((partition, start, end))
        self.partition, self.start, self.end = partition, start, end


class TopicReader(DataSourceStreamReader):
    """Offsets are ``{partition: next offset}``; JSON knows text keys only.

    The engine asks for the newest offset without saying where it stands. To admit a bounded number
    of records a batch the reader keeps the end of the last planned batch in ``progress``, which
    also tells it after a restart; the engine's own checkpoint decides what is read.
    """

    def __init__(self, options: dict):
        self.path, self.topic = options["path"], options.get("topic", "topic")
        self.starting = options.get("startingoffsets", "latest")
        self.most, self.progress = int(options.get("maxoffsetspertrigger", 0)), options.get("progress")
        if self.most and not self.progress:
            raise ValueError("maxOffsetsPerTrigger needs progress, a folder of this query's own")
        self.start: dict | None = None
        self.told: dict | None = None

    def _open(self):
        return pafs.FileSystem.from_uri(self.path)

    def _saved(self) -> dict | None:
        system, root = pafs.FileSystem.from_uri(self.progress)
        found = system.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        done = sorted(f.path for f in found if f.base_name.endswith(".json"))
        if not done:
            return None
        with system.open_input_stream(done[-1]) as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:  # noqa: N802
        if self.start is None:
            ends = {str(p): n for p, n in _ends(*self._open()).items()}
            known = {"earliest": dict.fromkeys(ends, 0), "latest": ends}
            self.start = known[self.starting] if self.starting in known else {str(p): int(n) for p, n in json.loads(self.starting).items()}
        return self.start

    def latestOffset(self) -> dict:  # noqa: N802
        ends = {str(p): n for p, n in _ends(*self._open()).items()}
        if not self.most:
            self.initialOffset()
            return ends
        if self.told is None:
            self.told = self._saved() or self.initialOffset()
        left = {p: n - self.told.get(p, 0) for p, n in ends.items()}
        each = max(1, self.most // max(1, sum(n > 0 for n in left.values())))
        return {p: self.told.get(p, 0) + min(n, each) for p, n in left.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.told = dict(end)  # planned, so the next batch begins there
        if self.progress:
            system, root = pafs.FileSystem.from_uri(self.progress)
            system.create_dir(root, recursive=True)
            name = f"{root}/{sum(end.values()):020d}"
            with system.open_output_stream(f"{name}.tmp") as f:
                f.write(json.dumps(end).encode())
            system.move(f"{name}.tmp", f"{name}.json")
        return [Slice(int(p), start.get(p, 0), n) for p, n in end.items() if n > start.get(p, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        """The records in batches of bounded size; a segment is never held whole."""
        system, root = self._open()
        for first, end, path in _segments(system, root).get(partition.partition, []):
            if end > partition.start and first < partition.end:
                with system.open_input_file(path) as f:
                    for at, batch in _batches(pq.ParquetFile(f), first, partition.start, partition.end):
                        lo, hi = max(partition.start, at), min(partition.end, at + batch.num_rows)
                        if lo < hi:
                            yield self._records(batch.slice(lo - at, hi - lo), partition.partition, lo)

    def _records(self, batch: pa.RecordBatch, partition: int, first: int) -> pa.RecordBatch:
        n = batch.num_rows
        headers = batch["headers"]
        if headers.null_count:
            headers = pa.array([h or [] for h in headers.to_pylist()], _HEADERS)
        told = {
            "key": batch["key"], "value": batch["value"], "topic": pa.array([self.topic] * n, pa.string()),
            "partition": pa.array([partition] * n, pa.int32()), "offset": pa.array(range(first, first + n), pa.int64()),
            "timestamp": batch["timestamp"], "headers": headers,
        }
        return pa.RecordBatch.from_arrays(list(told.values()), list(told))

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class TopicLog(DataSource):
    """``spark.readStream.format("topic_log")`` with ``path``, ``startingOffsets``, ``maxOffsetsPerTrigger``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LOG_SCHEMA

    def streamReader(self, schema) -> TopicReader:  # noqa: N802
        return TopicReader({k.lower(): v for k, v in self.options.items()})


def read_topic_log(
    spark, path: str, starting: str = "latest", max_offsets: int | None = None, progress: str | None = None, topic: str = "topic"
):
    """Stream of the topic's records, in the layout of the other record sources; ``max_offsets`` a batch need ``progress``."""
    spark.dataSource.register(TopicLog)
    options = {"path": path, "startingOffsets": starting, "topic": topic}
    if max_offsets:
        options |= {"maxOffsetsPerTrigger": str(max_offsets), "progress": progress or ""}
    return spark.readStream.format(FORMAT).options(**options).load()
