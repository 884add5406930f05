"""Table sinks: append-only folders that readers merge by reading them."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import make_folder, ship_package

_NO_PATH = "__HIVE_DEFAULT_PARTITION__"  # as Spark's writer names the folder of nulls


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet", mode: str = "overwrite"
) -> None:
    """Write a merged table; partition by scenario and experiment to prune later reads."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_lines(lines: DataFrame, folder: str) -> None:
    """One text file a ``path`` of ``(path, line_no, line)``, its name holding ``path=...``, lines in order.

    Tasks write files through Arrow, several thousand a second: Spark's writer makes a folder, a checksum and,
    on a local disk, three ``chmod`` processes for each of them. It is used where Arrow does not know the
    file system. A task owns a folder, so the files are listed by few folders; one that runs again
    replaces its files by equal ones.
    """
    placed = lines.repartition("path").sortWithinPartitions("path", "line_no").select("path", "line")
    try:
        pyarrow.fs.FileSystem.from_uri(folder)
    except pa.ArrowException:
        placed.write.partitionBy("path").text(folder)
        return
    ship_package(lines.sparkSession)
    make_folder(lines.sparkSession, folder)

    def write(batches):
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        own = f"{root}/part={TaskContext.get().partitionId():05d}"
        current = out = None
        done = 0

        def close():
            if out:
                out.close()
                files.move(temporary, f"{own}/path={name}.txt")

        for batch in batches:
            paths, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for path, run in groupby(range(len(paths)), paths.__getitem__):
                if not out or path != current:
                    close()
                    if not out:
                        files.create_dir(own)
                    name = _NO_PATH if path is None else quote(path, safe="")
                    temporary = f"{own}/.{name}-{TaskContext.get().taskAttemptId()}"
                    current, out, done = path, files.open_output_stream(temporary, compression=None), done + 1
                out.write("".join(f"{texts[i] or ''}\n" for i in run).encode())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([done])], ["files"])

    placed.mapInArrow(write, "files long").agg(F.sum("files")).collect()


def append_metrics(events: DataFrame, path: str) -> None:
    """Append metric events ``(ts, component, event, pod, kv)``, one folder per component."""
    events.write.mode("append").partitionBy("component").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All metric shards as one table."""
    return spark.read.parquet(path).select("ts", "component", "event", "pod", "kv")


def write_forecast(forecast: DataFrame, path: str, array: str = "yhat", keys: Sequence[str] = ()) -> None:
    """Forecast steps ``(step, pred)`` counted from 1."""
    forecast_steps(forecast, array, keys).write.mode("append").parquet(path)


def forecast_steps(forecast: DataFrame, array: str = "yhat", keys: Sequence[str] = ()) -> DataFrame:
    return forecast.select(*keys, F.posexplode(array).alias("_pos", "pred")).select(
        *keys, (F.col("_pos") + 1).alias("step"), "pred"
    )
