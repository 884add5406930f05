"""Folders of table parts, some of which may be unreadable.

Every file is read, decoded and parsed by itself. What fails is named in a table of reasons instead
of ending the job, and the readable parts are merged by name.
"""

from __future__ import annotations

import codecs
import csv
import gzip
import io
import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.scalars import NULL_TOKENS
from tidegauge.session import ship_package, spread

MAX_COLUMNS = 10_000  # of all parts together
MAX_BYTES = 1 << 30  # of a part
_ROWS = 1_000  # rows of a part that travel together
_PIECE = 1 << 20

_LINES = "path string, reason string, row_idx long, names array<string>, cells array<array<string>>"


def _opened(content: pa.Buffer, compressed: bool):
    raw = pa.BufferReader(content)
    return gzip.GzipFile(fileobj=raw) if compressed else raw


def _encoding(content: pa.Buffer, compressed: bool) -> str:
    """UTF-8, else Latin-1; raises ValueError for what is no text."""
    binary, decoder = False, codecs.getincrementaldecoder("utf-8")()
    try:
        with _opened(content, compressed) as f:
            while piece := f.read(_PIECE):
                binary = binary or b"\0" in piece
                if decoder is not None:
                    try:
                        decoder.decode(piece)
                    except UnicodeDecodeError:
                        decoder = None
    except (OSError, EOFError, zlib.error) as e:
        raise ValueError("damaged archive") from e
    if binary:
        raise ValueError("not text")
    try:
        if decoder is not None:
            decoder.decode(b"", final=True)
            return "utf-8-sig"
    except UnicodeDecodeError:
        pass
    return "latin-1"


def parse_part(content: pa.Buffer, compressed: bool = False) -> tuple[list[str], Iterator[list[list[str]]]]:
    """(header, rows in blocks) of one CSV file; raises ValueError with the reason if it is none.

    Text is UTF-8, else Latin-1. Short rows are filled with nulls, empty lines left out. The file
    is checked to its end before the first row is given out; its rows are never held together.
    """
    encoding = _encoding(content, compressed)

    def rows():
        with io.TextIOWrapper(_opened(content, compressed), encoding, newline="") as text:
            yield from filter(None, csv.reader(text, strict=True))

    names, widest = None, 0
    try:
        for r in rows():
            if names is None:
                names = [n.strip() for n in r]
            widest = max(widest, len(r))
    except csv.Error as e:
        raise ValueError("broken quotes") from e
    if names is None:
        raise ValueError("empty")
    if len(set(names)) < len(names) or not all(names):
        raise ValueError("unusable header")
    if widest > len(names):
        raise ValueError("more cells than names")

    def blocks():
        body = itertools.islice(rows(), 1, None)
        while block := [r + [None] * (len(names) - len(r)) for r in itertools.islice(body, _ROWS)]:
            yield block

    return names, blocks()


@dataclass(frozen=True)
class Parts:
    rows: DataFrame  # path, row_idx and a text column for every name of any part
    status: DataFrame  # path, n_rows, reason (null: read)


def read_parts(spark: SparkSession, path: str, pattern: str = "*.csv*", max_columns: int = MAX_COLUMNS) -> Parts:
    """Read all parts below ``path``; error if none can be read.

    Cells that say nothing was counted are null. A part over ``MAX_BYTES`` counts as unreadable: use
    ``read_table`` for large files, which stay splittable there.
    """
    ship_package(spark)
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .load(path).select("path", "length", F.when(F.col("length") <= MAX_BYTES, F.col("content")).alias("content"))
    )

    def parse(batches):
        texts = pa.list_(pa.string())
        kinds = [pa.string(), pa.string(), pa.int64(), texts, pa.list_(texts)]
        names_ = ["path", "reason", "row_idx", "names", "cells"]

        def row(*values):
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names_)

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                try:
                    if not content.is_valid:
                        raise ValueError("too large")
                    header, blocks = parse_part(content.as_buffer(), name.endswith(".gz"))
                except ValueError as e:
                    yield row(name, str(e), -1, None, None)
                    continue
                yield row(name, None, -1, header, None)
                at = 0
                for block in blocks:
                    yield row(name, None, at, header, block)
                    at += len(block)

    # Spread, as a file is read by one task.
    lines = spread(files.mapInArrow(parse, _LINES))
    found = [r.n for r in lines.where("row_idx < 0").select(F.explode("names").alias("n")).distinct().limit(max_columns + 1).collect()]
    if len(found) > max_columns:
        raise ValueError(f"more than {max_columns} different columns")
    # Files without a byte never reach a task.
    listed = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "path string")
    listed = listed.select(F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/").alias("path"))
    plain = lines.select(F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/").alias("path"))
    nothing = listed.join(plain, "path", "left_anti").select("path", F.lit(0).cast("bigint").alias("n_rows"), F.lit("empty").alias("reason"))
    status = lines.groupBy("path").agg(F.coalesce(F.sum(F.size(F.coalesce("cells", F.array()))), F.lit(0)).cast("bigint").alias("n_rows"), F.max("reason").alias("reason")).unionByName(nothing)
    if lines.where("reason is null").isEmpty():
        raise ValueError(f"no readable part in {path}")
    blocks = lines.where("row_idx >= 0").select("path", "row_idx", "names", F.posexplode("cells").alias("_i", "_cells"))
    good = blocks.withColumn("row_idx", F.col("row_idx") + F.col("_i"))
    cell = lambda n: F.get("_cells", (F.array_position("names", n) - 1).cast("int"))
    clean = lambda c: F.when(~F.trim(c).isin("", *NULL_TOKENS), c)
    return Parts(good.select("path", "row_idx", *[clean(cell(n)).alias(n) for n in sorted(found)]), status)
