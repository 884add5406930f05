"""Counter-monitor files: two-row headers, socket blocks, memory columns and per-tag rows.

The column set of these files is data, so every parser returns a long table
``(*keys, piece, position, name, row_idx, value)``. ``assemble`` lines the pieces of an
experiment up by position.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalars import first_number, to_number
from tidegauge.operators.ordering import (
    MAX_ROWS_PER_TASK,
    head_rows,
    join_facts,
    join_on,
    largest_group,
    occurrence_index,
)
from tidegauge.session import cut_lineage
from tidegauge.sources.counters import fields

# Layout of the per-tag statistics file.
TAGS = ("ndpi_stat", "router", "payload_scan", "bridge", "firewall")
TAG_FIELDS = (
    "tag", "instance_id", "service_id", "thread_info.core", "rx_pps", "tx_pps", "rx", "tx",
    "act_out", "act_tonf", "act_drop", "thread_info.parent", "state", "rte_atomic16_read",
    "rx_drop_rate", "tx_drop_rate", "rx_drop", "tx_drop", "act_next", "act_buffer", "act_returned",
)
TAG_FEATURES = TAG_FIELDS[3:]

# A socket block is a header, then two sockets times three kinds.
BLOCK_KINDS = ("total", "miss", "hit")
BLOCK_LINES = 7
PLAIN_LINES = 3
NOT_COUNTERS = ("Skt", "Date", "Time")


def unique_names(names: Column) -> Column:
    """Array of names with ``__dupN`` appended to the second and later uses."""

    def suffixed(name: Column, i: Column) -> Column:
        earlier = F.size(F.filter(F.slice(names, F.lit(1), i), lambda x: x == name))
        return F.when(earlier > 0, F.concat(name, F.lit("__dup"), earlier.cast("string"))).otherwise(name)

    return F.transform(names, suffixed)


def _cells(lines: DataFrame) -> DataFrame:
    return lines.withColumn("_t", fields("line"))


def _numeric_cells(body: DataFrame, headers: DataFrame, keys: list[str], piece: Column, row_idx: Column):
    """Long numeric cells of the body under the names of each file's header."""
    joined = join_facts(body, headers, keys)
    named = F.arrays_zip(F.col("_names").alias("name"), F.col("_t").alias("cell"))
    return (
        joined.select(*keys, piece.alias("piece"), row_idx.alias("row_idx"), F.posexplode(named).alias("position", "_c"))
        .filter("_c.name is not null")
        .select(
            *keys, "piece", "position", F.col("_c.name").alias("name"), "row_idx",
            first_number(F.col("_c.cell")).alias("value"),
        )
    )


def read_two_row_header(lines: DataFrame, piece: str, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Files whose column names are spread over the first two lines, joined with "-"."""
    keys = list(keys)
    cells = _cells(lines)
    first = cells.filter("line_no = 0").select(*keys, F.col("_t").alias("_a"))
    second = cells.filter("line_no = 1").select(*keys, F.col("_t").alias("_b"))
    width = F.least(F.size("_a"), F.size("_b"))
    joined = F.zip_with(
        F.slice("_a", F.lit(1), width), F.slice("_b", F.lit(1), width), lambda a, b: F.concat_ws("-", a, b)
    )
    headers = join_on(first, second, keys).select(*keys, joined.alias("_names")).withColumn(
        "_names", unique_names(F.col("_names"))
    )
    body = cells.filter("line_no >= 2")
    return _numeric_cells(body, headers, keys, F.lit(piece), F.col("line_no") - 2)


def reshape_pcie(lines: DataFrame, piece: str = "pcie", keys: Sequence[str] = ("path",)) -> DataFrame:
    """Socket counters, one wide row per block.

    Files that mark their kinds have blocks of seven lines (header, then socket 0 and 1 with
    total, miss and hit); others have a header and one total per socket. Socket, date and time
    columns are not counters.
    """
    keys = list(keys)
    cells = _cells(lines)
    marked = lines.groupBy(*keys).agg(
        F.bool_or(F.col("line").rlike(r"\((Total|Miss|Hit)\)")).alias("_marked")
    )
    headers = cells.filter("line_no = 0").select(*keys, F.col("_t").alias("_names"))
    facts = join_on(headers, marked, keys)
    span = F.when(F.col("_marked"), BLOCK_LINES).otherwise(PLAIN_LINES)
    kinds = F.when(F.col("_marked"), len(BLOCK_KINDS)).otherwise(1)
    place = F.pmod(F.col("line_no") - 1, span)
    socket = F.floor(place / kinds).cast("string")
    kind = F.get(F.array(*[F.lit(k) for k in BLOCK_KINDS]), F.pmod(place, kinds))
    body = (
        join_facts(cells.filter("line_no > 0"), facts, keys)
        .withColumns({"_place": place, "_socket": socket, "_kind": kind, "_span": span})
        .filter(F.col("_place") < F.col("_span") - 1)
    )
    named = F.arrays_zip(F.col("_names").alias("name"), F.col("_t").alias("cell"))
    return (
        body.select(
            *keys, "_place", "_socket", "_kind",
            F.floor((F.col("line_no") - 1) / F.col("_span")).cast("bigint").alias("row_idx"),
            F.size("_names").alias("_width"),
            F.posexplode(named).alias("_pos", "_c"),
        )
        .filter(F.col("_c.name").isNotNull() & ~F.col("_c.name").isin(*NOT_COUNTERS))
        .select(
            *keys,
            F.lit(piece).alias("piece"),
            (F.col("_place") * F.col("_width") + F.col("_pos")).cast("int").alias("position"),
            F.concat(F.lit("skt-"), "_socket", F.lit("_"), F.col("_c.name"), F.lit("-"), "_kind").alias("name"),
            "row_idx",
            first_number(F.col("_c.cell")).alias("value"),
        )
    )


def read_memory_counters(lines: DataFrame, piece: str = "mem", keys: Sequence[str] = ("path",)) -> DataFrame:
    """One-line header; date, time and entirely empty columns are left out."""
    keys = list(keys)
    cells = _cells(lines)
    body = cells.filter("line_no > 0")
    filled = (
        body.select(*keys, F.posexplode("_t").alias("_pos", "_cell"))
        .filter("_cell <> ''")
        .groupBy(*keys)
        .agg(F.collect_set("_pos").alias("_filled"))
    )
    header = cells.filter("line_no = 0").select(*keys, F.col("_t").alias("_header"))
    positions = F.filter(
        F.sequence(F.lit(0), F.size("_header") - 1),
        lambda i: F.array_contains("_filled", i)
        & ~F.lower(F.get(F.col("_header"), i)).isin("-date", "-time"),
    )
    facts = (
        join_on(header, filled, keys)
        .withColumn("_kept", positions)
        .withColumn("_names", F.transform("_kept", lambda i: F.get(F.col("_header"), i)))
        .select(*keys, "_kept", unique_names(F.col("_names")).alias("_names"))
    )
    picked = join_facts(body, facts, keys).withColumn(
        "_t", F.transform("_kept", lambda i: F.get(F.col("_t"), i))
    )
    return _numeric_cells(
        picked.drop("_names"), facts.drop("_kept"), keys, F.lit(piece), F.col("line_no") - 1
    )


def tag_rows(lines: DataFrame, keys: Sequence[str], legacy_header: bool = False) -> DataFrame:
    """Numeric fields of the known tags; with ``legacy_header`` the first line is lost."""
    cells = _cells(lines.filter("line_no > 0") if legacy_header else lines)
    values = [
        to_number(F.get("_t", TAG_FIELDS.index(f))).alias(f"f{i}") for i, f in enumerate(TAG_FEATURES)
    ]
    return cells.select(*keys, "line_no", F.get("_t", 0).alias("tag"), *values).filter(
        F.col("tag").isin(*TAGS)
    )


def widen_by_tag(
    lines: DataFrame,
    piece: str = "tags",
    keys: Sequence[str] = ("path",),
    legacy_header: bool = False,
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Per-tag rows side by side by occurrence: 5 tags times 18 fields.

    There are as many rows as the first tag present (in the fixed order) has; other tags are
    cut or padded to that.
    """
    keys = list(keys)
    rows = tag_rows(lines, keys, legacy_header)
    indexed = occurrence_index(
        rows, [*keys, "tag"], ["line_no"], max_rows, "row_idx", largest_group(lines, keys)
    )
    tag_no = F.array_position(F.array(*[F.lit(t) for t in TAGS]), F.col("tag"))
    lengths = (
        indexed.groupBy(*keys, "tag")
        .agg((F.max("row_idx") + 1).alias("_len"))
        .groupBy(*keys)
        .agg(F.min_by("_len", tag_no).alias("_len"))
    )
    n = len(TAG_FEATURES)
    cells = F.array(
        *[
            F.struct(
                ((tag_no - 1) * n + i).cast("int").alias("position"),
                F.concat(F.col("tag"), F.lit(f"-{f}")).alias("name"),
                F.col(f"f{i}").alias("value"),
            )
            for i, f in enumerate(TAG_FEATURES)
        ]
    )
    # Rows are cut before each becomes a row per field.
    kept = join_facts(indexed, lengths, keys).filter("row_idx < _len").drop("_len")
    kept = kept.select(*keys, "row_idx", F.inline(cells))
    return kept.select(*keys, F.lit(piece).alias("piece"), "position", "name", "row_idx", "value")


def parse_latency_plain(
    lines: DataFrame, piece: str = "latency", keys: Sequence[str] = ("path",), max_rows: int = MAX_ROWS_PER_TASK
) -> DataFrame:
    """Space-separated latency; a leading sequence number is dropped, bad values are null."""
    tokens = F.split(F.trim("line"), " ")
    rows = lines.filter(F.trim("line") != "").select(
        *keys, "line_no", to_number(F.element_at(tokens, -1)).alias("value")
    )
    indexed = occurrence_index(
        rows, keys, ["line_no"], max_rows, "row_idx", largest_group(lines, keys)
    )
    return indexed.select(
        *keys,
        F.lit(piece).alias("piece"),
        F.lit(0).alias("position"),
        F.lit("latency").alias("name"),
        "row_idx",
        "value",
    )


def prefixed(long: DataFrame, prefix: str) -> DataFrame:
    return long.withColumn("name", F.concat(F.lit(prefix), "name"))


CELLS_PER_TASK = 1_000_000  # that become rows of a wide table
MAX_COLUMNS = 10_000  # of a table built from names that stand in the files


def column_names(long: DataFrame, order: Sequence[str], most: int = MAX_COLUMNS) -> list[str]:
    """Column names in piece order, then file order; error if they are more than a table should have."""
    rank = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("piece"))
    # Repeated names go by hash; the smallest structs are found by sorting, so among few rows.
    places = long.select("name", "piece", "position").distinct()
    found = places.groupBy("name").agg(F.min(F.struct(rank, "position")).alias("_p")).orderBy("_p", "name")
    names = [r["name"] for r in found.select("name").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} different columns")
    return names


def assemble(pieces: Sequence[DataFrame], keys: Sequence[str] = ("path",), names: Sequence[str] | None = None) -> DataFrame:
    """Line all pieces of an experiment up by position, cut to its shortest piece."""
    keys = list(keys)
    # Written once: names, lengths and cells are three passes over the parsed files.
    long = cut_lineage(reduce(DataFrame.unionByName, pieces))
    lengths = (
        long.groupBy(*keys, "piece")
        .agg((F.max("row_idx") + 1).alias("_len"))
        .groupBy(*keys)
        .agg(F.min("_len").alias("_len"))
    )
    kept = join_facts(long, lengths, keys).filter("row_idx < _len")
    if names is None:
        order = ["bridge", "firewall", "ndpi_stats", "nf_router", "payload_scan", "rx", "tx", "pcie", "mem", "tags", "latency"]
        names = column_names(long, order)
    # Rows are spread by the number of cells, so that what a task aggregates does not grow with the table.
    tasks = max(-(-long.count() // CELLS_PER_TASK), long.sparkSession.sparkContext.defaultParallelism)
    spaced = kept.repartition(tasks, *keys, "row_idx")
    wide = spaced.groupBy(*keys, "row_idx").pivot("name", list(names)).agg(F.first("value"))
    return wide.select(*keys, "row_idx", *[F.col(f"`{c}`") for c in names])


def modal_signature(long: DataFrame, part: str) -> list[str]:
    """The most frequent ordered column list among parts; the first part's among equals."""
    cells = long.select(part, "position", "piece", "name").distinct()
    columns = F.transform(F.sort_array(F.collect_list(F.struct("piece", "position", "name"))), lambda s: s["name"])
    signatures = cells.groupBy(part).agg(columns.alias("_sig"))
    votes = signatures.groupBy("_sig").agg(F.count(F.lit(1)).alias("_n"), F.min(part).alias("_first"))
    best = votes.orderBy(F.desc("_n"), "_first").limit(1).collect()
    if not best:
        raise ValueError("no parts to merge")
    return list(best[0]["_sig"])


def merge_modal_schema(long: DataFrame, part: str) -> DataFrame:
    """All parts with the most frequent column list; other columns are dropped, gaps are 0.0."""
    names = modal_signature(long, part)
    wide = long.groupBy(part, "row_idx").pivot("name", names).agg(F.first("value"))
    return wide.select(
        part, "row_idx", *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in names]
    )


def sample_head(merged: DataFrame, part: str, rows: int = 10_000) -> DataFrame:
    """The first rows of a merged table, in part order."""
    return head_rows(merged, rows, [part, "row_idx"])
