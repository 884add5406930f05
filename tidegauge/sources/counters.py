"""Per-second hardware counters, rates and latency of an experiment as one wide table.

Parsers take lines ``(*keys, line_no, line)`` and return long series
``(*keys, ..., row_idx, value)``; a series' position is its second.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalars import NUMBER_PATTERN, first_number, to_number
from tidegauge.operators.alignment import first_available, zip_left
from tidegauge.operators.ordering import (
    MAX_ROWS_PER_TASK,
    join_facts,
    join_on,
    largest_group,
    occurrence_index,
)
from tidegauge.operators.stats import median_abs
from tidegauge.session import cut_lineage
from tidegauge.sources.text import split_path

# Network functions, counter events and the standard column order.
FUNCTIONS = ("firewall", "nf_router", "ndpi_stats", "payload_scan", "bridge")
EVENTS = (
    "instructions", "branches", "branch-misses", "branch-load-misses",
    "cache-misses", "cache-references", "cycles",
    "L1-dcache-load-misses", "L1-dcache-loads",
    "LLC-load-misses", "LLC-stores", "LLC-loads",
)
KPI_COLUMNS = ("input_rate", "output_rate", "latency")
COUNTER_COLUMNS = tuple(f"{vnf}_{event}" for event in EVENTS for vnf in FUNCTIONS)
STANDARD_COLUMNS = KPI_COLUMNS + COUNTER_COLUMNS
LATENCY_FILES = ("latency.csv", "latency_old.csv", "latency-old.csv")
RATE_COLUMNS = ("Mbit", "PacketRate")
RATE_FALLBACK_FIELD = 5
MICROSECOND_MEDIAN = 1000


def fields(line: Column | str, separator: str = ",") -> Column:
    """Trimmed cells of a line without their quotes."""
    line = F.col(line) if isinstance(line, str) else line
    return F.transform(F.split(line, separator, -1), lambda t: F.btrim(F.trim(t), F.lit("\"'")))


def _largest_magnitude(tokens: Column) -> Column:
    """Number of the largest magnitude, ignoring scale-like ones if others exist.

    Numbers are ranked by (not scale-like, magnitude, earliest) in one pass.
    """
    numbers = F.filter(F.transform(tokens, first_number), lambda v: F.abs(v) < float("inf"))
    ranked = F.transform(
        numbers,
        lambda v, i: F.named_struct(
            F.lit("count"), ~F.abs(v).between(0.1, 10.0), F.lit("size"), F.abs(v), F.lit("at"), -i, F.lit("v"), v
        ),
    )
    return F.array_max(ranked)["v"]


def parse_perf_counters(
    lines: DataFrame,
    events: Sequence[str] = EVENTS,
    mode: str = "positional",
    keys: Sequence[str] = ("path",),
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """``(*keys, event, row_idx, value)`` from counter log lines.

    A line counts for an event when any of its cells is that name, ignoring case.
    "positional" takes the second cell, null where nothing was counted. "legacy_max" takes
    the number of largest magnitude on the line and skips lines without a number.
    """
    if mode not in ("positional", "legacy_max"):
        raise ValueError(f"unknown counter mode: {mode}")
    tokens = lines.withColumn("_t", fields("line"))
    spelled = F.create_map(*[F.lit(x) for e in events for x in (e.lower(), e)])
    wanted = F.array(*[F.lit(e.lower()) for e in events])
    hits = F.array_intersect(wanted, F.transform("_t", F.lower))
    if mode == "positional":
        value = to_number(F.get("_t", 1))
    else:
        value = _largest_magnitude(F.col("_t"))
    rows = tokens.select(*keys, "line_no", value.alias("value"), F.explode(hits).alias("_event"))
    if mode == "legacy_max":
        rows = rows.filter("value is not null")
    # A file cannot hold more occurrences than lines; counting those parses nothing.
    indexed = occurrence_index(
        rows, [*keys, "_event"], ["line_no"], max_rows, "row_idx", largest_group(lines, keys)
    )
    return indexed.select(*keys, spelled[F.col("_event")].alias("event"), "row_idx", "value")


def pivot_counters(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Series ``(*keys, vnf, event, row_idx, value)`` as the 60 standard counter columns."""
    named = long.withColumn("name", F.concat_ws("_", "vnf", "event"))
    wide = named.groupBy(*keys, "row_idx").pivot("name", list(COUNTER_COLUMNS)).agg(F.first("value"))
    return wide.select(*keys, "row_idx", *[F.col(f"`{c}`") for c in COUNTER_COLUMNS])


def parse_latency(
    lines: DataFrame,
    unit: str = "auto",
    skip_first4: bool = False,
    number: str = "last",
    keys: Sequence[str] = ("path",),
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """``(*keys, row_idx, value)`` in milliseconds; lines without a number are skipped.

    ``number`` picks the last number of a line (after a sequence number or a time) or the
    "first" one. With unit "auto" a series whose median magnitude exceeds 1000 is taken for
    microseconds. ``skip_first4`` drops four leading lines of files that have them.
    """
    if skip_first4:
        sizes = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        sized = join_facts(lines, sizes, list(keys))
        lines = sized.filter("_n < 4 or line_no >= 4").drop("_n")
    if number == "first":
        value = first_number("line")
    else:
        every = F.regexp_extract_all("line", F.lit(f"({NUMBER_PATTERN})"), 1)
        value = F.get(every, F.size(every) - 1).try_cast("double")
    rows = lines.select(*keys, "line_no", value.alias("value")).filter("value is not null")
    largest = largest_group(lines, keys)
    indexed = occurrence_index(rows, keys, ["line_no"], max_rows, "row_idx", largest).drop("line_no")
    if unit == "us":
        return indexed.withColumn("value", F.col("value") / 1000.0)
    if unit == "ms":
        return indexed
    medians = median_abs(rows, "value", keys, max_rows, largest)
    scaled = F.when(F.col("median_abs") > MICROSECOND_MEDIAN, F.col("value") / 1000.0)
    return (
        join_facts(indexed, medians, list(keys))
        .withColumn("value", scaled.otherwise(F.col("value")))
        .select(*keys, "row_idx", "value")
    )


def parse_rate_stats(
    lines: DataFrame,
    prefer: Sequence[str] = RATE_COLUMNS,
    fallback_field: int = RATE_FALLBACK_FIELD,
    keys: Sequence[str] = ("path",),
) -> DataFrame:
    """``(*keys, row_idx, value)`` from traffic statistics with a header line.

    The first preferred column that the header names is taken, else the first column with
    any number, else the fallback field with whatever number it contains.
    """
    keys = list(keys)
    cells = lines.filter(F.trim("line") != "").withColumn("_t", fields("line"))
    headers = cells.filter("line_no = 0").select(*keys, F.col("_t").alias("_header"))
    body = cells.filter("line_no > 0")
    numeric = (
        body.select(*keys, F.posexplode("_t").alias("_pos", "_cell"))
        .groupBy(*keys, "_pos")
        .agg(F.count(to_number("_cell")).alias("_n"))
        .filter("_n > 0")
        .groupBy(*keys)
        .agg(F.min("_pos").alias("_first"))
    )
    named = [
        F.when(F.array_contains("_header", c), F.array_position("_header", F.lit(c)) - 1) for c in prefer
    ]
    choice = join_on(headers, numeric, keys, "left").select(
        *keys, F.coalesce(*named, F.col("_first")).cast("int").alias("_pos")
    )
    last_resort = F.get("_t", fallback_field)
    value = F.when(F.col("_pos").isNotNull(), to_number(F.get("_t", F.col("_pos")))).otherwise(
        F.coalesce(to_number(last_resort), first_number(last_resort))
    )
    return join_facts(body, choice, keys).select(
        *keys, (F.col("line_no") - 1).alias("row_idx"), value.alias("value")
    )


def build_perf_table(
    lines: DataFrame, mode: str = "positional", max_rows: int = MAX_ROWS_PER_TASK
) -> DataFrame:
    """The wide table of all experiments: ``(scenario, exp, row_idx)`` and 63 columns.

    All files are read once. The length of an experiment is that of its shortest
    series among firewall instructions, both rates and latency; shorter counters are padded
    with nulls. Experiments without any of these have no rows.
    """
    keys = ["scenario", "exp"]
    vnf = F.regexp_replace("file", r"\.csv$", "")
    known = [f"{v}.csv" for v in FUNCTIONS] + [*LATENCY_FILES, "tx_stats.csv", "rx_stats.csv"]
    # Written once: the parsers below each take their own files from it, some more than once.
    located = cut_lineage(
        split_path(lines)
        .filter(F.col("file").isin(*known))
        .select(*keys, "file", "line_no", "line")
    )
    counters = parse_perf_counters(
        located.filter(vnf.isin(*FUNCTIONS)).withColumn("vnf", vnf), EVENTS, mode, [*keys, "vnf"], max_rows
    ).select(*keys, F.concat_ws("_", "vnf", "event").alias("name"), "row_idx", "value")

    latency_lines = located.filter(F.col("file").isin(*LATENCY_FILES))
    names = latency_lines.select(*keys, "file").distinct()
    rank = F.array_position(F.array(*[F.lit(f) for f in LATENCY_FILES]), F.col("file"))
    chosen = first_available(names, keys, rank, "file")
    latency = parse_latency(
        join_on(latency_lines, chosen, [*keys, "file"]), keys=keys, max_rows=max_rows
    )
    rates = {
        "input_rate": parse_rate_stats(located.filter("file = 'tx_stats.csv'"), keys=keys),
        "output_rate": parse_rate_stats(located.filter("file = 'rx_stats.csv'"), keys=keys),
        "latency": latency,
    }
    series = counters
    for name, part in rates.items():
        series = series.unionByName(part.select(*keys, F.lit(name).alias("name"), "row_idx", "value"))
    anchors = ["firewall_instructions", *KPI_COLUMNS]
    wide = zip_left(series, keys, STANDARD_COLUMNS, anchors)
    return wide.select(*keys, "row_idx", *[F.col(f"`{c}`") for c in STANDARD_COLUMNS])
