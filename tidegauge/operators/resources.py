"""Resource samples and metric events: unit normalisation, summaries and roll-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalars import parse_kv, to_number
from tidegauge.operators.ordering import MAX_ROWS_PER_TASK, exact_quantiles, join_on, largest_group

# Alias columns per quantity, in order of preference.
TIME_ALIASES = (("ts", 1.0), ("timestamp", 1.0), ("epoch_ms", 1e-3))
CPU_ALIASES = (("cpu_pct", 1.0), ("cpu_percent", 1.0))
VCPU_NAMES = ("vcpu", "cpu_vcpu")
CPU_COUNT_NAMES = ("host_cpus", "ncpu", "n_cpus", "cpu_count")
MEMORY_ALIASES = (("rss_mb", 1.0), ("rss_kb", 1.0 / 1024), ("rss_bytes", 1.0 / (1024 * 1024)))


def normalize_resource_units(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``(*keep, ts, cpu_pct, vcpu, rss_mb, host_cpus)`` from whichever alias columns exist."""

    def first_alias(aliases: Sequence[tuple[str, float]]) -> Column | None:
        for name, factor in aliases:
            if name in df.columns:
                c = to_number(F.col(name))
                return c if factor == 1.0 else c * F.lit(factor)
        return None

    def first_named(names: Sequence[str]) -> Column | None:
        found = [c for c in df.columns if c.lower() in names]
        return to_number(F.col(found[0])) if found else None

    missing = F.lit(None).cast("double")
    ts = first_alias(TIME_ALIASES)
    if ts is None:
        raise ValueError("resource samples have no time column")
    cpu = first_alias(CPU_ALIASES)
    vcpu = first_named(VCPU_NAMES)
    count = first_named(CPU_COUNT_NAMES)
    if vcpu is None:
        vcpu = cpu * count / 100.0 if cpu is not None and count is not None else missing
    memory = first_alias(MEMORY_ALIASES)
    hosts = to_number(F.col("host_cpus")) if "host_cpus" in df.columns else F.lit(1.0)
    return df.select(
        *keep,
        ts.alias("ts"),
        (missing if cpu is None else cpu).alias("cpu_pct"),
        vcpu.alias("vcpu"),
        (missing if memory is None else memory).alias("rss_mb"),
        hosts.alias("host_cpus"),
    )


def resource_summary(
    df: DataFrame, component: str = "component", max_rows: int = MAX_ROWS_PER_TASK
) -> DataFrame:
    """Per component: samples, and mean, 95th percentile and maximum of cpu and memory.

    NaN and null samples have no part in the percentile.
    """
    columns = (
        "samples", "cpu_pct_mean", "cpu_pct_p95", "cpu_pct_max", "rss_mb_mean", "rss_mb_p95", "rss_mb_max"
    )
    simple = [F.count(F.lit(1)).alias("samples")] + [
        agg(c).alias(f"{c}_{name}")
        for c in ("cpu_pct", "rss_mb")
        for name, agg in (("mean", F.avg), ("max", F.max))
    ]
    largest = largest_group(df, [component])
    if largest <= max_rows:
        exact = [F.percentile(F.when(~F.isnan(c), F.col(c)), 0.95).alias(f"{c}_p95") for c in ("cpu_pct", "rss_mb")]
        return df.groupBy(component).agg(*simple, *exact).select(component, *columns)
    out = df.groupBy(component).agg(*simple)
    for c in ("cpu_pct", "rss_mb"):
        p95 = exact_quantiles(df, c, [0.95], [component], max_rows, largest)
        out = join_on(out, p95.select(component, F.col("value").alias(f"{c}_p95")), [component], "left")
    return out.select(component, *columns)


def binned_total(df: DataFrame, pod: str = "pod", bin_seconds: float = 0.5) -> DataFrame:
    """Total over pods on a common time grid: loads add up, the host size is shared.

    Times go to the nearest bin, halves to the even one.
    """
    per_second = 1.0 / bin_seconds
    spot = F.rint(F.col("ts") * per_second) / per_second
    per_pod = df.groupBy(pod, spot.alias("_bin")).agg(
        F.avg("vcpu").alias("vcpu"),
        F.max("rss_mb").alias("rss_mb"),
        F.max("host_cpus").alias("host_cpus"),
    )
    total = per_pod.groupBy(F.col("_bin").alias("ts")).agg(
        F.sum("vcpu").alias("vcpu"),
        F.sum("rss_mb").alias("rss_mb"),
        F.max("host_cpus").alias("host_cpus"),
    )
    share = F.try_divide(F.col("vcpu"), F.col("host_cpus")) * 100.0
    return total.select(
        "ts",
        F.bround("vcpu", 4).alias("vcpu"),
        F.bround("rss_mb", 3).alias("rss_mb"),
        "host_cpus",
        F.bround(share, 4).alias("cpu_pct"),
    )


def metrics_pivot(
    events: DataFrame, fields: Sequence[str], kv: str = "kv", keys: Sequence[str] = ("component", "event", "ts")
) -> DataFrame:
    """One row per event with the named payload fields as numeric columns."""
    parsed = events.withColumn("_kv", parse_kv(kv))
    return parsed.select(*keys, *[F.col("_kv")[f].try_cast("double").alias(f) for f in fields])


def metrics_rollup(pivoted: DataFrame, fields: Sequence[str], keys: Sequence[str] = ("component", "event")) -> DataFrame:
    """Count of events and mean and maximum of each field per kind of event."""
    return pivoted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[agg(f).alias(f"{f}_{name}") for f in fields for name, agg in (("mean", F.avg), ("max", F.max))],
    )


def parse_metric_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Metric log lines ``ts,component,event,pod,kv``; commas inside the payload are kept."""
    parts = F.split(F.col(column), ",", 5)
    names = ("ts", "component", "event", "pod", "kv")
    return lines.filter(
        (F.trim(column) != "") & ~F.col(column).startswith(",".join(names))
    ).select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)])


def merge_traces(*traces: DataFrame) -> DataFrame:
    """All replica traces in one table; order by ``ts`` where a sorted table is wanted."""
    merged = traces[0]
    for t in traces[1:]:
        merged = merged.unionByName(t)
    return merged


def markdown_table(summary: DataFrame, order: Sequence[str], max_lines: int) -> str:
    """Text of a report table of at most ``max_lines`` rows; a longer one is refused."""
    rows = summary.orderBy(*order).limit(max_lines + 1).collect()
    if len(rows) > max_lines:
        raise ValueError(f"a report of more than {max_lines} rows belongs in a table sink")
    head = "| " + " | ".join(summary.columns) + " |"
    rule = "|" + "|".join(" --- " for _ in summary.columns) + "|"
    body = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]
    return "\n".join([head, rule, *body])


def kv_payload(fields: Mapping[str, Column]) -> Column:
    """JSON payload of a metric event."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
