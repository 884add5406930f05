"""Replaying tables as a staged record stream, and the record format."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalars import feature_vector
from tidegauge.operators.ordering import MAX_ROWS_PER_TASK, head_rows, row_index, tail_rows
from tidegauge.operators.schema import align_schema

RECORD_SCHEMA = "features map<string,double>, label double, send_ts string, stage string"


@dataclass(frozen=True)
class Stage:
    """A slice of a table: its first ("head") or last ("tail") rows, all when rows <= 0."""

    name: str
    table: str
    take: str
    rows: int
    order: tuple[str, ...]


# The default stages, by table name.
DEFAULT_STAGES = (
    Stage("stage0", "combined", "tail", 500, ("row_idx",)),
    Stage("stage1", "random_rates", "head", 1000, ("exp_order", "row_idx")),
    Stage("stage2", "resource_stimulus", "head", 1000, ("exp_order", "row_idx")),
    Stage("stage3", "intervention", "head", 1000, ("exp_order", "row_idx")),
)


def stage_replay(
    tables: Mapping[str, DataFrame],
    stages: Sequence[Stage],
    features: Sequence[str],
    target: str,
    whitelist: Sequence[str] = (),
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """``(stage_no, row_idx, stage, features.., target)`` in stage order.

    Rows are cut before they are aligned; stages whose table is missing are empty.
    """
    wanted = {w.strip().lower() for w in whitelist if w.strip()}
    parts = []
    for number, stage in enumerate(stages):
        if (wanted and stage.name.lower() not in wanted) or stage.table not in tables:
            continue
        take = tail_rows if stage.take == "tail" else head_rows
        cut = take(tables[stage.table], stage.rows, stage.order, max_rows)
        indexed = row_index(
            cut, stage.order, max_rows=max_rows, largest=stage.rows if stage.rows > 0 else None
        )
        parts.append(
            align_schema(indexed, features, target, keep=["row_idx"]).select(
                F.lit(number).alias("stage_no"), "row_idx", F.lit(stage.name).alias("stage"), *features, target
            )
        )
    if not parts:
        raise ValueError("no stage has a table")
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return merged


def encode_payload(
    df: DataFrame, features: Sequence[str], target: str, send_ts: Column, stage: str = "stage"
) -> Column:
    """JSON message of a record."""
    names = F.array(*[F.lit(c) for c in features])
    values = F.array(*[F.col(f"`{c}`") for c in features])
    return F.to_json(
        F.struct(
            F.map_from_arrays(names, values).alias("features"),
            F.col(target).alias("label"),
            send_ts.alias("send_ts"),
            F.col(stage).alias("stage"),
        )
    )


def decode_records(
    df: DataFrame, features: Sequence[str], value: str = "value", default_label: float | None = None
) -> DataFrame:
    """Add ``x``, ``label``, ``send_ts`` and ``stage`` from a JSON value; drop what is not JSON.

    Absent features are 0.0. A missing label stays null or takes the default; a send time
    that cannot be read is null.
    """
    record = F.from_json(F.col(value).cast("string"), RECORD_SCHEMA)
    label = F.col("_r.label")
    if default_label is not None:
        label = F.coalesce(label, F.lit(float(default_label)))
    parsed = df.withColumn("_r", record).filter(
        "_r.features is not null or _r.label is not null or _r.stage is not null"
    )
    return parsed.withColumns(
        {
            "x": feature_vector(F.coalesce(F.col("_r.features"), F.create_map().cast("map<string,double>")), features),
            "label": label,
            "send_ts": F.try_to_timestamp(F.col("_r.send_ts")),
            "stage": F.col("_r.stage"),
        }
    ).drop("_r")
