"""Schema alignment: column discovery, ordering, naming and auditing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalars import clean_token, to_number

# Columns that are never features.
EXCLUDED = ("Unnamed: 0", "input_rate", "latency")


def clean_null_tokens(df: DataFrame) -> DataFrame:
    """Blank strings and "not counted" tokens become null in every string column."""
    return df.select(
        *[
            clean_token(F.col(f"`{f.name}`")).alias(f.name)
            if f.dataType.simpleString() == "string"
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def to_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Cast columns to finite doubles; what is not a number becomes null."""
    chosen = set(df.columns if cols is None else cols)
    return df.select(
        *[
            to_number(F.col(f"`{c}`")).alias(c) if c in chosen else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def numeric_counts(df: DataFrame, exclude: Sequence[str] = EXCLUDED) -> DataFrame:
    """Rows ``(column, position, numeric_count)`` for all candidate columns, in one pass."""
    cols = [c for c in df.columns if c not in set(exclude)]
    counted = df.agg(*[F.count(to_number(F.col(f"`{c}`"))).alias(f"c{i}") for i, c in enumerate(cols)])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(i).alias("position"),
                F.col(f"c{i}").alias("numeric_count"),
            )
            for i, c in enumerate(cols)
        ]
    )
    return counted.select(F.inline(rows))


def discover_numeric(df: DataFrame, exclude: Sequence[str] = EXCLUDED) -> list[str]:
    """Columns with at least one numeric value, in source order."""
    found = numeric_counts(df, exclude).filter("numeric_count > 0").orderBy("position")
    return [r["column"] for r in found.collect()]


def align_schema(
    df: DataFrame, features: Sequence[str], target: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Exactly ``features`` then ``target``: absent or missing features are 0.0, rows without
    a target are dropped."""
    have = set(df.columns)

    def number(c: str):
        return to_number(F.col(f"`{c}`")) if c in have else F.lit(None).cast("double")

    return df.select(
        *keep,
        *[F.coalesce(number(c), F.lit(0.0)).alias(c) for c in features],
        number(target).alias(target),
    ).na.drop(subset=[target])


def drop_any_null(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def prepare_training(
    df: DataFrame, features: Sequence[str], target: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Clean tokens, drop rows with any null (also in excluded columns), then align."""
    return align_schema(drop_any_null(clean_null_tokens(df)), features, target, keep)


def dedup_names(names: Sequence[str]) -> list[str]:
    """Suffix the second and later uses of a name with ``__dupN``."""
    seen: dict[str, int] = {}
    out = []
    for name in map(str, names):
        n = seen.get(name, 0)
        out.append(f"{name}__dup{n}" if n else name)
        seen[name] = n + 1
    return out


def rename_unique(df: DataFrame) -> DataFrame:
    return df.toDF(*dedup_names(df.columns))


def add_prefix(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.toDF(*[c if c in keep else f"{prefix}{c}" for c in df.columns])


def keep_first_columns(df: DataFrame) -> DataFrame:
    """Drop the later ones of columns with equal names."""
    marked = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    first: dict[str, int] = {}
    for i, name in enumerate(df.columns):
        first.setdefault(name, i)
    return marked.select(*[F.col(f"_{i}").alias(name) for name, i in first.items()])


def reorder_standard_first(df: DataFrame, standard: Sequence[str]) -> DataFrame:
    have = set(df.columns)
    front = [c for c in standard if c in have]
    return df.select(*[F.col(f"`{c}`") for c in front + [c for c in df.columns if c not in set(standard)]])


def schema_audit(names: DataFrame, expected: Sequence[str], key: str, column: str) -> DataFrame:
    """Per ``key``: column count, missing and extra names against ``expected``.

    ``names`` is long: one row per key and column name.
    """
    found = names.groupBy(key).agg(F.collect_set(column).alias("_have"))
    wanted = F.array(*[F.lit(c) for c in expected])
    missing = F.array_except(wanted, F.col("_have"))
    extra = F.array_sort(F.array_except(F.col("_have"), wanted))
    return found.select(
        key,
        F.size("_have").alias("cols"),
        F.lit(len(expected)).alias("expected"),
        F.size(missing).alias("missing_n"),
        F.size(extra).alias("extra_n"),
        missing.alias("missing"),
        extra.alias("extra"),
    )
