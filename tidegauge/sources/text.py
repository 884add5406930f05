"""Text and CSV files as rows, and the experiments a folder holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalars import NULL_TOKENS, natural_sort_key

EXPERIMENT_PATTERN = r"^exp"
_NO_NUMBER = 1_000_000


def read_table(spark: SparkSession, path: str | Sequence[str], **options) -> DataFrame:
    """CSV with a header; "not counted" cells are null, unnamed index columns are dropped."""
    df = spark.read.csv(path, header=True, nullValue=NULL_TOKENS[0], **options)
    unnamed = [c for i, c in enumerate(df.columns) if c.startswith("Unnamed:") or c == f"_c{i}"]
    return df.drop(*unnamed)


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(path, line_no, line)`` of text files, in file order.

    Files stay splittable: a line's number is its place in its file split plus the lines of the
    splits before it. Files that are too small to be split are opened once and numbered where their lines
    meet. A file with invalid UTF-8 anywhere is read as Latin-1.
    """
    conf = spark._jsparkSession.sessionState().conf()
    whole = min(conf.filesOpenCostInBytes(), conf.filesMaxPartitionBytes())  # no split of a larger file is smaller
    files = spark.read.text(path)
    size = F.col("_metadata.file_size")  # filtered before anything else, so that only the files wanted are opened

    def numbered(some: DataFrame) -> DataFrame:
        return some.select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_seq"),
            "value",
        )

    own = Window.partitionBy("path")
    small = numbered(files.where(size <= whole)).select(
        "path",
        (F.col("_seq") - F.min("_seq").over(own)).alias("line_no"),
        F.min(F.is_valid_utf8("value")).over(own).alias("_utf8"),
        "value",
    )
    raw = numbered(files.where(size > whole))
    splits = raw.groupBy("path", "_start").agg(
        F.min("_seq").alias("_first"),
        F.count(F.lit(1)).alias("_n"),
        F.bool_and(F.is_valid_utf8("value")).alias("_valid"),
    )
    before = own.orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.select(
        "path",
        "_start",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.min("_valid").over(own).alias("_utf8"),
    )
    large = raw.join(placed, ["path", "_start"]).select("path", (F.col("_seq") + F.col("_shift")).alias("line_no"), "_utf8", "value")
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    line = F.when(F.col("_utf8"), F.col("value")).otherwise(latin).alias("line")
    return small.unionByName(large).select("path", "line_no", line)


def split_path(df: DataFrame, path: str = "path") -> DataFrame:
    """Add ``scenario``, ``exp`` and ``file`` from the last three parts of a path."""
    parts = {"scenario": 1, "exp": 2, "file": 3}
    return df.withColumns(
        {n: F.regexp_extract(path, r"([^/]+)/([^/]+)/([^/]+)$", i) for n, i in parts.items()}
    )


def discover_experiments(
    files: DataFrame, pattern: str = EXPERIMENT_PATTERN, path: str = "path"
) -> DataFrame:
    """Distinct ``(scenario, exp, exp_no)`` of the CSV files in matching folders.

    ``exp_no`` is the first integer in the name; sort by scenario and ``exp_no``.
    """
    known = split_path(files, path).filter(
        F.col("file").endswith(".csv") & F.col("exp").rlike(pattern)
    )
    number = F.regexp_extract("exp", r"(\d+)", 1).try_cast("bigint")
    return (
        known.select("scenario", "exp")
        .distinct()
        .withColumn("exp_no", F.coalesce(number, F.lit(_NO_NUMBER)))
    )


def natural_position(names: DataFrame, name: str) -> DataFrame:
    """Distinct names with their place in natural order (a listing, one row per file)."""
    from tidegauge.operators.ordering import row_index

    keyed = names.select(name).distinct().withColumn("_key", natural_sort_key(name))
    placed = row_index(keyed, ["_key", name], name="position").drop("_key")
    return placed.withColumn("position", (F.col("position") + 1).cast("int"))
