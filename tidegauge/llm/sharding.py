"""Sharding by extendible hashing.

A row belongs to the bucket named by the first bits of its hash. There is one bucket at first;
one whose rows are over the byte limit splits on the next bit, and only that one, until every
bucket fits. The directory maps hash prefixes to buckets. It is built from sums over prefixes,
never by moving rows: all depths are rolled up from one aggregate over a fine prefix, and only
buckets that are still too large at that depth are looked at with more bits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import col, cut_lineage, others, with_facts
from tidegauge.operators.ordering import row_index

HASH_BITS = 60
BYTE_LIMIT = 64 << 20
MORE_BITS = 5  # beyond those that evenly filled buckets would need
STEP_BITS = 10  # more for buckets that do not fit then
GROUP_ROWS = 100_000  # repeats of one row that one window may number


def row_hash(id_col: str, text_col: str):
    """60 bits of the MD5 of id and text."""
    text = [F.coalesce(col(c).cast("string"), F.lit("")) for c in (id_col, text_col)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *text)), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _directory(rows: DataFrame, bits: int, limit: int) -> DataFrame:
    """(key, depth, prefix, shard_bytes, repeat) of every prefix of ``bits`` bits; depth null: not deep enough.

    ``rows`` has hash and n_bytes. A bucket fits if it is within the limit or holds one hash only.
    """
    fine = rows.groupBy(F.shiftright("hash", HASH_BITS - bits).alias("key")).agg(
        F.sum("n_bytes").alias("bytes"), F.min("hash").alias("low"), F.max("hash").alias("high")
    )
    fine = cut_lineage(fine)
    at = fine.select("*", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    # Shift distances are columns here, so whole-number division by powers of two stands for it.
    prefix = (F.col("key") / F.pow(F.lit(2.0), F.lit(bits) - F.col("depth"))).cast("bigint")
    buckets = at.groupBy("depth", prefix.alias("prefix")).agg(
        F.sum("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    fit = buckets.where((F.col("bytes") <= limit) | (F.col("low") == F.col("high")))
    own = at.select("key", "depth", prefix.alias("prefix")).join(fit, ["depth", "prefix"])
    first = own.groupBy("key").agg(
        F.min(F.struct("depth", "prefix", "bytes", ((F.col("low") == F.col("high")) & (F.col("bytes") > limit)).alias("repeat"))).alias("b")
    )
    return cut_lineage(
        fine.select("key").join(first, "key", "left").select(
            "key", "b.depth", "b.prefix", F.col("b.bytes").alias("shard_bytes"), F.coalesce("b.repeat", F.lit(False)).alias("repeat")
        )
    )


def shard(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] | None = None,
    limit: int = BYTE_LIMIT,
) -> DataFrame:
    """``keep`` (the id by default) and n_bytes, depth, shard, shard_bytes of every row.

    The size of a row is its text's UTF-8 bytes, 0 for null. ``shard`` is ``b`` and the bucket's
    hash bits. Repeats of one row share a hash, so no bit parts them: if together they are over
    the limit, they fill overflow shards ``.0``, ``.1`` and so on of whole rows. A single row over
    the limit has a shard of its own. An empty table gives an empty one. Kept columns whose names
    clash with a result are left out.
    """
    results = ("n_bytes", "depth", "shard", "shard_bytes")
    kept = [c for c in others(docs, results) if c in (keep or [id_col])]
    size = F.coalesce(F.octet_length(col(text_col).cast("string")), F.lit(0)).cast("bigint")
    rows = docs.select(*[col(c) for c in kept], row_hash(id_col, text_col).alias("hash"), size.alias("n_bytes"))
    if not keep:
        rows = cut_lineage(rows)
    narrow = rows.select("hash", "n_bytes") if not keep else cut_lineage(rows.select("hash", "n_bytes"))

    total = narrow.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(HASH_BITS, MORE_BITS + max(1, math.ceil(math.log2(max(2, total / limit)))))
    found, left, level = rows, narrow, 0
    names = ("depth", "prefix", "shard_bytes", "repeat")
    while True:
        facts = _directory(left, bits, limit)
        named = facts.withColumnsRenamed({c: f"__{c}{level}" for c in names} | {"key": f"__key{level}"})
        found = _look_up(found, named, level, bits)
        level += 1
        open_keys = facts.where("depth is null").select(F.col("key").alias("_open"))
        if bits == HASH_BITS or open_keys.isEmpty():
            break
        left = cut_lineage(left.join(open_keys, F.shiftright("hash", HASH_BITS - bits) == F.col("_open"), "left_semi"))
        bits = min(HASH_BITS, bits + STEP_BITS)
    found = found.withColumns({c: F.coalesce(*[F.col(f"__{c}{i}") for i in range(level)]) for c in names if c != "repeat"})
    found = found.withColumn("repeat", F.greatest(F.lit(False), *[F.coalesce(F.col(f"__repeat{i}"), F.lit(False)) for i in range(level)]))

    bucket = F.concat(F.lit("b"), F.when(F.col("depth") > 0, F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0"))).otherwise(F.lit("")))
    cols = [col(c) for c in kept]
    plain = found.where(~F.col("repeat") | (F.col("shard_bytes") == F.col("n_bytes"))).select(
        *cols, "n_bytes", "depth", bucket.alias("shard"), "shard_bytes"
    )
    # Rows of one hash are alike; which of them lie in which overflow shard makes no difference.
    over = found.where(F.col("repeat") & (F.col("shard_bytes") > F.col("n_bytes")))
    over = cut_lineage(over.withColumn("_any", F.monotonically_increasing_id()))
    if over.isEmpty():
        return plain
    numbered = row_index(over, ["_any"], ["hash"], "_k", max_rows=GROUP_ROWS)
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("n_bytes"))).cast("bigint")
    part = F.floor(F.col("_k") / each).cast("bigint")
    rest = F.col("shard_bytes") / F.col("n_bytes") - part * each
    parts = numbered.select(
        *cols, "n_bytes", "depth", F.concat(bucket, F.lit("."), part.cast("string")).alias("shard"),
        (F.least(each, rest.cast("bigint")) * F.col("n_bytes")).alias("shard_bytes"),
    )
    return plain.unionByName(parts)


def _look_up(rows: DataFrame, facts: DataFrame, level: int, bits: int) -> DataFrame:
    """Directory entries of one level, joined on the prefix of the hash."""
    at = rows.withColumn("__at", F.shiftright("hash", HASH_BITS - bits))
    return with_facts(at, facts.withColumnRenamed(f"__key{level}", "__at"), "__at", "left").drop("__at")


def write_shards(sharded: DataFrame, path: str, shard_col: str = "shard") -> None:
    """One folder a shard; a task writes whole shards, each within the byte limit."""
    sharded.repartition(col(shard_col)).write.mode("overwrite").partitionBy(shard_col).parquet(path)
