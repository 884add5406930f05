"""A corpus pipeline of five of the training-data operators.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``docs``. ``run`` writes each stage's result as Parquet into the shared folder
that the cluster names for checkpoints, and reads it back for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import checkpoint_dir, col, cut_lineage
from tidegauge.llm.decontamination import with_hits
from tidegauge.llm.mixing import mix
from tidegauge.llm.sharding import BYTE_LIMIT, shard
from tidegauge.llm.simhash import fingerprints, hexed, near_duplicates
from tidegauge.llm.toxicity import fit, score
from tidegauge.session import remove, ship_package

ORACLE_SQL = None  # learned scores and fingerprints have no SQL counterpart; tests compare with brute force


class Guarded:
    """Columns under names that no operator's results can clash with."""

    def __init__(self, docs: DataFrame):
        ship_package(docs.sparkSession)
        self.names = docs.columns
        self.safe = {c: f"c{i}__" for i, c in enumerate(docs.columns)}
        self.docs = docs.select(*[col(c).alias(s) for c, s in self.safe.items()])

    def __getitem__(self, name: str) -> str:
        return self.safe[name]

    def back(self, df: DataFrame, *more: str) -> DataFrame:
        return df.select(*[col(self.safe[c]).alias(c) for c in self.names if c not in more], *more)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score of 0.5 or more) go; unlabelled ones are scored alike.

    Null and empty texts have the base score of texts without hits; repeated rows share a score and
    stay or go together; a null id is never labelled. Without labels of both kinds nothing is learned
    and the base rate decides. An empty table gives an empty one; other columns pass through.
    """
    own = Guarded(docs)
    lexicon = fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(own.docs, lexicon, own.docs.columns, own["text"], "score__", "predicted__")
    return own.back(scored.where("predicted__ = 0"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays, once.

    Repeated rows of one id and text are one document. Of an id with different texts each counts by
    its own text: it stays only where that leads its group. Rows without an id go if their group has
    one with an id; of a group without any id one row stays. Null and empty texts are copies of each
    other. An empty table gives an empty one; other columns pass through.
    """
    own = Guarded(docs)
    doc, text = own["doc_id"], own["text"]
    groups = cut_lineage(near_duplicates(own.docs, doc, text, shingle=3, max_distance=2))
    # The row that stays of each group: its id, and the fingerprint where an id has several texts.
    first = groups.where(F.col(doc) == F.col("component_id")).groupBy("component_fp", F.col(doc).alias("id"))
    first = first.agg(F.min("fingerprint").alias("kept_fp"))
    often = groups.where(F.col(doc).isNotNull()).groupBy(F.col(doc).alias("often")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    first = cut_lineage(first.join(often, F.col("id") == F.col("often"), "left").select("id", "kept_fp", F.col("n").isNotNull().alias("again")))
    once, again = first.where("not again"), first.where("again")
    same = F.col(doc) == F.col("id")
    kept = own.docs.join(once, same, "left_semi")
    if not again.isEmpty():
        repeated = fingerprints(own.docs.join(again, same, "left_semi"), own.docs.columns, text, shingle=3)
        repeated = repeated.join(again, same & (hexed("fp") == F.col("kept_fp")), "left_semi")
        whole = F.struct(*[F.col(c) for c in own.docs.columns])
        one = repeated.groupBy(doc, "fp").agg(F.min_by(whole, F.col(text)).alias("row"))
        kept = kept.unionByName(one.select("row.*"))
    unnamed = groups.where("component_id is null").select("component_fp").distinct()
    if not unnamed.isEmpty():
        nameless = fingerprints(own.docs.where(F.col(doc).isNull()), own.docs.columns, text, shingle=3)
        lone = nameless.join(unnamed, hexed("fp") == F.col("component_fp"), "left_semi")
        kept = kept.unionByName(lone.dropDuplicates(["fp"]).drop("fp"))
    return own.back(kept)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; repeated rows stay or go together, whatever their ids;
    an empty table of documents or items leaves the documents as they are.
    """
    own = Guarded(docs)
    found = with_hits(own.docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), own.docs.columns, own["text"])
    return own.back(found.where(F.size("hits") == 0))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it.

    Null and empty texts have size 0 and follow their source's whole copies; a null source is a
    source; of repeated rows as many are taken as the mix needs. Ties in the order of a sample go to
    the smaller size, then to the smaller id. An empty table gives an empty one.
    """
    own = Guarded(docs)
    mixed = mix(own.docs, own["doc_id"], own["text"], own["source"], keep=own.docs.columns)
    return own.back(mixed.withColumn("copy__", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))))


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the shard each belongs to.

    A null text counts as empty, a null id hashes like an empty one; repeated rows beyond the limit
    fill shards of their own. Columns of the documents named like a result are replaced. An empty
    table gives an empty one.
    """
    own = Guarded(docs)
    cut = shard(own.docs, own["doc_id"], own["text"], keep=own.docs.columns, limit=BYTE_LIMIT)
    return own.back(cut, "n_bytes", "depth", "shard", "shard_bytes")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-duplicates", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("source mixing", mix_sources),
    ("sharding", cut_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows. What the others wrote is removed at the end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    for i in range(len(STAGES) - 1):
        remove(spark, f"{folder}/{i}")
    return docs
