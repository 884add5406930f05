"""A table of versions that several writers may publish to at once.

Rows are written first, into a folder of their own. A version exists when its commit file does:
``commits/<number>`` is created only if it is not there yet, so of two writers that try the same
number one has to take the next. Readers see the folders that commits name, and nothing else; the
newest version follows from the commits.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT_SCHEMA = "version bigint, commit string, n_rows bigint"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, or not at all if there is one; False then.

    Local file systems know no such write through Hadoop, so a finished file is linked there.
    """
    place, system = _place(spark, path)
    local = urlparse(str(system.makeQualified(place))) if system.getScheme() == "file" else None
    if local is not None:
        made = f"{local.path}.{uuid.uuid4().hex}.tmp"
        os.makedirs(os.path.dirname(made), exist_ok=True)
        with open(made, "w") as out:
            out.write(text)
        try:
            os.link(made, local.path)
        except FileExistsError:
            return False
        finally:
            os.unlink(made)
        return True
    try:
        out = system.create(place, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(version, commit, n_rows) of everything published under ``path``."""
    place, system = _place(spark, f"{path}/commits")
    if not system.exists(place) or not [f for f in system.listStatus(place) if not f.getPath().getName().endswith(".tmp")]:
        return spark.createDataFrame([], COMMIT_SCHEMA)
    return spark.read.schema(COMMIT_SCHEMA).option("pathGlobFilter", "*.json").json(f"{path}/commits")


def publish(entry: DataFrame, path: str, commit: str | None = None, attempts: int = 1_000) -> int:
    """Append rows as the next version and return its number.

    A ``commit`` names the work, so that it is published once, however often it is tried: if the
    log has it already, that version's number comes back and nothing is written.
    """
    spark = entry.sparkSession
    name = commit or uuid.uuid4().hex
    known = commits(spark, path).where(F.col("commit") == name).first()
    if known:
        return known.version
    folder = f"{path}/rows/commit={name}"
    entry.write.mode("overwrite").parquet(folder)
    n = spark.read.parquet(folder).count()
    version = (commits(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    for _ in range(attempts):
        row = json.dumps({"version": version, "commit": name, "n_rows": n})
        if create_if_absent(spark, f"{path}/commits/{version:020d}.json", row):
            return version
        taken = commits(spark, path).where(F.col("version") == version).first()
        if taken and taken.commit == name:  # another try of the same work
            return version
        version += 1
    raise RuntimeError(f"no free version after {attempts} attempts")


def read_versions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all versions with ``version`` and ``commit``; rows without a commit are not there."""
    known = commits(spark, path).select("version", "commit")
    if known.isEmpty():
        return spark.createDataFrame([], f"{schema}, version bigint, commit string")
    rows = spark.read.schema(f"{schema}, commit string").parquet(f"{path}/rows")
    return rows.join(F.broadcast(known), "commit").select(*rows.columns[:-1], "version", "commit")


def latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the newest version; only its folder is read."""
    newest = commits(spark, path).orderBy(F.desc("version")).first()
    if newest is None:
        return spark.createDataFrame([], f"{schema}, version bigint")
    rows = spark.read.schema(schema).parquet(f"{path}/rows/commit={newest.commit}")
    return rows.withColumn("version", F.lit(newest.version).cast("bigint"))
