"""A store of JSON payloads by content: each is kept once, as canonical text under its SHA-256, in gzip files below a folder per first byte.

Puts read the digests of the folders that they touch and append what isn't there; two puts at a time may store an object twice, which gets don't
show. It is all Spark's own readers and writers, so that the store may be wherever they reach.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.functions import values

#: Rows of spans, about, in one part of parted().
ROWS_A_TASK = 100_000
SCHEMA = "sha256 string, text string, prefix string"


def scratch(spark: SparkSession) -> str:
    """A new folder name that all executors reach: below spark.checkpoint.dir, or in the temporary folder of a local session without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/objects-{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """The rows from files below spark.checkpoint.dir, for plans that look at them several times; the files stay."""
    path = scratch(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def parts(frame: DataFrame, rows: int = ROWS_A_TASK) -> int:
    """In how many parts of about so many rows stored rows go: no less than shuffles have."""
    return max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-frame.count() // rows))


def parted(frame: DataFrame, key: str, rows: int = ROWS_A_TASK) -> DataFrame:
    """Stored rows parted by a key, in parts of about so many rows whatever the input, so that a task's memory doesn't grow with it.

    Windows, aggregates and joins on the key, or on it and others, stay in these parts.
    """
    return frame.repartition(parts(frame, rows), key)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def addressed(rows: DataFrame, column: str = "payload") -> DataFrame:
    """rows with the canonical text of a JSON payload and its sha256, null for null; what is no JSON is its own text."""
    return rows.withColumn("text", values.canonical_json(F.col(column))).withColumn("sha256", F.sha2("text", 256))


def put(rows: DataFrame, path: str, column: str = "payload") -> None:
    """Store the payloads of rows below `path` that aren't there. Payloads that differ in the order of keys or in blanks are one object; null is none."""
    spark = rows.sparkSession
    fresh = addressed(rows, column).where("sha256 is not null").select("sha256", "text").dropDuplicates(["sha256"]).withColumn("prefix", F.substring("sha256", 1, 2))
    if _exists(spark, path):
        fresh = fresh.join(spark.read.schema(SCHEMA).json(path).select("prefix", "sha256"), ["prefix", "sha256"], "left_anti")
    fresh.repartition("prefix").write.mode("append").partitionBy("prefix").option("compression", "gzip").json(path)


def get(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """sha256 and text of the objects that `wanted`(sha256) names, or of all; a digest that isn't stored has no row. The folders of other first bytes aren't read."""
    stored = spark.read.schema(SCHEMA).json(path)
    if wanted is not None:
        named = wanted.select("sha256", F.substring("sha256", 1, 2).alias("prefix")).distinct()
        stored = stored.join(named, ["prefix", "sha256"], "left_semi")
    return stored.select("sha256", "text").dropDuplicates(["sha256"])
