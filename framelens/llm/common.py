"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.session import cut_lineage  # noqa: F401

# Fixed value: the white space of all text contracts, [\x20\x09-\x0D].
BLANKS = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new path below the folder that driver and executors share; deleted when the JVM ends.

    The session's spark.checkpoint.dir is used. Only where it is unset and the master is local, as in
    tests, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = os.path.join(tempfile.mkdtemp(prefix="spark-"), "checkpoints")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The rows, written once to the shared folder and read back, so that later jobs start from files."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """A stored table, marked for broadcast if it has at most so many rows; else Spark shuffles the join.

    Only for tables of a few scalar columns that are already stored: counting them reads no data pages.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_or_empty(name: str = "text") -> Column:
    """The column under its own name, with nulls as empty strings."""
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def row_key(text: str = "text") -> Column:
    """A hash that tells rows with one doc_id, or with none, apart by their texts; rows equal in both share it."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), text_or_empty(text))


def spread(*key: str, ways: int = 64) -> Column:
    """A salt that deals the rows of one hot key to several tasks and is the same in every run."""
    return F.pmod(F.xxhash64(*key), F.lit(ways)).cast("int")


def free_prefix(columns: list[str], prefix: str) -> str:
    """The prefix, lengthened until no column begins with it, whatever the case of its letters."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix
