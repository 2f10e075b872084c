"""Packet captures as text: comma-separated with a header, or tab-separated without."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelens.operators.chunks import assign_chunks
from framelens.session import listing
from framelens.sources.catalog import (
    IN_LAB,
    capture_app,
    capture_name,
    experiment_app,
    plain_path,
)

# Capture columns, in file order.
CAPTURE_COLUMNS = [
    "frame.time_relative",
    "frame.time_epoch",
    "ip.src",
    "ip.dst",
    "ip.proto",
    "ip.len",
    "udp.srcport",
    "udp.dstport",
    "udp.length",
    "rtp.ssrc",
    "rtp.timestamp",
    "rtp.seq",
    "rtp.p_type",
    "rtp.marker",
]
RAW = T.StructType([T.StructField(c, T.StringType()) for c in CAPTURE_COLUMNS])


def read_raw(spark: SparkSession, path: str, headered: bool = True) -> DataFrame:
    """Capture rows as strings, with ``path``. Files are split, so size does not matter."""
    reader = spark.read.schema(RAW).option("sep", "," if headered else "\t")
    reader = reader.option("header", headered).option("pathGlobFilter", "*.csv")
    with listing(spark):
        rows = reader.option("enforceSchema", True).csv(path)
    return rows.select("*", plain_path().alias("path"))


def typed(raw: DataFrame, dataset: str) -> DataFrame:
    """The packet schema. Casts never fail: a bad value becomes null, and ``ip_proto`` stays text
    because lists in it are meaningful. Rows without a time are dropped.

    Times are kept to the microsecond. What they say below that orders packets of one microsecond;
    files carry no packet number, so packets equal in that too are ordered by a hash of the row.
    """

    def c(name):
        return F.col(f"`{name}`")

    def micros(name):
        return F.round(c(name).try_cast("double") * 1e6).cast("bigint")

    nanos = c("frame.time_relative").try_cast("decimal(27,9)") * 1_000_000_000
    # From 0 to 1000, the rounded microsecond being in the middle.
    below = F.least(F.greatest(nanos.cast("bigint") - micros("frame.time_relative") * 1000 + 500, F.lit(0)), F.lit(1000))
    row_hash = F.xxhash64(*[c(n) for n in CAPTURE_COLUMNS]).bitwiseAND(F.lit((1 << 53) - 1))
    order = F.coalesce(below, F.lit(500)).cast("bigint") * (1 << 53) + row_hash

    parts = F.split("path", "/")
    vca = (
        experiment_app(F.element_at(parts, -2))
        if dataset in IN_LAB
        else capture_app(F.element_at(parts, -1))
    )
    first = F.get(F.split(c("udp.length"), ","), F.lit(0))
    return raw.select(
        F.lit(dataset).alias("dataset"),
        capture_name("path").alias("trace_id"),
        vca.alias("vca"),
        order.alias("pkt_ord"),
        micros("frame.time_relative").alias("t_us"),
        micros("frame.time_epoch").alias("epoch_us"),
        c("ip.src").alias("ip_src"),
        c("ip.dst").alias("ip_dst"),
        c("ip.proto").alias("ip_proto"),
        first.try_cast("double").cast("bigint").alias("length"),
        c("rtp.ssrc").alias("ssrc"),
        c("rtp.timestamp").try_cast("double").cast("bigint").alias("rtp_ts"),
        c("rtp.seq").try_cast("double").cast("bigint").alias("seq"),
        c("rtp.p_type").alias("p_type"),
        c("rtp.marker").try_cast("double").cast("int").alias("marker"),
    ).where(F.col("t_us").isNotNull())


def read_packets(
    spark: SparkSession,
    path: str,
    dataset: str,
    headered: bool = True,
    span_us: int | None = None,
) -> DataFrame:
    """Captures under ``path`` (a glob over one dataset) as packets, cut into chunks."""
    return assign_chunks(typed(read_raw(spark, path, headered), dataset), span_us)


def write_packets(packets: DataFrame, path: str) -> None:
    """Store packets as Parquet, one directory per dataset and application."""
    packets.write.mode("overwrite").partitionBy("dataset", "vca").parquet(path)
