"""The packet, label and catalog views over the supplied tables.

Used where no captures are at hand: every row of ``events`` becomes a packet, computed row by row
so the scan stays a projection. Fifteen users make one trace, so traces multiply with the data
while a trace keeps its rate; 30 days are replayed in about 52 s.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.functions import SECOND_US, idiv, second_of
from framelens.operators.chunks import assign_chunks

BASE_US = 1_704_067_200_000_000
REPLAY = 50_000
USERS_PER_TRACE = 15
DATASET = "events_view"


def packets(spark: SparkSession, sf_dir: str, span_us: int | None = None) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    eid, kind = F.col("event_id"), F.col("event_type")
    trace = idiv("user_id", USERS_PER_TRACE)
    t_us = idiv(F.unix_micros(F.col("ts").cast("timestamp")) - BASE_US, REPLAY)
    p_type = (
        F.when(kind.isin("click", "view"), "98")
        .when(kind == "purchase", "99")
        .when(kind == "signup", "111")
    )
    rows = ev.select(
        trace.alias("trace_id"),
        F.element_at(
            F.array(F.lit("meet"), F.lit("teams"), F.lit("webex")), (trace % 3 + 1).cast("int")
        ).alias("vca"),
        eid.alias("pkt_ord"),
        t_us.alias("t_us"),
        (t_us + BASE_US).alias("epoch_us"),
        F.when(eid % 13 == 0, "10.0.1.9").otherwise("10.0.1.1").alias("ip_src"),
        F.when(eid % 11 == 0, "10.0.0.9").otherwise("10.0.0.1").alias("ip_dst"),
        F.when(eid % 101 == 0, "1,17")
        .when(eid % 103 == 0, F.lit(None))
        .when(eid % 107 == 0, "6")
        .otherwise("17")
        .alias("ip_proto"),
        (
            F.least(F.lit(1200), 100 + 200 * F.floor(F.col("value") / 15)) + eid % 4
        ).alias("length"),
        F.when(p_type.isNotNull(), "0x1").alias("ssrc"),
        p_type.alias("p_type"),
        F.when(p_type.isNotNull(), idiv(t_us, 100_000) * 9000).alias("rtp_ts"),
        F.when(p_type.isNotNull(), idiv(t_us, 50_000)).alias("seq"),
        F.when((p_type == "98") & (eid % 10 < 7), 1)
        .when(p_type.isNotNull(), 0)
        .alias("marker"),
    )
    return assign_chunks(rows, span_us)


def payload_types(spark: SparkSession) -> DataFrame:
    rows = [
        (DATASET, vca, role, p)
        for vca in ("meet", "teams", "webex")
        for role, p in (("video", "98"), ("rtx", "99"))
    ]
    return spark.createDataFrame(rows, "dataset string, vca string, role string, p_type string")


def labels(pk: DataFrame) -> DataFrame:
    """Ground truth per (trace, second), from the RTP rows."""
    n = F.count_distinct("rtp_ts")
    return (
        pk.where(F.col("rtp_ts").isNotNull())
        .groupBy("trace_id", second_of("epoch_us").alias("ts"))
        .agg(
            n.alias("framesReceivedPerSecond"),
            (F.sum("length") * 8).alias("bitrate"),
            ((F.max("t_us") - F.min("t_us")) / 1000 / F.count(F.lit(1))).alias("frame_jitter"),
            F.when(n <= 6, 180).when(n <= 8, 360).otherwise(720).alias("frameHeight"),
        )
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace catalog from ``customer``: profile columns and a capture file name per trace."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    jitter = F.floor(F.abs("c_acctbal"))
    return c.select(
        F.lit(DATASET).alias("dataset"),
        F.lower("c_mktsegment").alias("vca"),
        key.alias("trace_id"),
        F.concat(
            F.lower("c_mktsegment"),
            F.lit("-chrome-"),
            F.concat_ws(
                "_",
                (nation * 100).cast("string"),
                jitter.cast("string"),
                (nation * 2).cast("string"),
                (nation % 5).cast("string"),
                (nation % 3).cast("string"),
                key.cast("string"),
            ),
            F.lit("-"),
            (F.lit(BASE_US // SECOND_US) + key).cast("string"),
            F.lit(".csv"),
        ).alias("csv_path"),
    )
