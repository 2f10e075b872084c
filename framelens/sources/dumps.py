"""Ground truth out of browser statistics dumps (one JSON document per call)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelens.functions import SECOND_US, idiv
from framelens.session import listing
from framelens.sources.catalog import capture_name, plain_path

# The statistics a call must have, in order.
STATS = [
    "ssrc",
    "lastPacketReceivedTimestamp",
    "framesPerSecond",
    "[bytesReceived_in_bits/s]",
    "[codec]",
    "packetsLost",
    "framesDropped",
    "framesReceived",
    "[framesReceived/s]",
    "[interFrameDelayStDev_in_ms]",
    "nackCount",
    "packetsReceived",
    "trackIdentifier",
    "freezeCount",
    "totalFreezesDuration",
    "pauseCount",
    "totalPausesDuration",
    "jitterBufferDelay",
    "[framesDecoded/s]",
    "jitterBufferEmittedCount",
    "frameHeight",
    "qpSum",
]
# Running totals, given back per step.
CUMULATIVE = ["framesReceived", "jitterBufferDelay", "jitterBufferEmittedCount", "qpSum"]
TEXT = ["[codec]", "trackIdentifier"]
# Output names that differ.
RENAMES = {
    "[framesReceived/s]": "framesReceivedPerSecond",
    "[framesDecoded/s]": "framesDecodedPerSecond",
    "[bytesReceived_in_bits/s]": "bitrate",
    "[interFrameDelayStDev_in_ms]": "frame_jitter",
}
DURATION_STAT = "[framesReceived/s]"
INBOUND = r"IT01V(\d+)-(.*)$"
DUMP = (
    "PeerConnections map<string, struct<stats: map<string, "
    "struct<startTime: string, endTime: string, values: string>>>>"
)


def read_dumps(spark: SparkSession, path: str) -> DataFrame:
    """(trace_id, body), one row per dump file; the id is the dump's own (see ``sources.linked``)."""
    with listing(spark):
        rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    return rows.select(capture_name(plain_path()).alias("trace_id"), F.col("value").alias("body"))


def _epoch_us(c) -> Column:
    return F.unix_micros(F.to_timestamp(c))


def stat_rows(dumps: DataFrame) -> DataFrame:
    """One row per inbound video statistic: connection and statistic order, stream id, values."""
    parsed = dumps.select("trace_id", F.from_json("body", DUMP).alias("d"))
    connections = parsed.select(
        "trace_id", F.posexplode(F.map_entries("d.PeerConnections")).alias("pc", "c")
    )
    return (
        connections.select(
            "trace_id", "pc", F.posexplode(F.map_entries("c.value.stats")).alias("pos", "s")
        )
        .select(
            "trace_id",
            "pc",
            "pos",
            F.regexp_extract("s.key", INBOUND, 1).alias("stream"),
            F.regexp_extract("s.key", INBOUND, 2).alias("stat"),
            _epoch_us("s.value.startTime").alias("start_us"),
            _epoch_us("s.value.endTime").alias("end_us"),
            F.from_json("s.value.values", "array<string>").alias("vals"),
        )
        .where(F.col("stream") != "")
    )


def active_streams(rows: DataFrame) -> DataFrame:
    """Distinct stream ids per connection."""
    return rows.select("trace_id", "pc", "stream").distinct()


def _frames() -> Column:
    return F.when(
        F.col("stat") == "framesPerSecond",
        F.aggregate(
            "vals", F.lit(0.0), lambda a, v: a + v.try_cast("double")
        ),
    )


def most_active(rows: DataFrame) -> DataFrame:
    """The stream used per dump: first connection with a candidate, most frames, then first seen."""
    per_stream = rows.groupBy("trace_id", "pc", "stream").agg(
        F.sum(_frames()).alias("frames"),
        F.max((F.col("stat") == "framesPerSecond").cast("int")).alias("has"),
        F.min("pos").alias("seen"),
    )
    return (
        per_stream.where(F.col("has") == 1)
        .groupBy("trace_id")
        .agg(
            F.min_by(
                F.struct("pc", "stream", "frames"),
                F.struct("pc", -F.coalesce("frames", F.lit(0.0)), "seen"),
            ).alias("s")
        )
        .select("trace_id", "s.*")
    )


def chosen_stats(rows: DataFrame) -> DataFrame:
    """The wanted statistics of the chosen stream, running totals turned into steps."""
    # As ``most_active``, over the few statistics of one dump, so that dumps are parsed and moved once.
    stream, dump = Window.partitionBy("trace_id", "pc", "stream"), Window.partitionBy("trace_id")
    has = F.max((F.col("stat") == "framesPerSecond").cast("int")).over(stream)
    place = F.struct(
        "pc", (-F.coalesce(F.sum(_frames()).over(stream), F.lit(0.0))).alias("less"), F.min("pos").over(stream).alias("seen")
    )
    wanted = (
        rows.where(F.col("trace_id").isNotNull())
        .repartition("trace_id")
        .withColumn("_place", F.when(has == 1, place))
        .withColumn("_best", F.min("_place").over(dump))
        .where((F.col("_place") == F.col("_best")) & F.col("stat").isin(STATS))
    )
    steps = F.transform(
        "vals",
        lambda v, i: F.when(i == 0, v).otherwise(
            (
                v.try_cast("double") - F.get("vals", i - 1).try_cast("double")
            ).cast("string")
        ),
    )
    numeric = ~F.col("stat").isin(TEXT)
    broken = (
        F.col("vals").isNull()
        | F.col("start_us").isNull()
        | F.col("end_us").isNull()
        | F.exists(
            "vals", lambda v: v.isNull() | (numeric & v.try_cast("double").isNull())
        )
    )
    return wanted.select(
        "trace_id",
        "stat",
        "start_us",
        "end_us",
        F.coalesce(broken, F.lit(True)).alias("broken"),
        F.when(F.col("stat").isin(CUMULATIVE), steps).otherwise(F.col("vals")).alias("vals"),
    )


def dump_status(dumps: DataFrame) -> DataFrame:
    """Per dump, why it gives no labels (null reason: it does). All statistics or nothing."""
    rows = stat_rows(dumps)
    streams = rows.groupBy("trace_id").agg(
        F.max((F.col("stat") == "framesPerSecond").cast("int")).alias("_seen")
    )
    stats = chosen_stats(rows).groupBy("trace_id").agg(
        F.count_distinct("stat").alias("_stats"),
        F.max(F.col("broken").cast("int")).alias("_broken"),
    )
    joined = dumps.select(
        "trace_id", F.from_json("body", DUMP)["PeerConnections"].isNull().alias("_bad")
    )
    joined = joined.join(streams, "trace_id", "left").join(stats, "trace_id", "left")
    reason = (
        F.when(F.col("_bad"), "unreadable dump")
        .when(F.col("_seen").isNull(), "no inbound stream")
        .when(F.col("_seen") == 0, "no frames seen")
        .when(F.col("_stats") < len(STATS), "statistic missing")
        .when(F.col("_broken") == 1, "statistic unreadable")
    )
    return joined.select("trace_id", reason.alias("reason"))


def second_rows(stats: DataFrame) -> DataFrame:
    """Long form: value i of a statistic belongs to second ``floor(start) + i`` before its end."""
    points = stats.select(
        "trace_id", "stat", "start_us", "end_us", F.posexplode("vals").alias("i", "value")
    ).withColumn("ts", idiv("start_us", SECOND_US) + F.col("i"))
    return points.where(F.col("ts") * SECOND_US < F.col("end_us"))


def read_labels(dumps: DataFrame) -> DataFrame:
    """One row per (trace, second) with a column per statistic, plus duration and num_vals.

    Dumps with any statistic missing or unreadable give no rows.
    """
    rows = stat_rows(dumps)
    stats = chosen_stats(rows)
    per_trace = Window.partitionBy("trace_id")  # 22 rows of one dump
    whole = (
        stats.withColumn("_ok", F.size(F.collect_set("stat").over(per_trace)) == len(STATS))
        .withColumn("_broken", F.max(F.col("broken").cast("int")).over(per_trace))
        .where(F.col("_ok") & (F.col("_broken") == 0))
    )
    seconds = second_rows(whole)
    is_duration = F.col("stat") == DURATION_STAT
    length = whole.where(is_duration).select(
        "trace_id",
        ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration"),
        F.greatest(
            F.lit(0),
            F.least(
                F.size("vals").cast("long"),
                idiv(F.col("end_us") - 1, SECOND_US) - idiv("start_us", SECOND_US) + 1,
            ),
        ).alias("num_vals"),
    )
    wide = seconds.groupBy("trace_id", "ts").pivot("stat", STATS).agg(F.first("value"))
    columns = [
        (F.col(f"`{s}`") if s in TEXT else F.col(f"`{s}`").try_cast("double")).alias(
            RENAMES.get(s, s)
        )
        for s in STATS
    ]
    return wide.select("trace_id", "ts", *columns).join(length, "trace_id")


def label_ranges(labels: DataFrame) -> DataFrame:
    """Per trace: label seconds spanned, call duration and number of frame samples."""
    return labels.groupBy("trace_id").agg(
        F.min("ts").alias("label_first"),
        F.max("ts").alias("label_last"),
        F.max("duration").alias("duration"),
        F.max("num_vals").alias("num_vals"),
    )
