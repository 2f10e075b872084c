"""Row cleaning and flow selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelens.functions import first_payload_type
from framelens.operators.chunks import KEYS, whole_trace
from framelens.sources.settings import RTP_HEADER_BYTES, VIDEO_BYTES


def clean_protocol(df: DataFrame) -> DataFrame:
    """Drop rows without a protocol or with a tunnelled list; make it an integer."""
    raw = F.col("ip_proto")
    return df.where(raw.isNotNull() & ~raw.contains(",")).withColumn(
        "ip_proto", raw.try_cast("double").cast("int")
    )


def udp_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("ip_proto") == 17)


def video_sized(df: DataFrame, over: int = VIDEO_BYTES) -> DataFrame:
    return df.where(F.col("length") > over)


def mark_video(df: DataFrame, over: int = VIDEO_BYTES) -> DataFrame:
    return df.withColumn("is_video_pred", (F.col("length") > over).cast("int"))


def strip_header(df: DataFrame, by: int = RTP_HEADER_BYTES) -> DataFrame:
    return df.withColumn("length", F.col("length") - by)


def rtp_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("ssrc").isNotNull())


def normal_payload_type(df: DataFrame) -> DataFrame:
    return df.withColumn("p_type", first_payload_type("p_type"))


def busiest_endpoint(population: DataFrame, endpoint: str = "ip_dst") -> DataFrame:
    """The endpoint with most bytes per trace, given once per chunk of the trace.

    Bytes are summed per (trace, chunk, endpoint) before any trace-wide step, so a long trace is
    never gathered; the answer comes back per chunk and joins without moving packets by trace.
    Equal sums go to the smallest address.
    """
    parts = (
        population.where(F.col(endpoint).isNotNull())
        .groupBy(*KEYS, endpoint)
        .agg(F.sum("length").alias("bytes"))
    )
    return _first_per_trace(
        parts.withColumn("_rank", -F.sum("bytes").over(Window.partitionBy("trace_id", endpoint))),
        endpoint,
    )


def _first_per_trace(parts: DataFrame, value: str) -> DataFrame:
    """The value with the lowest ``_rank`` of each trace (ties: smallest), for each chunk.

    Reduced to one row per chunk before the trace-wide step.
    """
    low = parts.groupBy(*KEYS).agg(F.min(F.struct("_rank", value)).alias("_low"))
    best = F.min("_low").over(whole_trace())
    return low.select(*KEYS, best[value].alias("_best"))


def keep_busiest(
    df: DataFrame, population: DataFrame | None = None, endpoint: str = "ip_dst"
) -> DataFrame:
    """Keep the rows of the top receiver (or sender) of each trace.

    ``population`` is the set of rows whose bytes decide; it defaults to ``df`` itself.
    """
    best = busiest_endpoint(df if population is None else population, endpoint)
    return df.join(best, KEYS).where(F.col(endpoint) == F.col("_best")).drop("_best")


def received_flow(packets: DataFrame) -> DataFrame:
    """What one sender sent to the receiver over UDP: clean protocol, busiest receiver, then of what
    is left the busiest sender."""
    received = udp_only(keep_busiest(clean_protocol(packets)))
    return keep_busiest(received, endpoint="ip_src")


def received_frames(packets: DataFrame, over: int = VIDEO_BYTES) -> DataFrame:
    """RTP packets of video size that reached the busiest receiver of all packets."""
    return keep_busiest(video_sized(rtp_only(packets), over), population=packets)


def with_role(df: DataFrame, ptypes: DataFrame) -> DataFrame:
    """Add ``role`` ('video', 'rtx' or null) by payload type.

    ``ptypes`` holds one row per (vca, role, p_type) of one dataset: a settings table of a few
    rows whose size does not depend on the data, hence the broadcast.
    """
    roles = ptypes.select("vca", "p_type", "role").distinct()
    return df.join(F.broadcast(roles), ["vca", "p_type"], "left")


def media_packets(df: DataFrame, ptypes: DataFrame) -> DataFrame:
    """Packets whose payload type is a video or retransmission type of the application."""
    wanted = ptypes.select("vca", "p_type").distinct()
    return df.join(F.broadcast(wanted), ["vca", "p_type"], "left_semi")


def rtp_model_packets(df: DataFrame, ptypes: DataFrame, over: int = VIDEO_BYTES) -> DataFrame:
    """Video packets of any size and retransmissions above the size threshold, with ``role``."""
    return with_role(df, ptypes).where(
        (F.col("role") == "video") | ((F.col("role") == "rtx") & (F.col("length") > over))
    )


def dominant_payload_type(df: DataFrame) -> DataFrame:
    """Per trace, the payload type with the largest mean length, given once per chunk."""
    parts = (
        normal_payload_type(df)
        .where(F.col("p_type").isNotNull())
        .groupBy(*KEYS, "p_type")
        .agg(F.sum("length").alias("bytes"), F.count("length").alias("n"))
    )
    w = Window.partitionBy("trace_id", "p_type")
    mean = F.sum("bytes").over(w) / F.sum("n").over(w)
    return _first_per_trace(parts.withColumn("_rank", -mean), "p_type")


def keep_dominant_payload_type(df: DataFrame) -> DataFrame:
    best = dominant_payload_type(df)
    return (
        normal_payload_type(df)
        .join(best, KEYS)
        .where(F.col("p_type") == F.col("_best"))
        .drop("_best")
    )
