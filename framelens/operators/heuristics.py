"""Quality estimates without a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.operators import clean
from framelens.operators.frames import (
    assign_frames,
    frame_statistics,
    rtp_frames,
    size_frames,
    unwrap_clock,
)

PACKET_COLUMNS = ["trace_id", "vca", "chunk", "t_us", "pkt_ord", "epoch_us", "length"]


def heuristic_packets(packets: DataFrame) -> DataFrame:
    """UDP video-sized packets to the receiver with most bytes among protocol-clean rows."""
    cleaned = clean.clean_protocol(packets)
    wanted = clean.video_sized(clean.udp_only(cleaned))
    return clean.keep_busiest(wanted, population=cleaned)


def size_heuristic_frames(packets: DataFrame) -> DataFrame:
    kept = heuristic_packets(packets).select(*PACKET_COLUMNS)
    return size_frames(clean.strip_header(assign_frames(kept)))


def ip_udp_heuristic(packets: DataFrame, fill_empty_seconds: bool = False) -> DataFrame:
    """Per-second quality from packet sizes and times only."""
    return frame_statistics(
        size_heuristic_frames(packets), tie="frame_num", trim=True, fill=fill_empty_seconds
    )


def received_rtp(packets: DataFrame) -> DataFrame:
    """RTP rows, protocol-clean, to the receiver with most bytes among all rows."""
    rows = clean.normal_payload_type(clean.clean_protocol(clean.rtp_only(packets)))
    return clean.keep_busiest(rows, population=packets)


def rtp_heuristic_frames(packets: DataFrame, ptypes: DataFrame, unwrap: bool = False) -> DataFrame:
    media = clean.video_sized(clean.media_packets(received_rtp(packets), ptypes))
    media = unwrap_clock(media) if unwrap else media
    return rtp_frames(clean.strip_header(media))


def rtp_heuristic(
    packets: DataFrame, ptypes: DataFrame, fill_empty_seconds: bool = False, unwrap: bool = False
) -> DataFrame:
    """Per-second quality from RTP timestamps and markers."""
    return frame_statistics(
        rtp_heuristic_frames(packets, ptypes, unwrap), tie="rtp_ts", fill=fill_empty_seconds
    )


METRICS = ["framesReceivedPerSecond", "bitrate", "frame_jitter"]


def to_predictions(seconds: DataFrame, labels: DataFrame, method: str) -> DataFrame:
    """Inner join of per-second estimates with labels, one row per metric, nulls dropped."""
    truth = labels.select(
        "trace_id", F.col("ts").alias("ft_end"), *[F.col(m).alias(f"_gt_{m}") for m in METRICS]
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(f"predicted_{m}").cast("double").alias("pred"),
                (
                    F.bround(F.col(f"_gt_{m}").cast("double"), 0)
                    if m == "framesReceivedPerSecond"
                    else F.col(f"_gt_{m}").cast("double")
                ).alias("gt"),
            )
            for m in METRICS
        ]
    )
    return (
        seconds.join(truth, ["trace_id", "ft_end"])
        .select("trace_id", "vca", F.col("ft_end").alias("ts"), F.explode(pairs).alias("p"))
        .select(
            "p.metric", F.lit(method).alias("method"), "vca", "trace_id", "ts", "p.pred", "p.gt"
        )
        .dropna()
    )
