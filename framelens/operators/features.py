"""Features per prediction window from packet sizes, times and RTP headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelens.functions import SECOND_US
from framelens.operators import clean
from framelens.operators.chunks import KEYS, ORDER, in_chunk, total_before, whole_trace, with_previous
from framelens.operators.frames import unwrap_clock
from framelens.operators.heuristics import received_rtp
from framelens.operators.windows import anchor_table, assign_windows
from framelens.sources.settings import VECTOR_WIDTH, by_app

WINDOW = ["trace_id", "vca", "interval", "et"]
BURST_GAP_MS = 30
# What a statistic of nothing is.
NO_BUFFER, NO_SPAN, NO_LAG = 0.0, -1.0, 100000.0
# Ticks a second, and numbers after which RTP sequence numbers start again.
RTP_CLOCK = 90_000
SEQ_RANGE = 1 << 16


def statistics(value, prefix: str, default: float | None = None) -> list[Column]:
    """mean, population std, min, max and quartiles of a column within a group."""
    value = F.col(value) if isinstance(value, str) else value
    quart = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    named = {
        "mean": F.avg(value),
        "std": F.stddev_pop(value),
        "min": F.min(value),
        "max": F.max(value),
        "q1": quart[0],
        "q2": quart[1],
        "q3": quart[2],
    }
    if default is not None:
        named = {k: F.coalesce(c, F.lit(default)) for k, c in named.items()}
    return [c.alias(f"{prefix}_{k}") for k, c in named.items()]


def with_iat(packets: DataFrame) -> DataFrame:
    """Add ``iat`` (ms since the packet before, across windows; the first gets its own time)."""
    seen = with_previous(packets, ["t_us"], [1])
    gap = F.coalesce(F.col("t_us") - F.col("prev_1")["t_us"], F.col("t_us"))
    return seen.select(*packets.columns, (gap / 1000).alias("iat"))


def with_next_iat(packets: DataFrame) -> DataFrame:
    """Add ``next_iat`` (seconds to the packet after; null at the end of the trace)."""
    firsts = packets.groupBy(*KEYS).agg(F.min("t_us").alias("_first"))
    later = Window.partitionBy("trace_id").orderBy("chunk").rowsBetween(1, 1)
    ahead = firsts.select(*KEYS, F.max("_first").over(later).alias("_next"))
    after = F.coalesce(F.lead("t_us").over(in_chunk()), F.col("_next"))
    return packets.join(ahead, KEYS).select(
        *packets.columns, ((after - F.col("t_us")) / 1e6).alias("next_iat")
    )


def model_packets(packets: DataFrame) -> DataFrame:
    """UDP video-sized packets to the receiver with most bytes among UDP rows."""
    udp = clean.udp_only(clean.clean_protocol(packets))
    kept = clean.keep_busiest(clean.video_sized(udp), population=udp)
    return kept.select("trace_id", "vca", "chunk", "t_us", "pkt_ord", "epoch_us", "length")


def windowed_packets(kept: DataFrame, window_us: int = SECOND_US) -> DataFrame:
    """Packets with inter-arrival time and prediction window."""
    return assign_windows(with_iat(kept), window_us, table=anchor_table(kept, window_us))


def size_statistics() -> list[Column]:
    return [
        *statistics("length", "l"),
        F.count(F.lit(1)).alias("l_num_pkts"),
        F.sum("length").alias("l_num_bytes"),
        F.size(F.collect_set("length")).cast("long").alias("l_num_unique"),
    ]


def iat_statistics() -> list[Column]:
    bursts = F.count_if(F.col("iat") >= BURST_GAP_MS)
    return [
        *statistics("iat", "t"),
        F.when(F.count(F.lit(1)) <= 1, 0).otherwise(bursts).alias("t_burst_count"),
    ]


def first_values(windowed: DataFrame, value: str, name: str) -> DataFrame:
    """The first values of a window in trace order, padded with zeros to the application's width.

    Ranks are cut off before rows move (a group limit in the plan), so no more than the widest
    vector is ever gathered.
    """
    order = Window.partitionBy(*WINDOW).orderBy(*ORDER)
    first = windowed.select(
        *WINDOW, F.col(value).cast("double").alias("_v"), F.row_number().over(order).alias("_rn")
    ).where(F.col("_rn") <= max(VECTOR_WIDTH.values()))
    width = by_app(VECTOR_WIDTH, 600)
    held = F.sort_array(F.collect_list(F.struct("_rn", "_v")))["_v"]
    return first.groupBy(*WINDOW).agg(held.alias(name)).withColumn(
        name, F.slice(F.concat(name, F.array_repeat(F.lit(0.0), width)), F.lit(1), width)
    )


def window_features(
    windowed: DataFrame, groups: tuple[str, ...] = ("LSTATS", "TSTATS"), compat: bool = False
) -> DataFrame:
    """One row per window with the chosen groups: LSTATS, TSTATS, SIZE, IAT.

    The statistics come from one aggregation. Quartiles are exact and kept as counts per distinct
    value, whose number is bounded by packet sizes and by microseconds. ``compat`` also keeps the
    absolute second ``t_et`` among the features, next to the inter-arrival statistics.
    """
    unknown = set(groups) - {"LSTATS", "TSTATS", "SIZE", "IAT"}
    if unknown:
        raise ValueError(f"unknown feature groups {sorted(unknown)}")
    columns: list[Column] = []
    if "LSTATS" in groups:
        columns += size_statistics()
    if "TSTATS" in groups:
        columns += iat_statistics()
    parts = [windowed.groupBy(*WINDOW).agg(*columns)] if columns else []
    if "SIZE" in groups:
        parts.append(first_values(windowed, "length", "sizes"))
    if "IAT" in groups:
        parts.append(first_values(windowed, "iat", "iats"))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, WINDOW)
    if compat and "TSTATS" in groups:
        out = out.withColumn("t_et", F.col("et"))
    return out


def spread(features: DataFrame, array: str, prefix: str, width: int) -> DataFrame:
    """A fixed-width array as ``<prefix>_1 ... <prefix>_<width>`` columns."""
    return features.select(
        *[c for c in features.columns if c != array],
        *[F.get(array, F.lit(i)).alias(f"{prefix}_{i + 1}") for i in range(width)],
    )


def retransmission_count(windowed: DataFrame) -> DataFrame:
    """Per window, packets whose size is another seen size plus two bytes."""
    sizes = windowed.groupBy(*WINDOW, "length").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*WINDOW).orderBy("length").rangeBetween(-2, -2)
    base = F.count(F.lit(1)).over(w) > 0
    return (
        sizes.select(*WINDOW, F.when(base, F.col("n")).otherwise(0).alias("n"))
        .groupBy(*WINDOW)
        .agg(F.sum("n").alias("num_rtx"))
    )


def longest_window(windowed: DataFrame) -> DataFrame:
    """Packets of the fullest window, per application."""
    counts = windowed.groupBy(*WINDOW).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("vca").agg(F.max("n").alias("max_size"))


RTP_COLUMNS = [
    "trace_id",
    "vca",
    "chunk",
    "t_us",
    "pkt_ord",
    "epoch_us",
    "length",
    "rtp_ts",
    "seq",
    "marker",
    "role",
]


def rtp_model_packets(packets: DataFrame, ptypes: DataFrame) -> DataFrame:
    """Video packets and large retransmissions to the receiver with most bytes."""
    return clean.rtp_model_packets(received_rtp(packets), ptypes).select(*RTP_COLUMNS)


def clock_origin(kept: DataFrame) -> DataFrame:
    """Per chunk: the smallest RTP timestamp of the trace, the last arrival carrying it, and the
    number of packets before the chunk."""
    by_ts = kept.groupBy(*KEYS, "rtp_ts").agg(
        F.max("t_us").alias("t"), F.count(F.lit(1)).alias("n")
    )
    parts = by_ts.groupBy(*KEYS).agg(
        F.min(F.struct("rtp_ts", "t")).alias("low"), F.sum("n").alias("n")
    )
    rtp0 = F.min(F.col("low")["rtp_ts"]).over(whole_trace())
    return parts.select(
        *KEYS, "low", rtp0.alias("rtp0"), total_before("n").alias("idx0")
    ).select(
        *KEYS,
        "rtp0",
        F.max(F.when(F.col("low")["rtp_ts"] == F.col("rtp0"), F.col("low")["t"]))
        .over(whole_trace())
        .alias("t0"),
        "idx0",
    )


def rtp_features(
    kept: DataFrame, window_us: int = SECOND_US, compat: bool = False, unwrap: bool = False
) -> DataFrame:
    """Header features per right-closed window.

    Packets are first reduced to one row per (window, RTP timestamp); everything else works on
    those. ``compat`` gives the constant -1 for the packet-span statistics. With
    ``unwrap`` timestamps and sequence numbers run on where their counters start again.
    """
    if unwrap:
        kept = unwrap_clock(kept)
    seen = with_previous(kept, ["seq"], [1])
    step = F.col("seq") - F.col("prev_1")["seq"]
    step = F.pmod(step, F.lit(SEQ_RANGE)) if unwrap else step
    broken = F.coalesce(step != 1, F.lit(False))
    flagged = seen.select(
        *kept.columns, ((F.col("role") == "video") & broken).cast("int").alias("ooo")
    )
    based = (
        flagged.join(clock_origin(kept), KEYS)
        .withColumn("pkt_idx", F.col("idx0") + F.row_number().over(in_chunk()) - 1)
        .drop("idx0")
    )
    placed = assign_windows(
        based, window_us, closed="right", table=anchor_table(kept, window_us)
    )
    video, rtx = F.col("role") == "video", F.col("role") == "rtx"
    stamps = placed.groupBy(*WINDOW, "rtp_ts", "rtp0", "t0").agg(
        F.max(video.cast("int")).alias("vid"),
        F.max(rtx.cast("int")).alias("rtx"),
        F.sum(F.when(video, F.col("marker"))).alias("vid_marks"),
        F.sum(F.when(rtx, F.col("marker"))).alias("rtx_marks"),
        F.sum("ooo").alias("ooo"),
        F.max("t_us").alias("t_last"),
        (F.max("pkt_idx") - F.min("pkt_idx")).alias("span"),
    )
    # A timestamp's lag is counted in the window of its last packet, from its last arrival.
    one_stamp = Window.partitionBy("trace_id", "rtp_ts")
    in_window = Window.partitionBy(*WINDOW).orderBy("rtp_ts")
    actual = (F.max("t_last").over(one_stamp) - F.col("t0")) / 1e6
    expected = (F.col("rtp_ts") - F.col("rtp0")) / F.lit(RTP_CLOCK)
    timed = stamps.select(
        "*",
        (90 / (F.col("rtp_ts") - F.lag("rtp_ts").over(in_window))).alias("buffer"),
        F.when(
            F.col("interval") == F.max("interval").over(one_stamp), actual - expected
        ).alias("lag"),
    )
    span = F.lit(None).cast("double") if compat else F.col("span").cast("double")
    both = (F.col("vid") == 1) & (F.col("rtx") == 1)
    return timed.groupBy(*WINDOW).agg(
        F.sum("vid").alias("vid_ts_unique"),
        F.sum("rtx").alias("rtx_ts_unique"),
        F.coalesce(F.sum("vid_marks"), F.lit(0)).alias("vid_marker_sum"),
        F.coalesce(F.sum("rtx_marks"), F.lit(0)).alias("rtx_marker_sum"),
        F.count_if(both).alias("common_vid_rtx_ts_unique"),
        F.count(F.lit(1)).alias("union_ts_unique"),
        F.sum("ooo").alias("ooo_seqno_vid"),
        *statistics("buffer", "buffer_time", NO_BUFFER),
        *statistics(span, "n_pkt_diff", NO_SPAN),
        *statistics("lag", "rtp_lag", NO_LAG),
    )


def join_rtp_features(packet_features: DataFrame, header_features: DataFrame) -> DataFrame:
    """Inner join on the end second; windows that share one multiply."""
    return packet_features.join(
        header_features.drop("vca", "interval"), ["trace_id", "et"]
    )


def join_labels(
    features: DataFrame, labels: DataFrame, metrics: list[str], every: bool = True
) -> DataFrame:
    """Inner join on end second = label second, rows with a missing label dropped.

    With ``every=False`` a row stays as long as it has one of the labels.
    """
    truth = labels.select("trace_id", F.col("ts").alias("et"), *metrics)
    joined = features.join(truth, ["trace_id", "et"])
    return joined.dropna("any" if every else "all", subset=metrics)


# What identifies a row or labels it, never a model input.
NOT_FEATURES = {
    "metric", "et", "ts", "file", "interval", "trace_id", "vca", "dataset", "fold", "chunk",
}


def feature_columns(features: DataFrame, metrics: list[str]) -> list[str]:
    drop = NOT_FEATURES | set(metrics)
    return sorted(c for c in features.columns if c not in drop)


def ip_udp_features(packets: DataFrame, window_us: int = SECOND_US, **options) -> DataFrame:
    return window_features(windowed_packets(model_packets(packets), window_us), **options)


def rtp_ml_features(
    packets: DataFrame,
    ptypes: DataFrame,
    window_us: int = SECOND_US,
    groups: tuple[str, ...] = ("LSTATS", "TSTATS"),
    compat: bool = False,
    unwrap: bool = False,
) -> DataFrame:
    kept = rtp_model_packets(packets, ptypes)
    narrow = kept.select(*[c for c in RTP_COLUMNS if c not in ("rtp_ts", "seq", "marker", "role")])
    packet = window_features(windowed_packets(narrow, window_us), groups, compat)
    return join_rtp_features(packet, rtp_features(kept, window_us, compat, unwrap))


def sender_features(
    packets: DataFrame, ptypes: DataFrame | None = None, window_us: int = SECOND_US, **options
) -> DataFrame:
    """Features after also keeping only the busiest sender (the stored-feature variant)."""
    if ptypes is None:
        cleaned = clean.clean_protocol(packets)
        rows = clean.keep_busiest(
            clean.video_sized(clean.udp_only(cleaned)), population=cleaned
        )
        kept = clean.keep_busiest(rows, endpoint="ip_src").select(
            "trace_id", "vca", "chunk", "t_us", "pkt_ord", "epoch_us", "length"
        )
        return window_features(windowed_packets(kept, window_us), **options)
    rows = clean.rtp_model_packets(received_rtp(packets), ptypes)
    kept = clean.keep_busiest(rows, endpoint="ip_src").select(*RTP_COLUMNS)
    packet = window_features(windowed_packets(kept, window_us), **options)
    return join_rtp_features(packet, rtp_features(kept, window_us))
