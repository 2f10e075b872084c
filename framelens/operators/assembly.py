"""How well assembled frames match RTP frames, and packet-size structure of RTP frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelens.functions import idiv, second_after, second_of
from framelens.operators import clean
from framelens.operators.chunks import KEYS, in_chunk, total_before, with_previous
from framelens.operators.ranks import ecdf, quantiles
from framelens.sources.settings import SIZE_TOLERANCE, THROUGHPUT_BYTES, VIDEO_BYTES


def coalesce_rates(assigned: DataFrame, keys=("trace_id", "vca")) -> DataFrame:
    """Per trace, share of assembled frames that span more than one RTP timestamp."""
    pairs = assigned.select(*keys, "frame_num", "rtp_ts").distinct()
    frames = pairs.groupBy(*keys, "frame_num").agg(F.count("rtp_ts").alias("n"))
    return frames.groupBy(*keys).agg(
        F.avg((F.col("n") > 1).cast("int")).alias("frac_coalesce")
    )


def interleave_rates(assigned: DataFrame, keys=("trace_id", "vca")) -> DataFrame:
    """Per trace, share of RTP timestamps spread over more than one assembled frame."""
    pairs = assigned.where(F.col("rtp_ts").isNotNull()).select(*keys, "rtp_ts", "frame_num")
    stamps = pairs.distinct().groupBy(*keys, "rtp_ts").agg(F.count(F.lit(1)).alias("n"))
    return stamps.groupBy(*keys).agg(
        F.avg((F.col("n") > 1).cast("int")).alias("frac_interleave")
    )


def assembly_errors(assigned: DataFrame, keys=("trace_id", "vca")) -> DataFrame:
    return coalesce_rates(assigned, keys).join(interleave_rates(assigned, keys), list(keys))


def mean_assembly_errors(errors: DataFrame, keys=("vca",)) -> DataFrame:
    return errors.groupBy(*keys).agg(
        (F.avg("frac_coalesce") * 100).alias("coalesce_pct"),
        (F.avg("frac_interleave") * 100).alias("interleave_pct"),
    )


def sweep_frames(
    kept: DataFrame,
    depths: range,
    tolerance: int = SIZE_TOLERANCE,
    include_first: bool = False,
) -> DataFrame:
    """Every packet once per look-back depth, with that depth's ``frame_num``.

    How far back the nearest similar packet lies settles all depths at once, so packets move and
    sort once; they are only multiplied in front of the aggregation that follows.
    """
    deepest = max(depths)
    reach = deepest + (0 if include_first else 1)
    seen = with_previous(kept, ["length"], range(1, reach + 1))
    nearest = F.lit(deepest + 1)
    for k in range(deepest, 0, -1):
        near = F.abs(F.col(f"prev_{k}")["length"] - F.col("length")) <= tolerance
        if not include_first:
            near = near & F.col(f"prev_{k + 1}").isNotNull()
        nearest = F.when(near, k).otherwise(nearest)
    flags = seen.select(*kept.columns, nearest.alias("_k")).select(
        *kept.columns, *[(F.col("_k") > d).cast("long").alias(f"_new_{d}") for d in depths]
    )
    sums = flags.groupBy(*KEYS).agg(*[F.sum(f"_new_{d}").alias(f"_n_{d}") for d in depths])
    starts = sums.select(*KEYS, *[total_before(f"_n_{d}").alias(f"_s_{d}") for d in depths])
    upto = in_chunk().rowsBetween(Window.unboundedPreceding, 0)
    numbered = [
        F.struct(
            F.lit(d).alias("depth"),
            (F.col(f"_s_{d}") + F.sum(f"_new_{d}").over(upto)).alias("frame_num"),
        )
        for d in depths
    ]
    return (
        flags.join(starts, KEYS)
        .select(*kept.columns, F.array(*numbered).alias("_all"))
        .select(*kept.columns, F.inline("_all"))
    )


def sweep_fps_error(kept: DataFrame, labels: DataFrame, depths: range) -> DataFrame:
    """Frame-rate MAE (mean over traces) per application and look-back depth."""
    keys = ["trace_id", "vca", "depth"]
    frames = (
        sweep_frames(kept, depths)
        .groupBy(*keys, "frame_num")
        .agg(F.max("epoch_us").alias("frame_et"))
    )
    seconds = frames.groupBy(*keys, second_after("frame_et").alias("ts")).agg(
        F.count(F.lit(1)).alias("pred")
    )
    truth = labels.select("trace_id", "ts", F.col("framesReceivedPerSecond").alias("gt"))
    per_trace = (
        seconds.join(truth, ["trace_id", "ts"])
        .groupBy(*keys)
        .agg(F.avg(F.abs(F.col("pred") - F.col("gt"))).alias("mae"))
    )
    return per_trace.groupBy("vca", "depth").agg(F.avg("mae").alias("mae"))


def sweep_assembly_errors(kept: DataFrame, depths: range) -> DataFrame:
    """Mean coalesce and interleave percentages per application and look-back depth."""
    errors = assembly_errors(sweep_frames(kept, depths), ("trace_id", "vca", "depth"))
    return mean_assembly_errors(errors, ("vca", "depth"))


# A chunk of RTP time: 30 s of the 90 kHz clock.
CHUNK_TICKS = 2_700_000


def rtp_frame_sizes(packets: DataFrame) -> DataFrame:
    """Per RTP timestamp: packets, smallest and largest packet, and their difference.

    ``chunk`` cuts RTP time, the order these frames are compared in (arrival may differ).
    """
    return (
        packets.where(F.col("rtp_ts").isNotNull())
        .groupBy("trace_id", "vca", "rtp_ts")
        .agg(
            F.count(F.lit(1)).alias("n_pkts"),
            F.max("length").alias("max_size"),
            F.min("length").alias("min_size"),
            F.avg("length").alias("mean_size"),
        )
        .withColumn("size_range", F.col("max_size") - F.col("min_size"))
        .withColumn("chunk", idiv("rtp_ts", CHUNK_TICKS))
    )


def size_range_summary(sizes: DataFrame) -> DataFrame:
    """Per application: 96th percentile of the range and of the packets of a frame; shares of equal,
    near-equal and short frames; mean of the frames' mean packet sizes."""
    shares = sizes.groupBy("vca").agg(
        F.avg((F.col("size_range") <= 2).cast("int")).alias("within_2"),
        F.avg((F.col("size_range") == 0).cast("int")).alias("equal"),
        F.avg((F.col("n_pkts") < 4).cast("int")).alias("under_4_pkts"),
        F.avg("mean_size").alias("mean_size"),
        F.count(F.lit(1)).alias("n_frames"),
    )
    for value, name in (("size_range", "p96"), ("n_pkts", "p96_pkts")):
        shares = shares.join(quantiles(sizes, ["vca"], value, {name: 0.96}), "vca")
    return shares


def inter_frame_difference(sizes: DataFrame) -> DataFrame:
    """Per RTP frame but a trace's first: its own size range, and the larger distance of that to the
    range of the frame before."""
    seen = with_previous(
        sizes.select("trace_id", "vca", "chunk", "rtp_ts", "min_size", "max_size"),
        ["min_size", "max_size"],
        [1],
        order=["rtp_ts"],
    )
    before = F.col("prev_1")
    return seen.select(
        "trace_id",
        "vca",
        "rtp_ts",
        (F.col("max_size") - F.col("min_size")).alias("intra_diff"),
        F.greatest(
            F.abs(F.col("min_size") - before["max_size"]),
            F.abs(F.col("max_size") - before["min_size"]),
        ).alias("inter_diff"),
    ).where(F.col("inter_diff").isNotNull())


def frame_trace(assigned: DataFrame, trace_id, second: int) -> DataFrame:
    """Packets of one trace second with dense frame ids by both rules and last-packet flags."""
    rows = assigned.where(
        (F.col("trace_id") == F.lit(trace_id)) & (second_of("t_us") == second)
    )
    # One second of one trace.
    w = Window.partitionBy("trace_id")
    here = F.struct("t_us", "pkt_ord")
    return rows.select(
        "pkt_ord",
        "t_us",
        "length",
        F.dense_rank().over(w.orderBy("frame_num")).alias("size_frame"),
        F.dense_rank().over(w.orderBy("rtp_ts")).alias("rtp_frame"),
        (here == F.max(here).over(Window.partitionBy("trace_id", "frame_num"))).alias("is_last"),
    )


def media_flags(flow: DataFrame, ptypes: DataFrame, over: int = VIDEO_BYTES) -> DataFrame:
    """``is_video`` by RTP header (a video or retransmission type, above the size threshold) and
    ``is_video_pred`` by size alone, for the packets of ``clean.received_flow``."""
    typed = clean.with_role(clean.normal_payload_type(flow), ptypes)
    truth = F.col("ssrc").isNotNull() & F.col("role").isNotNull() & (F.col("length") > over)
    return clean.mark_video(typed, over).withColumn("is_video", truth.cast("int"))


def media_confusion(flow: DataFrame, ptypes: DataFrame) -> DataFrame:
    """Video by RTP header against video by size: counts and row percentages."""
    flagged = media_flags(flow, ptypes)
    counts = flagged.groupBy("vca", "is_video", "is_video_pred").agg(F.count(F.lit(1)).alias("n"))
    row = F.sum("n").over(Window.partitionBy("vca", "is_video"))
    return counts.withColumn("row_pct", F.col("n") / row * 100)


def misclassified(flow: DataFrame, ptypes: DataFrame) -> DataFrame:
    """Packets that are video by their size but not by their RTP header."""
    return media_flags(flow, ptypes).where((F.col("is_video_pred") == 1) & (F.col("is_video") == 0))


def payload_type_sizes(flow: DataFrame) -> DataFrame:
    """Packet sizes by payload type: share, smallest, largest, mean, 1 % quantile."""
    rtp = _typed_rtp(flow)
    keys = ["vca", "p_type"]
    basics = rtp.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("length").alias("min_size"),
        F.max("length").alias("max_size"),
        F.avg("length").alias("mean_size"),
    )
    share = F.col("n") / F.sum("n").over(Window.partitionBy("vca")) * 100
    return basics.withColumn("share_pct", share).join(
        quantiles(rtp, keys, "length", {"p1": 0.01}), keys
    )


def payload_type_ecdf(flow: DataFrame) -> DataFrame:
    return ecdf(_typed_rtp(flow), ["vca", "p_type"], "length")


def _typed_rtp(flow: DataFrame) -> DataFrame:
    return clean.normal_payload_type(clean.rtp_only(flow)).where(F.col("p_type").isNotNull())


def trace_durations(packets: DataFrame) -> DataFrame:
    """Seconds captured per application: last minus first packet, summed over traces."""
    spans = packets.groupBy("vca", "trace_id").agg(
        ((F.max("t_us") - F.min("t_us")) / 1e6).alias("s")
    )
    return spans.groupBy("vca").agg(
        F.sum("s").alias("seconds"), F.count(F.lit(1)).alias("n_traces")
    )


def throughput(packets: DataFrame, over: int = THROUGHPUT_BYTES) -> DataFrame:
    """Kbit/s per second of a trace, of packets above a size."""
    seconds = packets.where(F.col("length") > over).groupBy("trace_id", "vca", second_of("epoch_us").alias("ts"))
    return seconds.agg((F.sum("length") * 8 / 1000).alias("kbps"))


def throughput_against_labels(packets: DataFrame, labels: DataFrame) -> DataFrame:
    """Packet throughput next to the labelled bitrate of the same second, and the second counted from
    the trace's first with both."""
    truth = labels.select("trace_id", "ts", (F.col("bitrate") / 1000).alias("label_kbps"))
    # One row per second from here on.
    met = throughput(packets).join(truth, ["trace_id", "ts"])
    return met.withColumn("rel_s", F.col("ts") - F.min("ts").over(Window.partitionBy("trace_id")))


def peak_by_relative_second(rates: DataFrame) -> DataFrame:
    return rates.groupBy("vca", "rel_s").agg(
        F.max("kbps").alias("peak_kbps"), F.max("label_kbps").alias("peak_label_kbps")
    )
