"""Video frames from packets: by size similarity, or by RTP timestamp."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelens.functions import SECOND_US, idiv, is_freeze, second_after
from framelens.operators.chunks import (
    KEYS,
    ORDER,
    in_chunk,
    nearest_before,
    total_before,
    whole_trace,
    with_previous,
)
from framelens.sources.settings import LOOKBACK, SIZE_TOLERANCE, by_app

# Frames in the mean duration, and the gap that ends the warm-up.
MEAN_FRAMES = 30
# Fixed value: RTP timestamps start again at 0 after so many ticks.
CLOCK_RANGE = 1 << 32
WARM_UP_GAP_US = 8 * SECOND_US


def assign_frames(
    packets: DataFrame,
    lookback: Column | int | None = None,
    max_lookback: int | None = None,
    tolerance: int = SIZE_TOLERANCE,
    include_first: bool = False,
) -> DataFrame:
    """Add ``frame_num``: a packet stays in the current frame if one of the packets before it, up
    to ``lookback`` back, differs by at most ``tolerance`` bytes; otherwise it starts a frame.

    The first packet of a trace is not compared with unless ``include_first``.
    """
    if lookback is None:
        lookback, max_lookback = by_app(LOOKBACK, 1), max(LOOKBACK.values())
    elif isinstance(lookback, int):
        lookback, max_lookback = F.lit(lookback), lookback
    reach = max_lookback + (0 if include_first else 1)
    w = in_chunk()
    local = packets.select(
        "*",
        F.row_number().over(w).alias("_rn"),
        F.lead(F.lit(1), reach).over(w).isNull().alias("_tail"),
        *[F.lag("length", k).over(w).alias(f"_l{k}") for k in range(1, max_lookback + 1)],
    )
    head = F.col("_rn") <= reach
    near = [
        (F.abs(F.col(f"_l{k}") - F.col("length")) <= tolerance) & (F.lit(k) <= lookback)
        for k in range(1, max_lookback + 1)
    ]
    new = (~reduce(or_, near)).cast("int")
    local = local.withColumn("_new", F.when(~head, new))

    # Rows at the head of a chunk are decided in the chunk table, from the lengths before it.
    sized = F.struct("_rn", "length")
    chunks = local.groupBy(*KEYS).agg(
        F.max(lookback).alias("_depth"),
        F.coalesce(F.sum("_new"), F.lit(0)).alias("_body"),
        F.sort_array(F.collect_list(F.when(head, sized)))["length"].alias("_head"),
        F.sort_array(F.collect_list(F.when(F.col("_tail"), sized)), asc=False)["length"].alias(
            "_last"
        ),
    )
    known = chunks.withColumn("_seen", F.reverse(nearest_before("_last", reach)))
    known = known.withColumn("_line", F.concat(F.coalesce("_seen", F.array()), "_head"))

    def starts_frame(_, i):
        at = F.size("_seen") + i
        lowest = F.lit(0 if include_first else 1)

        def matches(k):
            there = at - k
            gap = F.abs(F.get("_line", there) - F.get("_line", at))
            return (there >= lowest) & (k <= F.col("_depth")) & (gap <= tolerance)

        return (~F.exists(F.sequence(F.lit(1), F.lit(max_lookback)), matches)).cast("int")

    known = known.withColumn("_flags", F.transform("_head", starts_frame))
    in_head = F.aggregate("_flags", F.lit(0), lambda x, y: x + y)
    known = known.select(
        *KEYS, "_flags", total_before(F.col("_body") + in_head).alias("_start")
    )
    flag = F.coalesce("_new", F.get("_flags", F.col("_rn") - 1))
    count = F.sum(flag).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return local.join(known, KEYS).select(
        *packets.columns, (F.col("_start") + count).alias("frame_num")
    )


def size_frames(assigned: DataFrame) -> DataFrame:
    """One row per assembled frame of ``assign_frames`` output."""
    return assigned.groupBy("trace_id", "vca", "frame_num").agg(
        F.min("epoch_us").alias("frame_st"),
        F.max("epoch_us").alias("frame_et"),
        F.sum("length").alias("frame_size"),
        F.count(F.lit(1)).alias("n_pkts"),
        F.max("chunk").alias("chunk"),
    )


def unwrap_clock(packets: DataFrame) -> DataFrame:
    """Let ``rtp_ts`` run on where its 32-bit counter starts again.

    Between neighbouring packets the shorter way round counts, so late packets from before a turn go
    back below it. A chunk's turns are one row; those of the chunks before are added to its own.
    Video and its retransmissions share a clock and are taken together; other streams do not belong here.
    """
    half = CLOCK_RANGE // 2
    step = F.col("rtp_ts") - F.col("prev_1")["rtp_ts"]
    turn = F.when(step < -half, 1).when(step > half, -1).otherwise(0)
    local = with_previous(packets, ["rtp_ts"], [1]).select(*packets.columns, turn.alias("_turn"))
    chunks = local.groupBy(*KEYS).agg(F.sum("_turn").alias("_own"))
    before = chunks.select(*KEYS, total_before("_own").alias("_before"))
    own = F.sum("_turn").over(in_chunk().rowsBetween(Window.unboundedPreceding, 0))
    return (
        local.select("*", own.alias("_own"))
        .join(before, KEYS)
        .withColumn("rtp_ts", F.col("rtp_ts") + (F.col("_before") + F.col("_own")) * F.lit(CLOCK_RANGE))
        .select(*packets.columns)
    )


def rtp_frames(packets: DataFrame) -> DataFrame:
    """One row per RTP timestamp that carries exactly one marker."""
    return (
        packets.groupBy("trace_id", "vca", "rtp_ts")
        .agg(
            F.min("epoch_us").alias("frame_st"),
            F.max("epoch_us").alias("frame_et"),
            F.sum("length").alias("frame_size"),
            F.count(F.lit(1)).alias("n_pkts"),
            F.max("chunk").alias("chunk"),
            F.sum("marker").alias("_markers"),
        )
        .where(F.col("_markers") == 1)
        .drop("_markers")
    )


def frame_durations(frames: DataFrame, tie: str) -> DataFrame:
    """Add ``frame_dur_us`` and ``avg_frame_dur_us`` over frames ordered by end time.

    The mean of 30 consecutive durations is the distance of two end times over 30, so one look at
    the frame 30 places back replaces a rolling sum. Both are 0 where undefined, and a duration
    is never negative.
    """
    seen = with_previous(frames, ["frame_et"], [1, MEAN_FRAMES], order=["frame_et", tie])
    dur = F.col("frame_et") - F.col("prev_1")["frame_et"]
    mean = (F.col("frame_et") - F.col(f"prev_{MEAN_FRAMES}")["frame_et"]) / F.lit(MEAN_FRAMES)
    return seen.select(
        *frames.columns,
        F.greatest(F.coalesce(dur, F.lit(0)), F.lit(0)).alias("frame_dur_us"),
        F.coalesce(mean, F.lit(0.0)).alias("avg_frame_dur_us"),
    )


def drop_warm_up(frames: DataFrame, gap_us: int = WARM_UP_GAP_US) -> DataFrame:
    """Drop everything up to and including the first frame that ends after a gap of 8 s or more."""
    gaps = frames.groupBy(*KEYS).agg(
        F.min(F.when(F.col("frame_dur_us") >= gap_us, F.col("frame_num"))).alias("_cut")
    )
    cut = gaps.select(*KEYS, F.min("_cut").over(whole_trace()).alias("_cut"))
    return (
        frames.join(cut, KEYS)
        .where(F.col("frame_num") > F.coalesce("_cut", F.lit(-1)))
        .drop("_cut")
    )


def with_freezes(frames: DataFrame) -> DataFrame:
    dur, avg = F.col("frame_dur_us") / 1e6, F.col("avg_frame_dur_us") / 1e6
    flagged = frames.withColumn("is_freeze", is_freeze(dur, avg))
    return flagged.withColumn("freeze_dur_us", F.col("is_freeze") * F.col("frame_dur_us"))


def per_second(frames: DataFrame) -> DataFrame:
    """Quality per second: frames, bits, jitter (ms), freezes."""
    return (
        frames.groupBy("trace_id", "vca", second_after("frame_et").alias("ft_end"))
        .agg(
            F.count(F.lit(1)).alias("predicted_framesReceivedPerSecond"),
            (F.sum("frame_size") * 8).alias("predicted_bitrate"),
            (F.stddev_samp("frame_dur_us") / 1000).alias("predicted_frame_jitter"),
            F.sum("is_freeze").alias("freeze_count"),
            (F.sum("freeze_dur_us") / 1e6).alias("freeze_dur"),
        )
    )


# Seconds of a trace that are listed in one array.
SECONDS_AT_ONCE = 3_600


def fill_empty_seconds(seconds: DataFrame) -> DataFrame:
    """``per_second`` with a row for every second between a trace's first and last.

    Seconds without a frame have no frames, bits and freezes, and no jitter. Seconds are listed in
    bounded runs, so a trace of any length is spread over the tasks of the join.
    """
    ends = seconds.groupBy("trace_id", "vca").agg(F.min("ft_end").alias("_lo"), F.max("ft_end").alias("_hi"))
    runs = ends.withColumn("_from", F.explode(F.sequence("_lo", "_hi", F.lit(SECONDS_AT_ONCE).cast("bigint"))))
    last = F.least(F.col("_hi"), F.col("_from") + (SECONDS_AT_ONCE - 1))
    every = runs.select("trace_id", "vca", F.explode(F.sequence("_from", last)).alias("ft_end"))
    counts = ["predicted_framesReceivedPerSecond", "predicted_bitrate", "freeze_count", "freeze_dur"]
    return (
        every.join(seconds, ["trace_id", "vca", "ft_end"], "left").na.fill(0, counts).select(*seconds.columns)
    )


def frame_statistics(frames: DataFrame, tie: str, trim: bool = False, fill: bool = False) -> DataFrame:
    """Durations, freezes and per-second quality of one frame table, with ``fill`` for every second."""
    timed = frame_durations(frames, tie)
    if trim:
        timed = drop_warm_up(timed)
    seconds = per_second(with_freezes(timed))
    return fill_empty_seconds(seconds) if fill else seconds


def last_packet_of_frame(packets: DataFrame, key: str = "rtp_ts") -> DataFrame:
    """Add ``is_last``: the last packet (in trace order) of its RTP timestamp.

    The window holds the packets of one frame, not of a trace.
    """
    w = Window.partitionBy("trace_id", key)
    here = F.struct(*ORDER)
    return packets.withColumn("is_last", (here == F.max(here).over(w)))
