"""Packet-level queries: cleaning, frames, heuristics, windows and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.functions import first_payload_type, second_of
from framelens.operators import clean, features, frames, heuristics
from framelens.operators.windows import assign_windows
from framelens.plans import sql_parts as p
from framelens.plans.registry import query
from framelens.sources import sample_view as view

SECOND_COLS = (
    "trace_id, vca, ft_end, fps as \"predicted_framesReceivedPerSecond\", "
    "bitrate as predicted_bitrate, round(jitter, 6) as predicted_frame_jitter, freeze_count, "
    "round(freeze_dur, 6) as freeze_dur"
)


@query("ip_udp_heuristic", p.sql(p.IP_SECONDS, f"select {SECOND_COLS} from ip_sec"))
def ip_udp_heuristic(spark, sf_dir):
    return heuristics.ip_udp_heuristic(view.packets(spark, sf_dir))


@query("rtp_heuristic", p.sql(p.RTP_SECONDS, f"select {SECOND_COLS} from rtp_sec"))
def rtp_heuristic(spark, sf_dir):
    return heuristics.rtp_heuristic(view.packets(spark, sf_dir), view.payload_types(spark))


@query(
    "ip_udp_heuristic_every_second",
    p.sql(
        [
            *p.IP_SECONDS,
            "ends as (select trace_id, vca, unnest(generate_series(min(ft_end), max(ft_end))) as ft_end "
            "from ip_sec group by 1, 2)",
        ],
        "select trace_id, vca, ft_end, coalesce(fps, 0) as \"predicted_framesReceivedPerSecond\", "
        "coalesce(bitrate, 0) as predicted_bitrate, round(jitter, 6) as predicted_frame_jitter, "
        "coalesce(freeze_count, 0) as freeze_count, round(coalesce(freeze_dur, 0), 6) as freeze_dur "
        "from ends left join ip_sec using (trace_id, vca, ft_end)",
    ),
)
def ip_udp_heuristic_every_second(spark, sf_dir):
    return heuristics.ip_udp_heuristic(view.packets(spark, sf_dir), fill_empty_seconds=True)


@query(
    "clean_protocol",
    p.sql([p.PK, p.CL], "select trace_id, pkt_ord, ip_proto, length from cl"),
)
def clean_protocol(spark, sf_dir):
    pk = view.packets(spark, sf_dir)
    return clean.clean_protocol(pk).select("trace_id", "pkt_ord", "ip_proto", "length")


@query(
    "udp_video_marks",
    p.sql(
        [p.PK, p.CL],
        "select vca, (length > 306)::int as is_video_pred, count(*) as n, "
        "cast(sum(length) as bigint) as bytes from cl where ip_proto = 17 group by 1, 2",
    ),
)
def udp_video_marks(spark, sf_dir):
    pk = clean.udp_only(clean.clean_protocol(view.packets(spark, sf_dir)))
    return (
        clean.mark_video(pk)
        .groupBy("vca", "is_video_pred")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    )


@query(
    "first_payload_type",
    p.sql(
        [p.PK],
        "select p_type || case marker when 1 then '.0' else ',111' end as raw, p_type as clean, "
        "count(*) as n from pk group by 1, 2",
    ),
)
def first_payload(spark, sf_dir):
    raw = F.concat("p_type", F.when(F.col("marker") == 1, ".0").otherwise(",111"))
    pk = view.packets(spark, sf_dir).select(raw.alias("raw"))
    return pk.groupBy("raw", first_payload_type("raw").alias("clean")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "top_receiver",
    p.sql(p.ML_KEPT, "select trace_id, vca, ip_dst, count(*) as n, "
          "cast(sum(length) as bigint) as bytes from kept group by 1, 2, 3"),
)
def top_receiver(spark, sf_dir):
    udp = clean.udp_only(clean.clean_protocol(view.packets(spark, sf_dir)))
    kept = clean.keep_busiest(clean.video_sized(udp), population=udp)
    return kept.groupBy("trace_id", "vca", "ip_dst").agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes")
    )


@query(
    "top_sender",
    p.sql(
        [p.PK, p.best("snd", "pk", "ip_src"), p.join_best("s", "pk", "snd", "true", "ip_src")],
        "select trace_id, ip_src, count(*) as n, cast(sum(length) as bigint) as bytes "
        "from s group by 1, 2",
    ),
)
def top_sender(spark, sf_dir):
    kept = clean.keep_busiest(view.packets(spark, sf_dir), endpoint="ip_src")
    return kept.groupBy("trace_id", "ip_src").agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes")
    )


@query(
    "dominant_payload_type",
    p.sql(
        [p.PK],
        "select trace_id, p_type, n, bytes from (select trace_id, p_type, count(*) as n, "
        "cast(sum(length) as bigint) as bytes, row_number() over (partition by trace_id "
        "order by avg(length) desc, p_type) as rn from pk where p_type is not null "
        "group by 1, 2) where rn = 1",
    ),
)
def dominant_payload_type(spark, sf_dir):
    kept = clean.keep_dominant_payload_type(view.packets(spark, sf_dir))
    return kept.groupBy("trace_id", "p_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes")
    )


@query(
    "media_packets",
    p.sql(
        p.RTP_ROWS,
        "select trace_id, pkt_ord, p_type, length - 12 as length from rtp_rows "
        "where p_type in ('98', '99') and length > 306",
    ),
)
def media_packets(spark, sf_dir):
    rows = heuristics.received_rtp(view.packets(spark, sf_dir))
    media = clean.media_packets(rows, view.payload_types(spark))
    return clean.strip_header(clean.video_sized(media)).select(
        "trace_id", "pkt_ord", "p_type", "length"
    )


@query(
    "rtp_model_packets",
    p.sql(p.RTP_KEPT, "select trace_id, pkt_ord, role, length from kept"),
)
def rtp_model_packets(spark, sf_dir):
    return features.rtp_model_packets(
        view.packets(spark, sf_dir), view.payload_types(spark)
    ).select("trace_id", "pkt_ord", "role", "length")


@query(
    "lookback_frames",
    p.sql(p.HEUR_KEPT + [p.LB3, p.SIZE_FRAMES],
          "select trace_id, vca, frame_num, frame_st, frame_et, frame_size, n_pkts from fr"),
)
def lookback_frames(spark, sf_dir):
    return heuristics.size_heuristic_frames(view.packets(spark, sf_dir)).drop("chunk")


@query(
    "lookback_frames_with_first",
    p.sql(
        p.HEUR_KEPT + [p.lookback("2", 2, include_first=True)],
        "select trace_id, pkt_ord, length, frame_num from asg",
    ),
)
def lookback_frames_with_first(spark, sf_dir):
    kept = heuristics.heuristic_packets(view.packets(spark, sf_dir)).select(
        *heuristics.PACKET_COLUMNS
    )
    return frames.assign_frames(kept, 2, include_first=True).select(
        "trace_id", "pkt_ord", "length", "frame_num"
    )


@query(
    "rtp_frames",
    p.sql(p.RTP_ROWS + [p.RTP_FRAMES],
          "select trace_id, vca, rtp_ts, frame_st, frame_et, frame_size, n_pkts from fr"),
)
def rtp_frames(spark, sf_dir):
    return heuristics.rtp_heuristic_frames(
        view.packets(spark, sf_dir), view.payload_types(spark)
    ).drop("chunk")


@query(
    "frame_durations",
    p.sql(
        p.HEUR_KEPT + [p.LB3, p.SIZE_FRAMES, p.DURATIONS, p.FROZEN.format(source="du")],
        "select trace_id, frame_num, dur as frame_dur_us, round(mean, 6) as avg_frame_dur_us, "
        "is_freeze, dur * is_freeze as freeze_dur_us from fz",
    ),
)
def frame_durations(spark, sf_dir):
    fr = heuristics.size_heuristic_frames(view.packets(spark, sf_dir))
    return frames.with_freezes(frames.frame_durations(fr, "frame_num")).select(
        "trace_id",
        "frame_num",
        "frame_dur_us",
        "avg_frame_dur_us",
        "is_freeze",
        "freeze_dur_us",
    )


@query(
    "last_packet_of_frame",
    p.sql(
        [p.PK],
        "select trace_id, pkt_ord, rtp_ts, row_number() over (partition by trace_id, rtp_ts "
        "order by t_us desc, pkt_ord desc) = 1 as is_last from pk where rtp_ts is not null",
    ),
)
def last_packet(spark, sf_dir):
    pk = clean.rtp_only(view.packets(spark, sf_dir))
    return frames.last_packet_of_frame(pk).select("trace_id", "pkt_ord", "rtp_ts", "is_last")


@query(
    "packets_per_second",
    p.sql(
        [p.PK],
        "select trace_id, epoch_us // 1000000 as second, count(*) as n, "
        "cast(sum(length) as bigint) as bytes from pk group by 1, 2",
    ),
)
def packets_per_second(spark, sf_dir):
    return (
        view.packets(spark, sf_dir)
        .groupBy("trace_id", second_of("epoch_us").alias("second"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    )


@query(
    "next_inter_arrival",
    p.sql(
        p.ML_KEPT,
        "select trace_id, pkt_ord, round((lead(t_us) over (partition by trace_id order by t_us, "
        "pkt_ord) - t_us) / 1e6, 6) as next_iat from kept",
    ),
)
def next_inter_arrival(spark, sf_dir):
    kept = features.model_packets(view.packets(spark, sf_dir))
    return features.with_next_iat(kept).select("trace_id", "pkt_ord", "next_iat")


def _anchor_sql(select: str, closed: str = "left", window_us: int = 1_000_000) -> str:
    return p.sql(
        p.ML_KEPT + p.anchors(window_us) + p.placed(closed), select, recursive=True
    )


@query(
    "anchor_windows",
    _anchor_sql('select trace_id, pkt_ord, "interval", et, round(iat_us / 1000, 6) as iat from win'),
)
def anchor_windows(spark, sf_dir):
    kept = features.model_packets(view.packets(spark, sf_dir))
    return features.windowed_packets(kept).select(
        "trace_id", "pkt_ord", "interval", "et", "iat"
    )


@query(
    "anchor_windows_right_closed",
    _anchor_sql('select trace_id, pkt_ord, "interval", et from win', "right"),
)
def anchor_windows_right_closed(spark, sf_dir):
    kept = features.model_packets(view.packets(spark, sf_dir))
    return assign_windows(kept, closed="right").select("trace_id", "pkt_ord", "interval", "et")


@query(
    "size_statistics",
    _anchor_sql(f'select trace_id, vca, "interval", et, {p.L_COLS} from win group by 1, 2, 3, 4'),
)
def size_statistics(spark, sf_dir):
    return features.ip_udp_features(view.packets(spark, sf_dir), groups=("LSTATS",))


@query(
    "iat_statistics",
    _anchor_sql(f'select trace_id, vca, "interval", et, {p.T_COLS} from win group by 1, 2, 3, 4'),
)
def iat_statistics(spark, sf_dir):
    return features.ip_udp_features(view.packets(spark, sf_dir), groups=("TSTATS",))


@query(
    "window_features",
    _anchor_sql(
        f'select trace_id, vca, "interval", et, et as t_et, {p.L_COLS}, {p.T_COLS} from win '
        "group by 1, 2, 3, 4"
    ),
)
def window_features(spark, sf_dir):
    return features.ip_udp_features(view.packets(spark, sf_dir), compat=True)


def _vector_sql(value: str) -> str:
    width = "case vca when 'teams' then 800 else 600 end"
    return (
        f'select trace_id, "interval", et, n, array_to_string(list_resize(vals, {width}, 0), \',\') '
        f'as vector from (select trace_id, vca, "interval", et, count(*) as n, '
        f"list({value}::bigint order by t_us, pkt_ord) as vals from win group by 1, 2, 3, 4)"
    )


def _vectors(windowed, group: str, array: str, scale: int = 1):
    """The padded vectors, whole, as text of whole numbers."""
    counts = windowed.groupBy(*features.WINDOW).agg(F.count(F.lit(1)).alias("n"))
    vec = features.window_features(windowed, groups=(group,))
    whole = F.transform(array, lambda x: F.round(x * scale).cast("bigint").cast("string"))
    return vec.join(counts, features.WINDOW).select(
        "trace_id", "interval", "et", "n", F.array_join(whole, ",").alias("vector")
    )


@query("size_vectors", _anchor_sql(_vector_sql("length")))
def size_vectors(spark, sf_dir):
    kept = features.model_packets(view.packets(spark, sf_dir))
    return _vectors(assign_windows(kept), "SIZE", "sizes")


@query("iat_vectors", _anchor_sql(_vector_sql("iat_us")))
def iat_vectors(spark, sf_dir):
    kept = features.model_packets(view.packets(spark, sf_dir))
    return _vectors(features.windowed_packets(kept), "IAT", "iats", 1000)


@query(
    "retransmission_count",
    _anchor_sql(
        'select a.trace_id, a.vca, a."interval", a.et, '
        "count(*) filter (b.trace_id is not null) as num_rtx from win a left join "
        '(select distinct trace_id, "interval", length from win) b on a.trace_id = b.trace_id '
        'and a."interval" = b."interval" and a.length = b.length + 2 group by 1, 2, 3, 4'
    ),
)
def retransmission_count(spark, sf_dir):
    kept = features.model_packets(view.packets(spark, sf_dir))
    return features.retransmission_count(assign_windows(kept))


@query(
    "longest_window",
    _anchor_sql(
        "select vca, max(n) as max_size from (select vca, trace_id, \"interval\", count(*) as n "
        "from win group by 1, 2, 3) group by 1"
    ),
)
def longest_window(spark, sf_dir):
    kept = features.model_packets(view.packets(spark, sf_dir))
    return features.longest_window(assign_windows(kept))


RTP_WINDOWS = p.RTP_KEPT + p.anchors() + p.placed("right") + p.RTP_STATS


@query("rtp_features", p.sql(RTP_WINDOWS, "select * from rf", recursive=True))
def rtp_features(spark, sf_dir):
    kept = features.rtp_model_packets(
        view.packets(spark, sf_dir), view.payload_types(spark)
    )
    return features.rtp_features(kept)


# Counters as they come over the wire; both start again about half-way through a trace.
WRAPPED = {"rtp_ts": (frames.CLOCK_RANGE, 2_340_000), "seq": (features.SEQ_RANGE, 520)}


def wrapped_counters(pk):
    for c, (size, left) in WRAPPED.items():
        pk = pk.withColumn(c, F.pmod(F.col(c) + (size - left), F.lit(size)))
    return pk


# The twins use the counters of the view, which never start again: both must give the same.
@query("rtp_features_unwrapped", p.sql(RTP_WINDOWS, "select * from rf", recursive=True))
def rtp_features_unwrapped(spark, sf_dir):
    kept = features.rtp_model_packets(view.packets(spark, sf_dir), view.payload_types(spark))
    return features.rtp_features(wrapped_counters(kept), unwrap=True)


@query("rtp_heuristic_unwrapped", p.sql(p.RTP_SECONDS, f"select {SECOND_COLS} from rtp_sec"))
def rtp_heuristic_unwrapped(spark, sf_dir):
    pk = wrapped_counters(view.packets(spark, sf_dir))
    return heuristics.rtp_heuristic(pk, view.payload_types(spark), unwrap=True)
