"""Learning, validation and ground-truth queries over the events view."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.operators import errors, features, splits
from framelens.operators.validate import valid_traces, validate
from framelens.plans import sql_parts as p
from framelens.plans.experiment import cross_validated, window_sweep
from framelens.plans.registry import query
from framelens.session import cut_lineage
from framelens.sources import dumps
from framelens.sources import sample_view as view


def labelled(spark, sf_dir, metric: str, method: str = "ip-udp-ml"):
    """Labelled window features with a fold per trace."""
    pk = view.packets(spark, sf_dir)
    if method == "ip-udp-ml":
        rows = features.ip_udp_features(pk)
    else:
        rows = features.rtp_ml_features(pk, view.payload_types(spark))
    rows = features.join_labels(rows, view.labels(pk), [metric])
    folds = splits.kfold(pk.select("trace_id", "vca").distinct())
    # The forest passes over these rows once per level.
    return cut_lineage(rows.join(folds.select("trace_id", "fold"), "trace_id"))


def _cross_validated(spark, sf_dir, metric: str, method: str):
    return cross_validated(labelled(spark, sf_dir, metric, method), metric, method)


@query("ip_udp_ml_frame_rate")
def ip_udp_ml_frame_rate(spark, sf_dir):
    return _cross_validated(spark, sf_dir, "framesReceivedPerSecond", "ip-udp-ml")[0]


@query("rtp_ml_bitrate")
def rtp_ml_bitrate(spark, sf_dir):
    return _cross_validated(spark, sf_dir, "bitrate", "rtp-ml")[0]


@query("ip_udp_ml_resolution")
def ip_udp_ml_resolution(spark, sf_dir):
    return _cross_validated(spark, sf_dir, "frameHeight", "ip-udp-ml")[0]


@query("top_feature_importances")
def top_feature_importances(spark, sf_dir):
    scores = _cross_validated(spark, sf_dir, "frame_jitter", "ip-udp-ml")[1]
    return errors.top_importances(scores, 5)


@query("window_size_sweep")
def window_size_sweep(spark, sf_dir):
    pk = view.packets(spark, sf_dir)
    folds = splits.kfold(pk.select("trace_id", "vca").distinct())
    return window_sweep(
        pk,
        view.labels(pk),
        cut_lineage(folds),
        [s * 1_000_000 for s in range(1, 11)],
        # A model per window, application and fold; their number is what counts here.
        trees=25,
    )


# --- validation -------------------------------------------------------------------------------

RANGES = """rg as (
  select trace_id, min(ts) as a, max(ts) as b, max(ts) - min(ts) + 1 as duration, count(*) as num_vals
  from lb group by 1)"""
FACTS = [
    p.best("vr", "pv"),
    """fa as (
  select r.trace_id, count(*) as n, count(*) filter (try_cast(ip_proto as double) is null) as bad,
    count(*) filter (try_cast(ip_proto as double) = 17 and length > 306) as vid,
    count(*) filter (p_type is not null) as rtp,
    min(epoch_us) filter (p_type is not null) as f, max(epoch_us) filter (p_type is not null) as l
  from pv r join vr on r.trace_id = vr.trace_id and r.ip_dst = vr.best
  where ssrc is not null and coalesce(ip_proto, '') not like '%,%' group by 1)""",
]
VERDICT = """select t.trace_id, case when bad > 0 then 'malformed protocol'
  when coalesce(vid, 0) = 0 then 'no video packets' when coalesce(rtp, 0) = 0 then 'no RTP packets'
  when a is null then 'no labels'
  when b * 1000000 < f or l < a * 1000000 then 'times do not overlap'
  when duration > num_vals then 'fewer samples than seconds' end as reason
from (select distinct trace_id from pv) t left join fa using (trace_id) left join rg using (trace_id)"""


def _ranges(pk):
    return view.labels(pk).groupBy("trace_id").agg(
        F.min("ts").alias("label_first"),
        F.max("ts").alias("label_last"),
        (F.max("ts") - F.min("ts") + 1).alias("duration"),
        F.count(F.lit(1)).alias("num_vals"),
    )


@query("validation", p.sql([p.PK, p.LB, "pv as (select * from pk)", RANGES, *FACTS], VERDICT))
def validation(spark, sf_dir):
    pk = view.packets(spark, sf_dir)
    return validate(pk, _ranges(pk))


@query(
    "validation_with_protocol",
    p.sql(
        [p.PK, p.LB, "pv as (select * replace (coalesce(ip_proto, '17') as ip_proto) from pk)",
         RANGES, *FACTS],
        VERDICT,
    ),
)
def validation_with_protocol(spark, sf_dir):
    """The same traces with the missing protocol filled in, so the later tests decide."""
    pk = view.packets(spark, sf_dir)
    return validate(pk.na.fill({"ip_proto": "17"}), _ranges(pk))


@query(
    "valid_traces",
    p.sql(
        [p.PK, p.LB, "pv as (select * replace (coalesce(ip_proto, '17') as ip_proto) from pk)",
         RANGES, *FACTS, f"vd as ({VERDICT})"],
        "select distinct trace_id, vca from pk where trace_id in "
        "(select trace_id from vd where reason is null)",
    ),
)
def valid(spark, sf_dir):
    pk = view.packets(spark, sf_dir)
    verdicts = validate(pk.na.fill({"ip_proto": "17"}), _ranges(pk))
    return valid_traces(pk.select("trace_id", "vca").distinct(), verdicts)


# --- ground truth -----------------------------------------------------------------------------


def view_dumps(spark, sf_dir):
    """A statistics dump per trace, written by Spark from the label view.

    Two streams per call: the labelled one and a fainter one that must not be chosen. Traces whose
    labels have a gap are written without it, as a browser would.
    """
    labels = view.labels(view.packets(spark, sf_dir))
    # One dump is one document with a value per call second; calls of this view last 52 s.
    per_call = labels.groupBy("trace_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct("ts", "framesReceivedPerSecond", "bitrate", "frame_jitter", "frameHeight")
            )
        ).alias("s")
    )
    series = {
        "framesPerSecond": "framesReceivedPerSecond",
        "[framesReceived/s]": "framesReceivedPerSecond",
        "[bytesReceived_in_bits/s]": "bitrate",
        "[interFrameDelayStDev_in_ms]": "frame_jitter",
        "frameHeight": "frameHeight",
    }
    first = F.get("s", F.lit(0))["ts"]
    stop = first + F.size("s")

    def iso(sec):
        return F.date_format(F.timestamp_seconds(sec), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")

    def entry(values):
        return F.struct(
            iso(first).alias("startTime"), iso(stop).alias("endTime"), values.alias("values")
        )

    def stat(stream: str, name: str, faint: bool = False):
        if name == "[codec]":
            values = F.transform("s", lambda r: F.lit("VP9"))
        elif name == "trackIdentifier":
            values = F.transform("s", lambda r: F.lit("track"))
        elif name == "framesReceived":
            # A running total: what was received up to and including this second.
            values = F.transform(
                "s",
                lambda r, i: F.aggregate(
                    F.slice("s", 1, i + 1),
                    F.lit(0).cast("bigint"),
                    lambda a, x: a + x["framesReceivedPerSecond"],
                ),
            )
        elif name in series:
            values = F.transform(
                "s", lambda r: F.lit(0).cast("double") if faint else r[series[name]].cast("double")
            )
        else:
            values = F.transform("s", lambda r: F.lit(0))
        return F.lit(f"IT01V{stream}-{name}"), entry(F.to_json(values))

    pairs = [x for name in dumps.STATS for x in stat("22", name)]
    faint = [x for x in stat("11", "framesPerSecond", faint=True)]
    stats = F.create_map(*faint, *pairs)
    empty = F.map_from_entries(F.filter(F.map_entries(stats), lambda e: F.lit(False)))
    body = F.to_json(
        F.struct(
            F.create_map(
                F.lit("1-1"), F.struct(empty.alias("stats")),
                F.lit("1-2"), F.struct(stats.alias("stats")),
            ).alias("PeerConnections")
        )
    )
    return per_call.select("trace_id", body.alias("body"))


# Second i of the dump follows its start, whatever seconds the labels came from.
SERIES = """se as (
  select trace_id, min(ts) over (partition by trace_id)
      + row_number() over (partition by trace_id order by ts) - 1 as ts,
    fps, bitrate, frame_jitter, height, count(*) over (partition by trace_id) as n from lb)"""


@query(
    "dump_labels",
    p.sql(
        [p.PK, p.LB, SERIES],
        'select trace_id, ts, fps::double as "framesReceivedPerSecond", fps::double as '
        '"framesReceived", bitrate::double as bitrate, round(frame_jitter, 6) as frame_jitter, '
        'height::double as "frameHeight", \'VP9\' as "[codec]", n::double as duration, '
        "n as num_vals from se",
    ),
)
def dump_labels(spark, sf_dir):
    return dumps.read_labels(view_dumps(spark, sf_dir)).select(
        "trace_id", "ts", "framesReceivedPerSecond", "framesReceived", "bitrate", "frame_jitter",
        "frameHeight", "[codec]", "duration", "num_vals",
    )


@query(
    "dump_streams",
    p.sql(
        [p.PK, p.LB],
        "select trace_id, 1 as pc, '22' as stream, round(sum(fps)::double, 6) as frames from lb group by 1",
    ),
)
def dump_streams(spark, sf_dir):
    return dumps.most_active(dumps.stat_rows(view_dumps(spark, sf_dir)))


@query(
    "dump_status",
    p.sql([p.PK, p.LB], "select distinct trace_id, cast(null as varchar) as reason from lb"),
)
def dump_status(spark, sf_dir):
    return dumps.dump_status(view_dumps(spark, sf_dir))
