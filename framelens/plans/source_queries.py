"""The events view written as captures and dumps in a data directory, and read back under one id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.plans import sql_parts as p
from framelens.plans.model_queries import SERIES, view_dumps
from framelens.plans.registry import query
from framelens.session import scratch_folder
from framelens.sources import dumps, linked
from framelens.sources import sample_view as view


def _seconds(us: str) -> Column:
    return (F.col(us).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(20,6)").cast("string")


def _folder(rows: DataFrame) -> DataFrame:
    """One experiment folder per trace; a blank in its name has to survive the way back."""
    vca = F.element_at(
        F.array(F.lit("meet"), F.lit("teams"), F.lit("webex")), (F.col("trace_id") % 3 + 1).cast("int")
    )
    return rows.withColumn("day", F.concat(F.lit("0_"), vca, F.lit("_call "), F.col("trace_id")))


def write_captures(packets: DataFrame, root: str, headered: bool) -> None:
    text = {
        "frame.time_relative": _seconds("t_us"),
        "frame.time_epoch": _seconds("epoch_us"),
        "ip.src": F.col("ip_src"),
        "ip.dst": F.col("ip_dst"),
        "ip.proto": F.col("ip_proto"),
        "ip.len": F.col("length") + 20,
        "udp.srcport": F.lit(1),
        "udp.dstport": F.lit(2),
        "udp.length": F.col("length"),
        "rtp.ssrc": F.col("ssrc"),
        "rtp.timestamp": F.col("rtp_ts"),
        "rtp.seq": F.col("seq"),
        # As captures have it: a decimal, or a list.
        "rtp.p_type": F.concat("p_type", F.when(F.col("marker") == 1, ".0").otherwise(",111")),
        "rtp.marker": F.col("marker"),
    }
    rows = _folder(packets).select("day", *[c.cast("string").alias(n) for n, c in text.items()])
    writer = rows.repartition("day").write.mode("append").partitionBy("day")
    writer.option("header", headered).option("sep", "," if headered else "\t").csv(root)


def write_dumps(bodies: DataFrame, root: str) -> None:
    maps = F.from_json("body", dumps.DUMP)["PeerConnections"].alias("PeerConnections")
    rows = _folder(bodies).select("day", maps)
    rows.repartition("day").write.mode("append").partitionBy("day").json(root)


def data_directory(spark, sf_dir, headered: bool = True) -> str:
    root = f"{scratch_folder(spark, 'captures')}/in_lab_data"
    write_captures(view.packets(spark, sf_dir), root, headered)
    write_dumps(view_dumps(spark, sf_dir), root)
    return root


def _number(rows: DataFrame) -> DataFrame:
    """The view's number of a trace, out of its id."""
    return rows.withColumn("trace_id", F.regexp_extract("trace_id", "call ([0-9]+)/", 1).cast("bigint"))


CAPTURED = (
    "select trace_id, vca, t_us, epoch_us, ip_src, ip_dst, ip_proto, length, ssrc, "
    "coalesce(rtp_ts, -1) as rtp_ts, coalesce(seq, -1) as seq, coalesce(marker, -1) as marker, "
    "p_type || case marker when 1 then '.0' else ',111' end as p_type "
    "from pk where trace_id in (select trace_id from lb)"
)
FIELDS = [
    "trace_id", "vca", "t_us", "epoch_us", "ip_src", "ip_dst", "ip_proto", "length", "ssrc", "rtp_ts",
    "seq", "marker", "p_type",
]


def _captured(spark, sf_dir, headered: bool) -> DataFrame:
    root = data_directory(spark, sf_dir, headered)
    traces = linked.linked_traces(spark, [root])
    rows = _number(linked.linked_packets(spark, [root], traces, headered)).select(*FIELDS)
    # A null would turn whole numbers into fractions on the way to a data frame.
    return rows.fillna(-1, ["rtp_ts", "seq", "marker"])


@query("capture_csv_scan", p.sql([p.PK, p.LB], CAPTURED))
def capture_csv_scan(spark, sf_dir):
    return _captured(spark, sf_dir, headered=True)


@query("capture_tsv_scan", p.sql([p.PK, p.LB], CAPTURED))
def capture_tsv_scan(spark, sf_dir):
    return _captured(spark, sf_dir, headered=False)


@query(
    "linked_traces",
    p.sql(
        [p.PK, p.LB],
        "select distinct 'in_lab_data' as dataset, vca, trace_id, true as same_folder "
        "from pk where trace_id in (select trace_id from lb)",
    ),
)
def linked_traces(spark, sf_dir):
    traces = linked.linked_traces(spark, [data_directory(spark, sf_dir)])
    folders = [F.regexp_extract(c, "/([^/]+)/[^/]+$", 1) for c in ("csv_path", "json_path")]
    return _number(traces.withColumn("same_folder", folders[0] == folders[1])).select(
        "dataset", "vca", "trace_id", "same_folder"
    )


@query(
    "linked_labels",
    p.sql(
        [p.PK, p.LB, SERIES],
        'select trace_id, ts, fps::double as "framesReceivedPerSecond", bitrate::double as bitrate, '
        'round(frame_jitter, 6) as frame_jitter, height::double as "frameHeight", n as num_vals from se',
    ),
)
def linked_labels(spark, sf_dir):
    root = data_directory(spark, sf_dir)
    bodies = linked.linked_dumps(spark, [root], linked.linked_traces(spark, [root]))
    return _number(dumps.read_labels(bodies)).select(
        "trace_id", "ts", "framesReceivedPerSecond", "bitrate", "frame_jitter", "frameHeight", "num_vals"
    )


@query(
    "linked_overlap",
    p.sql(
        [p.PK, p.LB, SERIES],
        "select trace_id, count(distinct ts) as seconds, count(*) as packets, sum(length)::bigint as bytes "
        "from (select trace_id, epoch_us // 1000000 as ts, length from pk) join se using (trace_id, ts) group by 1",
    ),
)
def linked_overlap(spark, sf_dir):
    """Packets in labelled seconds of their own trace: captures and dumps meet through the catalog."""
    root = data_directory(spark, sf_dir)
    traces = linked.linked_traces(spark, [root])
    packets = linked.linked_packets(spark, [root], traces).select(
        "trace_id", F.call_function("div", F.col("epoch_us"), F.lit(1_000_000)).alias("ts"), "length"
    )
    labels = dumps.read_labels(linked.linked_dumps(spark, [root], traces)).select("trace_id", "ts")
    met = packets.join(labels, ["trace_id", "ts"]).groupBy("trace_id")
    return _number(
        met.agg(F.count_distinct("ts").alias("seconds"), F.count("*").alias("packets"), F.sum("length").alias("bytes"))
    )
