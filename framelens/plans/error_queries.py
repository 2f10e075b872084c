"""Evaluation queries over the heuristics' predictions on the events view."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.functions import app_label, second_of
from framelens.operators import assembly, clean, errors, features, heuristics, splits
from framelens.operators.frames import assign_frames
from framelens.operators.ranks import ecdf, quantiles
from framelens.plans import experiment
from framelens.plans import sql_parts as p
from framelens.plans.registry import query
from framelens.sources import catalog
from framelens.sources import sample_view as view

PROFILE = catalog.PROFILE


def predictions(spark, sf_dir):
    pk = view.packets(spark, sf_dir)
    labels = view.labels(pk)
    return errors.all_results(
        [
            heuristics.to_predictions(heuristics.ip_udp_heuristic(pk), labels, "ip-udp-heuristic"),
            heuristics.to_predictions(
                heuristics.rtp_heuristic(pk, view.payload_types(spark)), labels, "rtp-heuristic"
            ),
        ]
    )


def pred_sql(select: str, *more: str) -> str:
    return p.sql([*p.PREDICTIONS, *more], select)


def quantile_sql(value: str, names: dict[str, float]) -> str:
    return ", ".join(f"round(quantile_cont({value}, {q}), 6) as {n}" for n, q in names.items())


BOX = quantile_sql("pred - gt", errors.BOX)


@query("predictions", pred_sql("select metric, method, vca, trace_id, ts, round(pred, 6) as pred, "
                               "round(gt, 6) as gt, round(pred - gt, 6) as dev, "
                               "round(abs(pred - gt), 6) as abs_dev from pred"))
def all_predictions(spark, sf_dir):
    return errors.with_deviation(predictions(spark, sf_dir))


@query(
    "macro_scores",
    pred_sql(
        "select metric, method, vca, round(avg(mae), 6) as mae, "
        "round(case when metric = 'framesReceivedPerSecond' then avg(near) end, 6) as accuracy, "
        "count(*) as n_traces from (select metric, method, vca, trace_id, avg(abs(pred - gt)) as mae, "
        "avg((abs(pred - gt) <= 2)::int) as near from pred group by 1, 2, 3, 4) group by 1, 2, 3"
    ),
)
def macro_scores(spark, sf_dir):
    return errors.macro_scores(predictions(spark, sf_dir))


@query(
    "micro_mae",
    pred_sql(
        "select metric, method, vca, round(avg(abs(pred - gt) / case when metric = 'bitrate' "
        "then 1000 else 1 end), 6) as mae from pred group by 1, 2, 3"
    ),
)
def micro_mae(spark, sf_dir):
    return errors.micro_mae(predictions(spark, sf_dir))


# Traces cross-checked with the customer table as their catalog.
CATALOG = """cat as (
  select c_custkey as trace_id, lower(c_mktsegment) as vca, 'events_view' as dataset,
    c_nationkey * 100 as th, cast(floor(abs(c_acctbal)) as int) as th_jitter,
    c_nationkey * 2 as lat, c_nationkey % 5 as lat_jitter, c_nationkey % 3 as loss
  from customer)"""


@query(
    "micro_mae_by_dataset",
    pred_sql(
        "select p.metric, p.vca, c.dataset, round(avg(abs(pred - gt) / case when metric = "
        "'bitrate' then 1000 else 1 end), 6) as mae from pred p join cat c using (trace_id) "
        "group by 1, 2, 3",
        CATALOG,
    ),
)
def micro_mae_by_dataset(spark, sf_dir):
    traces = view.traces(spark, sf_dir).drop("vca")
    joined = errors.with_traces(predictions(spark, sf_dir), traces)
    return errors.micro_mae(joined, ("metric", "vca", "dataset"))


@query(
    "central_truth",
    pred_sql(
        "select metric, vca, round(quantile_cont(gt, 0.5), 6) as median, round(avg(gt), 6) as mean "
        "from (select distinct metric, vca, trace_id, ts, gt from pred) group by 1, 2"
    ),
)
def central_truth(spark, sf_dir):
    return errors.central_truth(predictions(spark, sf_dir))


@query(
    "error_ecdf",
    pred_sql(
        "select distinct metric, method, round(abs(pred - gt), 6) as abs_dev, round(cume_dist() "
        "over (partition by metric, method order by abs(pred - gt)), 6) as cume from pred"
    ),
)
def error_ecdf(spark, sf_dir):
    return errors.error_ecdf(predictions(spark, sf_dir))


@query("error_boxes", pred_sql(f"select metric, vca, method, {BOX} from pred group by 1, 2, 3"))
def error_boxes(spark, sf_dir):
    return errors.error_boxes(predictions(spark, sf_dir))


@query(
    "tolerance_shares",
    pred_sql(
        "select method, vca, "
        "round(100 * avg((abs(pred - gt) <= 2)::int) filter (metric = 'framesReceivedPerSecond'), 6) "
        "as fps_within_2, round(100 * avg((abs(pred - gt) <= 50000)::int) "
        "filter (metric = 'bitrate'), 6) as bitrate_within_50k, "
        "round(100 * avg((abs(pred - gt) / gt <= 0.25)::int) filter (metric = 'bitrate'), 6) "
        "as bitrate_within_25pct from pred group by 1, 2"
    ),
)
def tolerance_shares(spark, sf_dir):
    return errors.tolerance_shares(predictions(spark, sf_dir))


@query(
    "mean_relative_error",
    pred_sql(
        "select method, vca, round(100 * avg(abs((pred - gt) / nullif(gt, 0))), 6) as mean_rel_pct "
        "from pred where metric = 'bitrate' group by 1, 2"
    ),
)
def mean_relative_error(spark, sf_dir):
    return errors.mean_relative_error(predictions(spark, sf_dir))


@query(
    "relative_errors",
    pred_sql(
        "select method, trace_id, ts, round((pred - gt) / nullif(gt, 0), 6) as rel_dev from pred "
        "where metric = 'bitrate'"
    ),
)
def relative_errors(spark, sf_dir):
    return errors.relative_errors(predictions(spark, sf_dir)).select(
        "method", "trace_id", "ts", "rel_dev"
    )


@query(
    "trial_scores",
    pred_sql(
        "select metric || '_' || method || '_none_events_view_cv_' || fold as trial, vca, "
        "round(avg(mae), 6) as mae, round(case when metric = 'framesReceivedPerSecond' then avg(near) "
        "end, 6) as accuracy, count(*) as n_traces from (select metric, method, fold, p.vca, "
        "p.trace_id, avg(abs(pred - gt)) as mae, avg((abs(pred - gt) <= 2)::int) as near "
        "from pred p join fo using (trace_id) group by 1, 2, 3, 4, 5) group by metric, method, fold, vca",
        "fo as (select trace_id, ntile(5) over (partition by vca order by trace_id) as fold "
        "from (select distinct trace_id, vca from pk))",
    ),
)
def trial_scores(spark, sf_dir):
    folds = splits.kfold(view.packets(spark, sf_dir).select("trace_id", "vca").distinct())
    found = predictions(spark, sf_dir).join(folds.select("trace_id", "fold"), "trace_id")
    return experiment.trial_scores(found, "none", view.DATASET)


@query(
    "app_labels",
    p.sql(
        [p.PK],
        "select case vca when 'meet' then 'Meet' when 'teams' then 'Teams' else 'Webex' end as app, "
        "count(distinct trace_id) as n_traces, count(*) as n_pkts from pk group by 1",
    ),
)
def app_labels(spark, sf_dir):
    pk = view.packets(spark, sf_dir)
    per_trace = pk.groupBy("vca", "trace_id").agg(F.count(F.lit(1)).alias("n"))
    return per_trace.groupBy(app_label("vca").alias("app")).agg(
        F.count(F.lit(1)).alias("n_traces"), F.sum("n").alias("n_pkts")
    )


@query(
    "call_seconds",
    pred_sql(
        "select vca, round(sum(s), 6) as seconds, count(*) as n_traces from (select p.vca, p.trace_id, "
        "avg(d.duration) as s from pred p join (select trace_id, max(ts) - min(ts) + 1 as duration from "
        "lb group by 1) d using (trace_id) where metric = 'framesReceivedPerSecond' and "
        "method = 'ip-udp-heuristic' group by 1, 2) group by 1"
    ),
)
def call_seconds(spark, sf_dir):
    seconds = view.labels(view.packets(spark, sf_dir)).groupBy("trace_id")
    durations = seconds.agg((F.max("ts") - F.min("ts") + 1).alias("duration"))
    return errors.call_seconds(predictions(spark, sf_dir), durations, errors.FPS, "ip-udp-heuristic")


@query(
    "large_errors",
    pred_sql(
        "select metric, method, trace_id, ts, round(abs(pred - gt), 6) as abs_dev from pred "
        "where abs(pred - gt) > 5"
    ),
)
def large_errors(spark, sf_dir):
    return errors.large_errors(predictions(spark, sf_dir)).select(
        "metric", "method", "trace_id", "ts", "abs_dev"
    )


@query(
    "time_series",
    pred_sql(
        "select metric, method, ts, round(pred, 6) as pred, round(gt, 6) as gt from pred "
        "where trace_id = 0"
    ),
)
def time_series(spark, sf_dir):
    return errors.time_series(predictions(spark, sf_dir), 0).select(
        "metric", "method", "ts", "pred", "gt"
    )


@query(
    "predictions_with_labels",
    pred_sql(
        "select p.metric, p.method, p.trace_id, p.ts, round(p.pred, 6) as pred, l.fps as "
        "\"framesReceivedPerSecond\", l.bitrate, l.height as \"frameHeight\" "
        "from pred p join lb l using (trace_id, ts)"
    ),
)
def predictions_with_labels(spark, sf_dir):
    labels = view.labels(view.packets(spark, sf_dir)).drop("frame_jitter")
    return errors.with_labels(predictions(spark, sf_dir), labels).select(
        "metric", "method", "trace_id", "ts", "pred",
        "framesReceivedPerSecond", "bitrate", "frameHeight",
    )


# Predicted resolution: what the bitrate estimate of a second suggests.
HEIGHTS = """hp as (
  select method, vca, l.trace_id, l.ts, l.height as gt,
    case when pred <= 40000 then 180 when pred <= 60000 then 360 else 720 end as pred
  from pred join lb l using (trace_id, ts) where metric = 'bitrate')"""
BINS = """hb as (
  select method, vca, case when gt <= 240 then 'low' when gt <= 480 then 'medium' else 'high' end as gt_bin,
    case when pred <= 240 then 'low' when pred <= 480 then 'medium' else 'high' end as pred_bin from hp)"""


def height_predictions(spark, sf_dir):
    rate = predictions(spark, sf_dir).where(F.col("metric") == "bitrate").drop("gt")
    labels = view.labels(view.packets(spark, sf_dir)).select(
        "trace_id", "ts", F.col("frameHeight").alias("gt")
    )
    height = F.when(F.col("pred") <= 40_000, 180).when(F.col("pred") <= 60_000, 360).otherwise(720)
    return (
        rate.withColumn("pred", height)
        .withColumn("metric", F.lit("frameHeight"))
        .join(labels, ["trace_id", "ts"])
    )


@query(
    "resolution_confusion",
    pred_sql(
        "select method, vca, gt_bin, pred_bin, n, round(n / sum(n) over (partition by method, vca, "
        "gt_bin), 6) as row_share, round(sum(case when gt_bin = pred_bin then n else 0 end) over "
        "(partition by method, vca) / sum(n) over (partition by method, vca), 6) as accuracy "
        "from (select method, vca, gt_bin, pred_bin, count(*) as n from hb group by 1, 2, 3, 4)",
        HEIGHTS,
        BINS,
    ),
)
def resolution_confusion(spark, sf_dir):
    return errors.confusion(height_predictions(spark, sf_dir))


@query(
    "resolution_confusion_matrix",
    pred_sql(
        "select method, vca, gt_bin, count(*) filter (pred_bin = 'low') as low, "
        "count(*) filter (pred_bin = 'medium') as medium, count(*) filter (pred_bin = 'high') as high "
        "from hb group by 1, 2, 3",
        HEIGHTS,
        BINS,
    ),
)
def resolution_confusion_matrix(spark, sf_dir):
    return errors.confusion_matrix(height_predictions(spark, sf_dir))


@query(
    "resolution_accuracy",
    pred_sql(
        "select 'frameHeight' as metric, method, vca, cast(null as double) as mae, "
        "round(avg(a), 6) as accuracy, count(*) as n_traces from (select method, vca, trace_id, "
        "avg((pred = gt)::int) as a from hp group by 1, 2, 3) group by 2, 3",
        HEIGHTS,
    ),
)
def resolution_accuracy(spark, sf_dir):
    return errors.macro_scores(height_predictions(spark, sf_dir))


@query(
    "class_shares",
    p.sql(
        [p.PK, p.LB],
        "select vca, height as \"frameHeight\", count(*) as n, round(count(*) / sum(count(*)) over "
        "(partition by vca), 6) as share from lb join (select distinct trace_id, vca from pk) "
        "using (trace_id) group by 1, 2",
    ),
)
def class_shares(spark, sf_dir):
    return errors.class_shares(_labels_by_app(spark, sf_dir), ["vca"], "frameHeight")


def _labels_by_app(spark, sf_dir):
    pk = view.packets(spark, sf_dir)
    # The application is a function of the trace in this view.
    app = F.element_at(
        F.array(F.lit("meet"), F.lit("teams"), F.lit("webex")),
        (F.col("trace_id") % 3 + 1).cast("int"),
    )
    return view.labels(pk).withColumn("vca", app)


@query(
    "truth_ecdf",
    p.sql(
        [p.PK, p.LB],
        "select distinct vca, metric, round(value, 6) as value, round(cume_dist() over (partition by "
        "vca, metric order by value), 6) as cume from (select vca, metric, value from (select vca, "
        "bitrate::double as bitrate, fps::double as \"framesReceivedPerSecond\", frame_jitter from lb "
        "join (select distinct trace_id, vca from pk) using (trace_id)) "
        "unpivot (value for metric in (bitrate, \"framesReceivedPerSecond\", frame_jitter)))",
    ),
)
def truth_ecdf(spark, sf_dir):
    labels = _labels_by_app(spark, sf_dir)
    metrics = ["bitrate", "framesReceivedPerSecond", "frame_jitter"]
    long = labels.select("vca", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        ["vca"], metrics, "metric", "value"
    )
    return ecdf(long, ["vca", "metric"], "value")


def _unpivoted(inner: str) -> str:
    return f"""long as (
  select metric, method, vca, trace_id, ts, parameter, setting, pred, gt from (
    select p.*, c.th, c.th_jitter, c.lat, c.lat_jitter, c.loss from pred p join cat c using (trace_id))
  unpivot (setting for parameter in ({inner})))"""


LONG = _unpivoted("th, th_jitter, lat, lat_jitter, loss")


def profiled(spark, sf_dir):
    traces = catalog.with_profile(view.traces(spark, sf_dir).drop("vca"))
    return errors.with_traces(predictions(spark, sf_dir), traces)


@query(
    "parameter_sensitivity",
    pred_sql(
        "select metric, method, vca, parameter, setting, round(mae, 6) as mae, "
        "round(mae - 1.96 * sd / sqrt(n), 6) as ci_low, round(mae + 1.96 * sd / sqrt(n), 6) as "
        "ci_high, n from (select metric, method, vca, parameter, setting, avg(abs(pred - gt)) as mae, "
        "stddev_samp(abs(pred - gt)) as sd, count(*) as n from long group by 1, 2, 3, 4, 5)",
        CATALOG,
        LONG,
    ),
)
def parameter_sensitivity(spark, sf_dir):
    return errors.parameter_sensitivity(profiled(spark, sf_dir), PROFILE)


WEIGHT = " + ".join(f"(number >= {c})::int" for c in errors.poisson_cuts())


@query(
    "bootstrap_sensitivity",
    pred_sql(
        "select metric, method, vca, parameter, setting, round(max(mae), 6) as mae, "
        "round(quantile_cont(mean, 0.025), 6) as ci_low, round(quantile_cont(mean, 0.975), 6) as "
        "ci_high, max(n) as n from (select metric, method, vca, parameter, setting, round, "
        "case when sum(w) > 0 then sum(w * dev) / sum(w) end as mean, avg(dev) as mae, count(*) as n "
        f"from (select *, {WEIGHT} as w from (select *, abs(pred - gt) as dev, "
        "('0x' || substr(md5(concat_ws('|', metric, method, vca, trace_id, ts, round)), 1, 8))::bigint "
        "as number from long, range(1, 101) r(round))) group by 6, 1, 2, 3, 4, 5) "
        "group by 1, 2, 3, 4, 5",
        CATALOG,
        LONG,
    ),
)
def bootstrap_sensitivity(spark, sf_dir):
    return errors.bootstrap_sensitivity(profiled(spark, sf_dir), PROFILE)


@query(
    "sensitivity_boxes",
    pred_sql(
        f"select metric, method, vca, parameter, setting, {BOX} from long group by 1, 2, 3, 4, 5",
        CATALOG,
        LONG,
    ),
)
def sensitivity_boxes(spark, sf_dir):
    return errors.sensitivity_boxes(profiled(spark, sf_dir), PROFILE)


# --- splits -----------------------------------------------------------------------------------


@query(
    "kfold_split",
    p.sql([CATALOG], "select trace_id, vca, ntile(5) over (partition by vca order by trace_id) as fold "
                     "from cat"),
)
def kfold_split(spark, sf_dir):
    return splits.kfold(view.traces(spark, sf_dir)).select("trace_id", "vca", "fold")


@query(
    "random_split",
    p.sql(
        [CATALOG],
        "select trace_id, vca, case when row_number() over (partition by vca order by "
        "md5('7:' || trace_id)) <= floor(0.8 * count(*) over (partition by vca)) then 'train' "
        "else 'test' end as split from cat",
    ),
)
def random_split(spark, sf_dir):
    return splits.split_traces(view.traces(spark, sf_dir), "random").select(
        "trace_id", "vca", "split"
    )


@query(
    "network_split",
    p.sql(
        [CATALOG],
        "select trace_id, vca, case when row_number() over (partition by vca, th, th_jitter, lat, "
        "lat_jitter, loss order by trace_id) <= floor(0.8 * count(*) over (partition by vca, th, "
        "th_jitter, lat, lat_jitter, loss)) then 'train' else 'test' end as split from cat",
    ),
)
def network_split(spark, sf_dir):
    return splits.split_traces(view.traces(spark, sf_dir), "network-condition").select(
        "trace_id", "vca", "split"
    )


@query(
    "throughput_split",
    p.sql(
        [CATALOG],
        "select trace_id, vca, case when th_jitter <= quantile_cont(th_jitter, 0.5) over "
        "(partition by vca) then 'train' else 'test' end as split from cat",
    ),
)
def throughput_split(spark, sf_dir):
    return splits.split_traces(view.traces(spark, sf_dir), "throughput-std").select(
        "trace_id", "vca", "split"
    )


@query(
    "held_out_traces",
    p.sql(
        [CATALOG],
        "select trace_id from (select trace_id, ntile(5) over (partition by vca order by trace_id) "
        "as fold from cat) where fold = 2",
    ),
)
def held_out(spark, sf_dir):
    folds = splits.kfold(view.traces(spark, sf_dir))
    train = splits.fold_split(folds, 2).where(F.col("split") == "train")
    return splits.held_out(view.traces(spark, sf_dir), train).select("trace_id")


@query(
    "trace_profile",
    p.sql([CATALOG], "select trace_id, th, th_jitter, lat, lat_jitter, loss from cat"),
)
def trace_profile(spark, sf_dir):
    return catalog.with_profile(view.traces(spark, sf_dir)).select("trace_id", *PROFILE)


# --- frame assembly and packet sizes ----------------------------------------------------------

KEPT_COLUMNS = [*heuristics.PACKET_COLUMNS, "rtp_ts"]
DEPTHS = range(1, 11)


def kept_with_rtp(spark, sf_dir):
    return heuristics.heuristic_packets(view.packets(spark, sf_dir)).select(*KEPT_COLUMNS)


def flow_with_rtp(spark, sf_dir):
    """Packets of video size that the busiest sender sent, as frames are assembled from for a look at them."""
    flow = clean.received_flow(view.packets(spark, sf_dir))
    return clean.video_sized(flow).select(*KEPT_COLUMNS)


ERR = """er as (
  select trace_id, vca, c.f as frac_coalesce, i.f as frac_interleave from
    (select trace_id, vca, avg((n > 1)::int) as f from (select trace_id, vca, frame_num,
       count(distinct rtp_ts) as n from asg group by 1, 2, 3) group by 1, 2) c
  join (select trace_id, vca, avg((n > 1)::int) as f from (select trace_id, vca, rtp_ts,
       count(distinct frame_num) as n from asg where rtp_ts is not null group by 1, 2, 3) group by 1, 2) i
  using (trace_id, vca))"""


@query(
    "assembly_errors",
    p.sql(
        p.FLOW_KEPT + [p.LB3, ERR],
        "select trace_id, vca, round(frac_coalesce, 6) as frac_coalesce, "
        "round(frac_interleave, 6) as frac_interleave from er",
    ),
)
def assembly_errors(spark, sf_dir):
    return assembly.assembly_errors(assign_frames(flow_with_rtp(spark, sf_dir)))


@query(
    "mean_assembly_errors",
    p.sql(
        p.FLOW_KEPT + [p.LB3, ERR],
        "select vca, measure, round(100 * avg(greatest(value, 0.0)), 6) as mean_pct from er "
        "unpivot (value for measure in (frac_coalesce, frac_interleave)) group by 1, 2",
    ),
)
def mean_assembly_errors(spark, sf_dir):
    table = assembly.assembly_errors(assign_frames(flow_with_rtp(spark, sf_dir)))
    long = errors.inaccuracy_long(table, ["frac_coalesce", "frac_interleave"])
    return errors.inaccuracy_means(long)


@query(
    "assembly_error_ecdf",
    p.sql(
        p.FLOW_KEPT + [p.LB3, ERR],
        "select distinct vca, measure, round(value, 6) as value, round(cume_dist() over (partition "
        "by vca, measure order by value), 6) as cume from er "
        "unpivot (value for measure in (frac_coalesce, frac_interleave))",
    ),
)
def assembly_error_ecdf(spark, sf_dir):
    table = assembly.assembly_errors(assign_frames(flow_with_rtp(spark, sf_dir)))
    long = errors.inaccuracy_long(table, ["frac_coalesce", "frac_interleave"])
    return ecdf(long, ["vca", "measure"], "value")


def _sweep(select: str, kept: list[str]) -> str:
    parts = list(kept)
    for d in DEPTHS:
        parts.append(p.lookback(str(d), d, name=f"asg{d}"))
    union = " union all ".join(
        f"select {d} as d, trace_id, vca, rtp_ts, epoch_us, frame_num from asg{d}" for d in DEPTHS
    )
    parts += [f"sw as ({union})", p.LB]
    return p.sql(parts, select)


@query(
    "lookback_sweep_fps",
    _sweep(
        "select vca, d as depth, round(avg(mae), 6) as mae from (select vca, d, s.trace_id, "
        "avg(abs(n - fps)) as mae from (select vca, d, trace_id, e // 1000000 + 1 as ts, count(*) as n "
        "from (select vca, d, trace_id, frame_num, max(epoch_us) as e from sw group by 1, 2, 3, 4) "
        "group by 1, 2, 3, 4) s join lb on lb.trace_id = s.trace_id and lb.ts = s.ts "
        "group by 1, 2, 3) group by 1, 2",
        p.HEUR_KEPT,
    ),
)
def lookback_sweep_fps(spark, sf_dir):
    labels = view.labels(view.packets(spark, sf_dir))
    return assembly.sweep_fps_error(kept_with_rtp(spark, sf_dir), labels, DEPTHS)


@query(
    "lookback_sweep_assembly",
    _sweep(
        "select vca, d as depth, round(100 * avg(c), 6) as coalesce_pct, round(100 * avg(i), 6) as "
        "interleave_pct from (select vca, d, trace_id, avg((n > 1)::int) as c from (select vca, d, "
        "trace_id, frame_num, count(distinct rtp_ts) as n from sw group by 1, 2, 3, 4) "
        "group by 1, 2, 3) join (select vca, d, trace_id, avg((n > 1)::int) as i from (select vca, d, "
        "trace_id, rtp_ts, count(distinct frame_num) as n from sw where rtp_ts is not null "
        "group by 1, 2, 3, 4) group by 1, 2, 3) using (vca, d, trace_id) group by 1, 2",
        p.FLOW_KEPT,
    ),
)
def lookback_sweep_assembly(spark, sf_dir):
    return assembly.sweep_assembly_errors(flow_with_rtp(spark, sf_dir), DEPTHS)


@query(
    "frame_trace",
    p.sql(
        p.FLOW_KEPT + [p.LB3],
        "select pkt_ord, t_us, length, dense_rank() over (order by frame_num) as size_frame, "
        "dense_rank() over (order by rtp_ts nulls first) as rtp_frame, row_number() over "
        "(partition by frame_num order by t_us desc, pkt_ord desc) = 1 as is_last from asg "
        "where trace_id = 0 and t_us // 1000000 = 3",
    ),
)
def frame_trace(spark, sf_dir):
    return assembly.frame_trace(assign_frames(flow_with_rtp(spark, sf_dir)), 0, 3)


def sizes_sql(source: str) -> str:
    return f"""sz as (
  select trace_id, vca, rtp_ts, count(*) as n_pkts, max(length) as max_size, min(length) as min_size,
    avg(length) as mean_size
  from {source} where rtp_ts is not null group by 1, 2, 3)"""


# RTP packets of video size that reached the receiver.
SIZED = [
    p.PK, p.best("rcv", "pk"), p.join_best("sized", "pk", "rcv", "ssrc is not null and length > 306"),
    sizes_sql("sized"),
]


def frame_sizes(spark, sf_dir):
    return assembly.rtp_frame_sizes(clean.received_frames(view.packets(spark, sf_dir)))


@query(
    "rtp_frame_sizes",
    p.sql(
        [p.PK, sizes_sql("pk")],
        "select * replace (round(mean_size, 6) as mean_size), max_size - min_size as size_range from sz",
    ),
)
def rtp_frame_sizes(spark, sf_dir):
    return assembly.rtp_frame_sizes(view.packets(spark, sf_dir)).drop("chunk")


@query(
    "size_range_summary",
    p.sql(
        SIZED,
        "select vca, round(avg((max_size - min_size <= 2)::int), 6) as within_2, "
        "round(avg((max_size = min_size)::int), 6) as equal, "
        "round(avg((n_pkts < 4)::int), 6) as under_4_pkts, round(avg(mean_size), 6) as mean_size, "
        "count(*) as n_frames, round(quantile_cont(max_size - min_size, 0.96), 6) as p96, "
        "round(quantile_cont(n_pkts, 0.96), 6) as p96_pkts from sz group by 1",
    ),
)
def size_range_summary(spark, sf_dir):
    return assembly.size_range_summary(frame_sizes(spark, sf_dir))


@query(
    "frame_length_ecdf",
    p.sql(
        SIZED,
        "select distinct vca, n_pkts, round(cume_dist() over (partition by vca order by n_pkts), 6) as cume from sz",
    ),
)
def frame_length_ecdf(spark, sf_dir):
    return ecdf(frame_sizes(spark, sf_dir), ["vca"], "n_pkts")


@query(
    "inter_frame_difference",
    p.sql(
        [*p.FLOW, sizes_sql("flow")],
        "select * from (select trace_id, vca, rtp_ts, max_size - min_size as intra_diff, "
        "greatest(abs(min_size - lag(max_size) over w), abs(max_size - lag(min_size) over w)) as inter_diff "
        "from sz window w as (partition by trace_id order by rtp_ts)) where inter_diff is not null",
    ),
)
def inter_frame_difference(spark, sf_dir):
    flow = clean.received_flow(view.packets(spark, sf_dir))
    return assembly.inter_frame_difference(assembly.rtp_frame_sizes(flow))


IS_VIDEO = "(coalesce(p_type in ('98', '99'), false) and ssrc is not null and length > 306)"


@query(
    "media_confusion",
    p.sql(
        [*p.FLOW, f"fl as (select *, {IS_VIDEO}::int as is_video from flow)"],
        "select vca, is_video, (length > 306)::int as is_video_pred, count(*) as n, "
        "round(100 * count(*) / sum(count(*)) over (partition by vca, is_video), 6) as row_pct "
        "from fl group by 1, 2, 3",
    ),
)
def media_confusion(spark, sf_dir):
    flow = clean.received_flow(view.packets(spark, sf_dir))
    return assembly.media_confusion(flow, view.payload_types(spark))


@query(
    "misclassified_packets",
    p.sql(p.FLOW, f"select trace_id, pkt_ord, p_type, length from flow where length > 306 and not {IS_VIDEO}"),
)
def misclassified(spark, sf_dir):
    flow = clean.received_flow(view.packets(spark, sf_dir))
    return assembly.misclassified(flow, view.payload_types(spark)).select(
        "trace_id", "pkt_ord", "p_type", "length"
    )


@query(
    "payload_type_sizes",
    p.sql(
        p.FLOW,
        "select vca, p_type, count(*) as n, min(length) as min_size, max(length) as max_size, "
        "round(avg(length), 6) as mean_size, round(100 * count(*) / sum(count(*)) over "
        "(partition by vca), 6) as share_pct, round(quantile_cont(length, 0.01), 6) as p1 "
        "from flow where p_type is not null and ssrc is not null group by 1, 2",
    ),
)
def payload_type_sizes(spark, sf_dir):
    return assembly.payload_type_sizes(clean.received_flow(view.packets(spark, sf_dir)))


@query(
    "payload_type_ecdf",
    p.sql(
        p.FLOW,
        "select distinct vca, p_type, length, round(cume_dist() over (partition by vca, p_type "
        "order by length), 6) as cume from flow where p_type is not null and ssrc is not null",
    ),
)
def payload_type_ecdf(spark, sf_dir):
    return assembly.payload_type_ecdf(clean.received_flow(view.packets(spark, sf_dir)))


def durations_sql(source: str, where: str = "true") -> str:
    return (
        "select vca, round(sum(s), 6) as seconds, count(*) as n_traces from (select vca, trace_id, "
        f"(max(t_us) - min(t_us)) / 1e6 as s from {source} where {where} group by 1, 2) group by 1"
    )


@query("trace_durations", p.sql(p.FLOW, durations_sql("flow")))
def trace_durations(spark, sf_dir):
    return assembly.trace_durations(clean.received_flow(view.packets(spark, sf_dir)))


@query("rtp_durations", p.sql([p.PK], durations_sql("pk", "ssrc is not null")))
def rtp_durations(spark, sf_dir):
    return assembly.trace_durations(clean.rtp_only(view.packets(spark, sf_dir)))


RATES = """rt as (
  select trace_id, vca, epoch_us // 1000000 as ts, sum(length) * 8 / 1000.0 as kbps from pk
  where length > 304 group by 1, 2, 3),
ra as (
  select rt.trace_id, vca, rt.ts, rt.ts - min(rt.ts) over (partition by rt.trace_id) as rel_s, kbps,
    bitrate / 1000 as label_kbps
  from rt join lb on rt.trace_id = lb.trace_id and rt.ts = lb.ts)"""


@query(
    "throughput_against_labels",
    p.sql(
        [p.PK, p.LB, RATES],
        "select * replace (round(kbps, 6) as kbps, round(label_kbps, 6) as label_kbps) from ra",
    ),
)
def throughput_against_labels(spark, sf_dir):
    pk = view.packets(spark, sf_dir)
    return assembly.throughput_against_labels(pk, view.labels(pk))


@query(
    "peak_by_relative_second",
    p.sql(
        [p.PK, p.LB, RATES],
        "select vca, rel_s, round(max(kbps), 6) as peak_kbps, round(max(label_kbps), 6) as "
        "peak_label_kbps from ra group by 1, 2",
    ),
)
def peak_by_relative_second(spark, sf_dir):
    pk = view.packets(spark, sf_dir)
    return assembly.peak_by_relative_second(
        assembly.throughput_against_labels(pk, view.labels(pk))
    )


@query(
    "throughput_ecdf",
    p.sql(
        [p.PK, p.LB, RATES],
        "select distinct vca, round(kbps, 6) as kbps, round(cume_dist() over (partition by vca order "
        "by kbps), 6) as cume from rt",
    ),
)
def throughput_ecdf(spark, sf_dir):
    return ecdf(assembly.throughput(view.packets(spark, sf_dir)), ["vca"], "kbps")


# Label samples: the last packet of every labelled second, as a browser would note it.
SAMPLES = """sm as (
  select trace_id, vca, epoch_us // 1000000 as ts, max(t_us) as t_us from pk where rtp_ts is not null
  group by 1, 2, 3),
gp as (
  select * from (select trace_id, vca, ts, (t_us - lag(t_us) over (partition by trace_id order by t_us))
    / 1e6 as gap from sm) where gap is not null),
gb as (
  select *, case when gap <= 0.8 then 'le_0_8' when gap <= 1.2 then 'le_1_2' when gap <= 2 then 'le_2'
    else 'gt_2' end as gap_bin from gp)"""


def samples(spark, sf_dir):
    pk = view.packets(spark, sf_dir)
    return (
        pk.where(F.col("rtp_ts").isNotNull())
        .groupBy("trace_id", "vca", second_of("epoch_us").alias("ts"))
        .agg(F.max("t_us").alias("t_us"), F.max("chunk").alias("chunk"))
    )


@query(
    "sampling_intervals",
    p.sql([p.PK, SAMPLES], "select trace_id, vca, ts, round(gap, 6) as gap, gap_bin from gb"),
)
def sampling_intervals(spark, sf_dir):
    return errors.sampling_intervals(samples(spark, sf_dir)).select(
        "trace_id", "vca", "ts", "gap", "gap_bin"
    )


@query(
    "sampling_shares",
    p.sql(
        [p.PK, SAMPLES],
        "select vca, " + ", ".join(
            f"round(count(*) filter (gap_bin = '{b}') / count(*), 6) as \"{b}\""
            for b in ("le_0_8", "le_1_2", "le_2", "gt_2")
        ) + " from gb group by 1",
    ),
)
def sampling_shares(spark, sf_dir):
    return errors.sampling_shares(errors.sampling_intervals(samples(spark, sf_dir)))


@query(
    "fps_error_by_sampling",
    pred_sql(
        f"select g.vca, gap_bin, round(avg(abs(pred - gt)), 6) as mae, {BOX} from pred p join gb g "
        "on p.trace_id = g.trace_id and p.ts = g.ts where metric = 'framesReceivedPerSecond' "
        "group by 1, 2",
        SAMPLES,
    ),
)
def fps_error_by_sampling(spark, sf_dir):
    fps = errors.with_deviation(
        predictions(spark, sf_dir).where(F.col("metric") == errors.FPS)
    )
    gaps = errors.sampling_intervals(samples(spark, sf_dir)).select("trace_id", "ts", "gap_bin")
    joined = fps.join(gaps, ["trace_id", "ts"])
    keys = ["vca", "gap_bin"]
    mae = joined.groupBy(*keys).agg(F.avg("abs_dev").alias("mae"))
    return mae.join(quantiles(joined, keys, "dev", errors.BOX), keys)


@query(
    "label_description",
    p.sql(
        [p.PK, p.LB],
        "select vca, count(*) as n, round(avg(bitrate), 6) as mean, round(stddev_samp(bitrate), 6) as "
        "std, min(bitrate) as min, max(bitrate) as max, "
        + quantile_sql("bitrate", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
        + " from lb join (select distinct trace_id, vca from pk) using (trace_id) group by 1",
    ),
)
def label_description(spark, sf_dir):
    return errors.describe(_labels_by_app(spark, sf_dir), ["vca"], "bitrate")


@query(
    "description_by_dataset",
    pred_sql(
        "select dataset, metric, method, side, count(*) as n, round(avg(value), 6) as mean, "
        "round(stddev_samp(value), 6) as std, round(min(value), 6) as min, round(max(value), 6) as max, "
        + quantile_sql("value", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
        + " from (select c.dataset, metric, method, unnest(['pred', 'gt']) as side, "
        "unnest([pred, gt]) as value from pred p join cat c using (trace_id)) group by 1, 2, 3, 4",
        CATALOG,
    ),
)
def description_by_dataset(spark, sf_dir):
    traces = view.traces(spark, sf_dir).drop("vca")
    joined = errors.with_traces(predictions(spark, sf_dir), traces)
    return errors.describe_both(joined, ["dataset", "metric", "method"])


@query(
    "frames_with_large_packets",
    p.sql(
        [p.PK],
        "select vca, count(*) as n_frames, cast(sum(n) as bigint) as n_pkts from (select vca, "
        "trace_id, rtp_ts, count(*) as n from pk where rtp_ts is not null and length > 400 "
        "group by 1, 2, 3) group by 1",
    ),
)
def frames_with_large_packets(spark, sf_dir):
    big = clean.video_sized(clean.rtp_only(view.packets(spark, sf_dir)), 400)
    return (
        assembly.rtp_frame_sizes(big)
        .groupBy("vca")
        .agg(F.count(F.lit(1)).alias("n_frames"), F.sum("n_pkts").alias("n_pkts"))
    )


# --- features next to labels ------------------------------------------------------------------


@query(
    "labelled_features",
    p.sql(
        p.ML_KEPT + p.anchors() + p.placed() + [
            p.LB,
            f'ft as (select trace_id, vca, "interval", et, {p.L_COLS}, {p.T_COLS} from win group by 1, 2, 3, 4)',
        ],
        'select ft.*, l.fps as "framesReceivedPerSecond", l.bitrate from ft join lb l '
        "on l.trace_id = ft.trace_id and l.ts = ft.et",
        recursive=True,
    ),
)
def labelled_features(spark, sf_dir):
    pk = view.packets(spark, sf_dir)
    return features.join_labels(
        features.ip_udp_features(pk), view.labels(pk), ["framesReceivedPerSecond", "bitrate"]
    )


@query(
    "rtp_ml_features",
    p.sql(
        p.RTP_KEPT + p.anchors() + p.placed("right") + p.RTP_STATS + p.placed(name="lwin") + [
            f'ft as (select trace_id, vca, "interval", et, {p.L_COLS}, {p.T_COLS} from lwin group by 1, 2, 3, 4)',
        ],
        'select ft.*, rf.* exclude (trace_id, vca, "interval", et) from ft '
        "join rf on rf.trace_id = ft.trace_id and rf.et = ft.et",
        recursive=True,
    ),
)
def rtp_ml_features(spark, sf_dir):
    return features.rtp_ml_features(view.packets(spark, sf_dir), view.payload_types(spark))


@query(
    "sender_features",
    p.sql(
        [
            p.PK, p.CL, p.best("rcv", "cl"),
            p.join_best("rx", "cl", "rcv", "ip_proto = 17 and length > 306"),
            p.best("snd", "rx", "ip_src"),
            p.join_best("kept", "rx", "snd", "true", "ip_src"),
        ] + p.anchors() + p.placed(),
        f'select trace_id, vca, "interval", et, {p.L_COLS}, {p.T_COLS} from win group by 1, 2, 3, 4',
        recursive=True,
    ),
)
def sender_features(spark, sf_dir):
    return features.sender_features(view.packets(spark, sf_dir))
