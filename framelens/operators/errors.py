"""Error analysis over predictions: metric, method, vca, [fold,] trace_id, ts, pred, gt."""

from __future__ import annotations

from functools import reduce
from math import exp, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelens.functions import SAMPLING_BINS, resolution_bin, sampling_bin
from framelens.operators.chunks import with_previous
from framelens.operators.ranks import ecdf, quantiles

FPS = "framesReceivedPerSecond"
# Metrics that count frames a second and are scored within the tolerance.
FRAME_METRICS = ["framesPerSecond", FPS, "framesDecodedPerSecond", "framesRendered"]
BOX = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}
# Tolerance around the truth per metric (fps, bit/s) and relative bitrate.
FPS_TOLERANCE = 2
BITRATE_TOLERANCE = 50_000
RELATIVE_TOLERANCE = 0.25
# Partitions for work that is many times larger than its input.
DEALT = 240


def with_deviation(predictions: DataFrame) -> DataFrame:
    """Add ``dev`` (prediction minus truth) and ``abs_dev``."""
    dev = F.col("pred") - F.col("gt")
    return predictions.select("*", dev.alias("dev"), F.abs(dev).alias("abs_dev"))


def all_results(parts: list[DataFrame]) -> DataFrame:
    """Predictions of several methods, metrics and folds in one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_labels(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions next to every label column of the same trace second."""
    return predictions.join(labels, ["trace_id", "ts"])


def with_traces(predictions: DataFrame, traces: DataFrame) -> DataFrame:
    """Predictions next to their catalog row (profile, dataset)."""
    extra = [c for c in traces.columns if c == "trace_id" or c not in predictions.columns]
    return predictions.join(traces.select(*extra), "trace_id")


def per_trace_scores(predictions: DataFrame) -> DataFrame:
    """MAE, share within the fps tolerance and share exactly right per trace."""
    scored = with_deviation(predictions)
    return scored.groupBy("metric", "method", "vca", "trace_id").agg(
        F.avg("abs_dev").alias("mae"),
        F.avg((F.col("abs_dev") <= FPS_TOLERANCE).cast("int")).alias("within_2"),
        F.avg((F.col("pred") == F.col("gt")).cast("int")).alias("exact"),
        F.count(F.lit(1)).alias("n"),
    )


def macro_scores(predictions: DataFrame) -> DataFrame:
    """Means over traces of the per-trace scores; accuracy where it applies."""
    m = F.col("metric")
    return (
        per_trace_scores(predictions)
        .groupBy("metric", "method", "vca")
        .agg(
            F.avg("mae").alias("_mae"),
            F.avg("within_2").alias("_near"),
            F.avg("exact").alias("_exact"),
            F.count(F.lit(1)).alias("n_traces"),
        )
        .select(
            "metric",
            "method",
            "vca",
            F.when(m != "frameHeight", F.col("_mae")).alias("mae"),
            F.when(m.isin(FRAME_METRICS), F.col("_near"))
            .when(m == "frameHeight", F.col("_exact"))
            .alias("accuracy"),
            "n_traces",
        )
    )


def micro_mae(predictions: DataFrame, keys=("metric", "method", "vca")) -> DataFrame:
    """MAE over all seconds; bitrate in kbit/s."""
    scale = F.when(F.col("metric") == "bitrate", 1000).otherwise(1)
    return (
        with_deviation(predictions)
        .groupBy(*keys)
        .agg(F.avg(F.col("abs_dev") / scale).alias("mae"))
    )


def central_truth(predictions: DataFrame) -> DataFrame:
    """Median truth per (metric, application) and its mean."""
    keys = ["metric", "vca"]
    truth = predictions.select(*keys, "trace_id", "ts", "gt").distinct()
    means = truth.groupBy(*keys).agg(F.avg("gt").alias("mean"))
    return quantiles(truth, keys, "gt", {"median": 0.5}).join(means, keys)


def error_ecdf(predictions: DataFrame, keys=("metric", "method")) -> DataFrame:
    return ecdf(with_deviation(predictions), list(keys), "abs_dev")


def error_boxes(predictions: DataFrame, keys=("metric", "vca", "method")) -> DataFrame:
    return quantiles(with_deviation(predictions), list(keys), "dev", BOX)


def tolerance_shares(predictions: DataFrame) -> DataFrame:
    """Percent of seconds within +-2 fps, +-50 kbit/s and +-25 % of the truth."""
    d = with_deviation(predictions)
    fps, rate = F.col("metric") == FPS, F.col("metric") == "bitrate"
    rel = F.try_divide("abs_dev", "gt") <= RELATIVE_TOLERANCE

    def share(where: Column, hit: Column) -> Column:
        return F.avg(F.when(where, F.coalesce(hit, F.lit(False)).cast("int"))) * 100

    return d.groupBy("method", "vca").agg(
        share(fps, F.col("abs_dev") <= FPS_TOLERANCE).alias("fps_within_2"),
        share(rate, F.col("abs_dev") <= BITRATE_TOLERANCE).alias("bitrate_within_50k"),
        share(rate, rel).alias("bitrate_within_25pct"),
    )


def relative_errors(predictions: DataFrame) -> DataFrame:
    """Relative bitrate error per second; a zero truth gives null."""
    rate = with_deviation(predictions).where(F.col("metric") == "bitrate")
    return rate.withColumn("rel_dev", F.try_divide("dev", "gt"))


def mean_relative_error(predictions: DataFrame) -> DataFrame:
    return (
        relative_errors(predictions)
        .groupBy("method", "vca")
        .agg((F.avg(F.abs("rel_dev")) * 100).alias("mean_rel_pct"))
    )


def call_seconds(predictions: DataFrame, durations: DataFrame, metric: str, method: str) -> DataFrame:
    """Call time per application: the labelled duration of every trace that one metric and method
    predict, summed.

    ``durations`` has trace_id and duration, once per trace or, as labels do, once per second.
    """
    scored = predictions.where((F.col("metric") == metric) & (F.col("method") == method))
    traces = scored.groupBy("vca", "trace_id").agg(F.count(F.lit(1)).alias("_n"))
    each = durations.groupBy("trace_id").agg(F.avg("duration").alias("duration"))
    return traces.join(each, "trace_id").groupBy("vca").agg(
        F.sum("duration").alias("seconds"), F.count(F.lit(1)).alias("n_traces")
    )


def confusion(predictions: DataFrame, keys=("method", "vca")) -> DataFrame:
    """Truth (rows) against prediction of resolution classes: counts and row shares."""
    keys = list(keys)
    binned = predictions.select(
        *keys,
        resolution_bin("gt").alias("gt_bin"),
        resolution_bin("pred").alias("pred_bin"),
    ).where(F.col("gt_bin").isNotNull() & F.col("pred_bin").isNotNull())
    counts = binned.groupBy(*keys, "gt_bin", "pred_bin").agg(F.count(F.lit(1)).alias("n"))
    row = F.sum("n").over(Window.partitionBy(*keys, "gt_bin"))
    total = Window.partitionBy(*keys)
    right = F.sum(F.when(F.col("gt_bin") == F.col("pred_bin"), F.col("n")).otherwise(0))
    return counts.select(
        *keys,
        "gt_bin",
        "pred_bin",
        "n",
        (F.col("n") / row).alias("row_share"),
        (right.over(total) / F.sum("n").over(total)).alias("accuracy"),
    )


def confusion_matrix(predictions: DataFrame, keys=("method", "vca")) -> DataFrame:
    """The same counts with one column per predicted class."""
    classes = ["low", "medium", "high"]
    return (
        confusion(predictions, keys)
        .groupBy(*keys, "gt_bin")
        .pivot("pred_bin", classes)
        .agg(F.first("n"))
        .na.fill(0, classes)
    )


def class_shares(df: DataFrame, keys, cls: str) -> DataFrame:
    """Share of each class within its group."""
    keys = list(keys)
    counts = df.groupBy(*keys, cls).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn(
        "share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    )


def top_importances(importances: DataFrame, k: int) -> DataFrame:
    """Features with the k largest mean scores over folds, per metric, method, application."""
    keys = ["metric", "method", "vca"]
    means = importances.groupBy(*keys, "feature").agg(F.avg("score").alias("score"))
    best = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "feature")
    return means.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def parameter_sensitivity(
    predictions: DataFrame, profile: list[str], keys=("metric", "method", "vca")
) -> DataFrame:
    """Mean absolute error with a 95 % interval for every value of every network parameter."""
    long = with_deviation(predictions).unpivot(
        [*keys, "abs_dev"], profile, "parameter", "setting"
    )
    stats = long.groupBy(*keys, "parameter", "setting").agg(
        F.avg("abs_dev").alias("mae"),
        F.stddev_samp("abs_dev").alias("_sd"),
        F.count(F.lit(1)).alias("n"),
    )
    half = F.lit(1.96) * F.col("_sd") / F.sqrt("n")
    return stats.select(
        *keys,
        "parameter",
        "setting",
        "mae",
        (F.col("mae") - half).alias("ci_low"),
        (F.col("mae") + half).alias("ci_high"),
        "n",
    )


def poisson_cuts() -> list[int]:
    """The 32-bit numbers from which on a Poisson(1) draw is at least 1, 2, 3 and so on."""
    cuts, share, below = [], exp(-1), 0.0
    while (cut := floor((below + share) * 2**32)) < 2**32 - 1:
        cuts.append(cut)
        below += share
        share /= len(cuts)
    return cuts


def _poisson(digest: str) -> Column:
    """Draws by the first 32 bits of a hash in hexadecimal, whose digits sort as the numbers do."""
    cuts = poisson_cuts()
    draw = F.when(F.col(digest) < f"{cuts[0]:08x}", 0)
    for k, cut in enumerate(cuts[1:], 1):
        draw = draw.when(F.col(digest) < f"{cut:08x}", k)
    return draw.otherwise(len(cuts))


def bootstrap_sensitivity(
    predictions: DataFrame, profile: list[str], keys=("metric", "method", "vca"), rounds: int = 100
) -> DataFrame:
    """Mean absolute error with a 95 % bootstrap interval for every value of every network parameter.

    Each round weighs every predicted second by a Poisson(1) draw, taken from a hash of the second and
    the round, so bounds repeat. A draw serves all parameters: seconds are drawn once a round and added up
    per minute of a trace before parameters become rows. Bounds are quantiles of the
    rounds' means. A group that a round leaves without weight has no mean there.
    """
    keys = list(keys)
    group = [*keys, "parameter", "setting"]
    # Small rows make many: dealt out by number before that, as they would be put together by size.
    place = [*keys, "trace_id", "_minute"]
    dealt = (
        with_deviation(predictions)
        .withColumn("_minute", F.call_function("div", F.col("ts"), F.lit(60)))
        .repartition(DEALT, *place)
    )
    drawn = dealt.select(
        *place,
        "ts",
        *profile,
        "abs_dev",
        F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"),
    )
    of_minute = (
        drawn.withColumn("_hash", F.md5(F.concat_ws("|", *keys, "trace_id", "ts", "round")))
        .withColumn("w", _poisson("_hash"))
        .groupBy(*place, *profile, "round")
        .agg(
            F.sum(F.col("w") * F.col("abs_dev")).alias("weighted"),
            F.sum("w").alias("weight"),
            F.sum("abs_dev").alias("total"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    means = (
        of_minute.unpivot([*keys, "round", "weighted", "weight", "total", "n"], profile, "parameter", "setting")
        .groupBy(*group, "round")
        .agg(
            F.try_divide(F.sum("weighted"), F.sum("weight")).alias("mean"),
            F.sum("total").alias("total"),
            F.sum("n").alias("n"),
        )
    )
    return means.groupBy(*group).agg(
        (F.max("total") / F.max("n")).alias("mae"),
        F.percentile("mean", F.lit(0.025)).alias("ci_low"),
        F.percentile("mean", F.lit(0.975)).alias("ci_high"),
        F.max("n").alias("n"),
    )


def sensitivity_boxes(
    predictions: DataFrame, profile: list[str], keys=("metric", "method", "vca")
) -> DataFrame:
    long = with_deviation(predictions).unpivot(
        [*keys, "dev"], profile, "parameter", "setting"
    )
    return quantiles(long, [*keys, "parameter", "setting"], "dev", BOX)


def large_errors(predictions: DataFrame, over: float = 5) -> DataFrame:
    return with_deviation(predictions).where(F.col("abs_dev") > over)


def time_series(predictions: DataFrame, trace_id) -> DataFrame:
    """Prediction and truth of one trace in time order."""
    return predictions.where(F.col("trace_id") == F.lit(trace_id)).orderBy(
        "metric", "method", "ts"
    )


def inaccuracy_long(table: DataFrame, measures: list[str]) -> DataFrame:
    """(vca, measure, value) from one column per frame-assembly error, clamped at 0."""
    return table.unpivot(["vca"], measures, "measure", "value").withColumn(
        "value", F.greatest("value", F.lit(0.0))
    )


def inaccuracy_means(long: DataFrame) -> DataFrame:
    return long.groupBy("vca", "measure").agg((F.avg("value") * 100).alias("mean_pct"))


def sampling_intervals(samples: DataFrame, order: str = "t_us") -> DataFrame:
    """Seconds between consecutive label samples of a trace, binned.

    ``samples``: trace_id, vca, chunk and the sample time in microseconds.
    """
    seen = with_previous(samples, [order], [1], order=[order])
    gap = (F.col(order) - F.col("prev_1")[order]) / 1e6
    return seen.select(
        *samples.columns, gap.alias("gap"), sampling_bin(gap).alias("gap_bin")
    ).where(F.col("gap").isNotNull())


def sampling_shares(intervals: DataFrame) -> DataFrame:
    """Share of each interval bin per application, one column per bin."""
    shares = class_shares(intervals, ["vca"], "gap_bin")
    return (
        shares.groupBy("vca")
        .pivot("gap_bin", SAMPLING_BINS)
        .agg(F.first("share"))
        .na.fill(0.0, SAMPLING_BINS)
    )


def describe(df: DataFrame, keys, value: str) -> DataFrame:
    """count, mean, std, min, p10, median, p90, max of a value per group."""
    keys = list(keys)
    basics = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    spread = quantiles(df, keys, value, {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return basics.join(spread, keys)


def describe_both(predictions: DataFrame, keys) -> DataFrame:
    """``describe`` of predictions and of the truth, side by side per group (data set, metric, method)."""
    keys = list(keys)
    return describe(predictions.unpivot(keys, ["pred", "gt"], "side", "value"), [*keys, "side"], "value")
