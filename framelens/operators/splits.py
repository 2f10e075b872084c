"""Training and test splits over a trace catalog (one row per trace)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.operators.ranks import join_groups, positions, quantiles
from framelens.sources.catalog import with_profile

PROFILE = ["th", "th_jitter", "lat", "lat_jitter", "loss"]


def kfold(traces: DataFrame, k: int = 5, order: str = "trace_id") -> DataFrame:
    """Add ``fold`` (1..k): contiguous, unshuffled; the first ``n % k`` folds get one more."""
    placed = positions(traces, ["vca"], order, "_pos")
    small = F.call_function("div", F.col("total"), F.lit(k))
    extra = F.col("total") % k
    big_rows = extra * (small + 1)
    fold = F.when(
        F.col("_pos") < big_rows, F.call_function("div", F.col("_pos"), small + 1)
    ).otherwise(
        extra
        + F.call_function("div", F.col("_pos") - big_rows, F.greatest(small, F.lit(1)))
    )
    return placed.select(*traces.columns, (fold + 1).alias("fold"))


def fold_split(folds: DataFrame, fold: int) -> DataFrame:
    """Mark each trace 'train' or 'test' for one fold."""
    return folds.withColumn("split", F.when(F.col("fold") == fold, "test").otherwise("train"))


def random_split(traces: DataFrame, ratio: float, seed: int = 7) -> DataFrame:
    """``int(ratio * n)`` traces per application train, drawn by a seeded hash of the id."""
    drawn = traces.withColumn(
        "_draw", F.md5(F.concat(F.lit(f"{seed}:"), F.col("trace_id").cast("string")))
    )
    placed = positions(drawn, ["vca"], "_draw", "_pos")
    train = F.col("_pos") < F.floor(F.col("total") * F.lit(ratio))
    return placed.select(*traces.columns, F.when(train, "train").otherwise("test").alias("split"))


def network_split(traces: DataFrame, ratio: float) -> DataFrame:
    """The first ``int(ratio * n)`` traces of every network profile train."""
    profiled = with_profile(traces)
    placed = positions(profiled, ["vca", *PROFILE], "trace_id", "_pos")
    train = F.col("_pos") < F.floor(F.col("total") * F.lit(ratio))
    return placed.select(*traces.columns, F.when(train, "train").otherwise("test").alias("split"))


def throughput_split(traces: DataFrame) -> DataFrame:
    """Traces at or below the application's median throughput jitter train, all others test.

    Traces without a profile have no jitter and test.

    One median per application: a handful of rows, hence the broadcast.
    """
    profiled = with_profile(traces)
    median = quantiles(profiled, ["vca"], "th_jitter", {"_median": 0.5})
    joined = join_groups(profiled, F.broadcast(median), ["vca"], "left")
    train = F.col("th_jitter") <= F.col("_median")
    return joined.select(*traces.columns, F.when(train, "train").otherwise("test").alias("split"))


def split_traces(
    traces: DataFrame, criterion: str, ratio: float = 0.8, seed: int = 7
) -> DataFrame:
    """Dispatch on 'random', 'network-condition' or 'throughput-std'."""
    if criterion == "random":
        return random_split(traces, ratio, seed)
    if criterion == "network-condition":
        return network_split(traces, ratio)
    if criterion == "throughput-std":
        return throughput_split(traces)
    raise ValueError(f"unknown split criterion {criterion}")


def held_out(traces: DataFrame, train: DataFrame) -> DataFrame:
    """Traces not in ``train``."""
    return traces.join(train.select("trace_id"), "trace_id", "left_anti")
