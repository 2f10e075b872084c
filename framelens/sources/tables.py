"""Stored features, predictions, splits, models and run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTION_KEYS = ["metric", "method", "fold", "vca"]


def write_features(features: DataFrame, path: str) -> None:
    """Features of all traces, one directory per application (and dataset, if present)."""
    keys = [c for c in ("dataset", "vca") if c in features.columns]
    features.write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Replace only the (metric, method, fold, vca) directories that ``predictions`` holds.

    Also used for importances, which have the same keys: a repeated run leaves no duplicates.
    """
    (
        predictions.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PREDICTION_KEYS)
        .parquet(path)
    )


def read_predictions(spark: SparkSession, path: str, **keys) -> DataFrame:
    """Predictions, pruned to the given partition values."""
    df = spark.read.parquet(path)
    for key, value in keys.items():
        df = df.where(F.col(key) == value)
    return df


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def append_run_metrics(metrics: DataFrame, path: str) -> None:
    """Append (trial, vca, MAE, accuracy) rows with the time of the run."""
    metrics.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def call_logs(folds: DataFrame, fold: int, vca: str | None = None) -> DataFrame:
    """The test traces of one fold."""
    rows = folds.where(F.col("fold") == fold)
    return rows if vca is None else rows.where(F.col("vca") == vca)
