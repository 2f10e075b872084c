"""Trace catalogs: captures linked to their ground truth, and what file names say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.session import listing

IN_LAB = ("in_lab_data", "hashed_in_lab")
REAL_WORLD = ("real_world_data", "hashed_real_world")
PROFILE = ["th", "th_jitter", "lat", "lat_jitter", "loss"]


def plain_path(path="_metadata.file_path") -> Column:
    """A file's path without scheme and URL escapes, the same from whatever reader lists it."""
    bare = F.regexp_replace(path, "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    # A plus sign is no blank in a path.
    return F.url_decode(F.regexp_replace(bare, "\\+", "%2B"))


def capture_name(path) -> Column:
    """``<data directory>/<folder>/<file stem>`` of a plain path: the id of a capture or dump.

    It does not depend on where the data directory is mounted.
    """
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), "\\.[^.]*$", "")
    return F.concat_ws("/", F.get(parts, F.size(parts) - 3), F.get(parts, F.size(parts) - 2), stem)


def _list(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """Paths below ``root`` one level deep; file contents are pruned from the scan."""
    with listing(spark):
        found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(f"{root}/*")
    files = found.select(plain_path().alias("path"))
    parts = F.split("path", "/")
    return files.select(
        "path",
        F.element_at(parts, -2).alias("folder"),
        F.element_at(parts, -1).alias("name"),
        capture_name("path").alias("id"),
    )


def experiment_app(folder) -> Column:
    """``<date>_<vca>_<profile>`` directories name the application second."""
    return F.get(F.split(folder, "_"), F.lit(1))


def capture_app(name) -> Column:
    """``<a>-<vca>-...`` file names do too."""
    return F.get(F.split(name, "-"), F.lit(1))


def in_lab_traces(spark: SparkSession, root: str) -> DataFrame:
    """One trace per experiment directory holding a capture and a dump."""
    csv = _list(spark, root, "csv").groupBy("folder").agg(F.min("path").alias("csv_path"))
    dump = _list(spark, root, "json").groupBy("folder").agg(F.min("path").alias("json_path"))
    return csv.join(dump, "folder").select(
        experiment_app("folder").alias("vca"), "csv_path", "json_path"
    )


def real_world_traces(spark: SparkSession, root: str) -> DataFrame:
    """One trace per capture with a dump of the same stem in the same device directory."""
    csv = _list(spark, root, "csv").select("id", "name", F.col("path").alias("csv_path"))
    dump = _list(spark, root, "json").select("id", F.col("path").alias("json_path"))
    return csv.join(dump, "id").select(
        capture_app("name").alias("vca"), "csv_path", "json_path"
    )


def trace_catalog(spark: SparkSession, roots: list[str]) -> DataFrame:
    """The catalog of several data directories, told apart by their base names."""
    found = []
    for root in roots:
        dataset = root.rstrip("/").rsplit("/", 1)[-1]
        if dataset in IN_LAB:
            rows = in_lab_traces(spark, root)
        elif dataset in REAL_WORLD:
            rows = real_world_traces(spark, root)
        else:
            continue
        found.append(
            rows.select(
                F.lit(dataset).alias("dataset"),
                "vca",
                capture_name("csv_path").alias("trace_id"),
                "csv_path",
                "json_path",
            )
        )
    if not found:
        return spark.createDataFrame(
            [],
            "dataset string, vca string, trace_id string, csv_path string, json_path string",
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def profile_columns(csv_path="csv_path") -> list[Column]:
    """Throughput, its jitter, latency, its jitter and loss out of
    ``<vca>-<browser>-<th>_<thj>_<lat>_<latj>_<loss>[_...]-<epoch>.csv``."""
    name = F.element_at(F.split(csv_path, "/"), -1)
    stem = F.get(F.split(name, "\\."), F.lit(0))
    fields = F.split(F.get(F.split(stem, "-"), F.lit(2)), "_")
    return [
        F.get(fields, F.lit(i)).try_cast("int").alias(c) for i, c in enumerate(PROFILE)
    ]


def with_profile(traces: DataFrame) -> DataFrame:
    return traces.select("*", *profile_columns())


def trial_id(metric, method, subset, dataset, fold) -> Column:
    """``metric_method_subset_dataset_cv_fold``."""
    return F.concat_ws("_", metric, method, subset, dataset, F.lit("cv"), fold.cast("string"))
