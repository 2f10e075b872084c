"""Captures, dumps and catalog of data directories under one id per trace.

The catalog decides which capture and which dump make a trace, and its ``trace_id`` is the id of both:
whatever reader a file comes through, its path is brought to one plain form first. Files that the
catalog leaves out are read by nobody downstream.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.sources.catalog import IN_LAB, REAL_WORLD, capture_name, trace_catalog
from framelens.sources.dumps import read_dumps
from framelens.sources.packets import read_raw, typed


def data_sets(roots: list[str]) -> dict[str, list[str]]:
    """The known data directories among ``roots``, by the data set their base name says."""
    found: dict[str, list[str]] = {}
    for root in roots:
        dataset = root.rstrip("/").rsplit("/", 1)[-1]
        if dataset in (*IN_LAB, *REAL_WORLD):
            found.setdefault(dataset, []).append(root.rstrip("/"))
    return found


def linked_traces(spark: SparkSession, roots: list[str]) -> DataFrame:
    """dataset, vca, trace_id, csv_path and json_path of every trace that has both files."""
    return trace_catalog(spark, [r for some in data_sets(roots).values() for r in some])


def linked_packets(
    spark: SparkSession, roots: list[str], traces: DataFrame, headered: bool = True
) -> DataFrame:
    """The packets of the catalog's captures, without chunks (see ``operators.chunks``)."""
    parts = [
        typed(read_raw(spark, f"{root}/*", headered), dataset)
        for dataset, some in data_sets(roots).items()
        for root in some
    ]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.join(traces.select("dataset", "trace_id"), ["dataset", "trace_id"], "left_semi")


def linked_dumps(spark: SparkSession, roots: list[str], traces: DataFrame) -> DataFrame:
    """(trace_id, body) of the catalog's dumps, under the id of the capture."""
    parts = [read_dumps(spark, f"{root}/*") for some in data_sets(roots).values() for root in some]
    bodies = reduce(DataFrame.unionByName, parts).withColumnRenamed("trace_id", "_dump")
    ids = traces.select("trace_id", capture_name("json_path").alias("_dump"))
    return bodies.join(ids, "_dump").select("trace_id", "body")
