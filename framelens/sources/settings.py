"""Payload types, thresholds and look-back depths (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# RTP payload types per dataset, application and role.
VIDEO_TYPES = {
    "in_lab_data": {"meet": ["96", "98"], "teams": ["102"], "webex": ["102"]},
    "real_world_data": {"meet": ["98"], "teams": ["100"], "webex": ["100"]},
}
RTX_TYPES = {
    "in_lab_data": {"meet": ["99"], "teams": ["103"], "webex": []},
    "real_world_data": {"meet": ["99"], "teams": ["101"], "webex": []},
}
# Hashed captures share the payload types of the plain ones.
SAME_TYPES_AS = {"hashed_in_lab": "in_lab_data", "hashed_real_world": "real_world_data"}

# Frame assembly and feature widths.
VIDEO_BYTES = 306
THROUGHPUT_BYTES = 304
RTP_HEADER_BYTES = 12
SIZE_TOLERANCE = 2
LOOKBACK = {"meet": 3, "teams": 2, "webex": 1}
VECTOR_WIDTH = {"teams": 800, "meet": 600, "webex": 600}

PTYPE_SCHEMA = "dataset string, vca string, role string, p_type string"


@dataclass(frozen=True)
class Settings:
    window_us: int = 1_000_000
    video_bytes: int = VIDEO_BYTES
    tolerance: int = SIZE_TOLERANCE
    lookback: dict = field(default_factory=lambda: dict(LOOKBACK))
    vector_width: dict = field(default_factory=lambda: dict(VECTOR_WIDTH))


def by_app(values: dict, default=None) -> Column:
    """A per-application setting as a column over ``vca``."""
    out = F.lit(default)
    for vca, value in values.items():
        out = F.when(F.col("vca") == vca, F.lit(value)).otherwise(out)
    return out


def payload_types(spark: SparkSession) -> DataFrame:
    """The payload-type table: dataset, vca, role ('video' or 'rtx'), p_type."""
    rows = []
    for dataset in [*VIDEO_TYPES, *SAME_TYPES_AS]:
        source = SAME_TYPES_AS.get(dataset, dataset)
        for role, table in (("video", VIDEO_TYPES), ("rtx", RTX_TYPES)):
            for vca, types in table[source].items():
                rows += [(dataset, vca, role, p) for p in types]
    return spark.createDataFrame(rows, PTYPE_SCHEMA)
