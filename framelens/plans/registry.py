"""Named queries over the packet, label and catalog views, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


# Added before rounding in both engines, which differ on exact ties (n.nnnnnn5).
NUDGE = 1e-9


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, so both engines print the same value."""
    return df.select(
        *[
            F.round(F.col(c) + NUDGE, places).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = lambda spark, sf_dir: rounded(build(spark, sf_dir))
        if sql is not None:
            # Roundings are written ", 6)"; nothing else in the twins is.
            SQL[name] = sql.replace(", 6)", f" + {NUDGE}, 6)")
        return build

    return register
