"""Exact ranks, quantiles and distribution functions of groups of any size.

Groups here are few and large (an application, a method), so a window per group would sort a third
of all rows in one task. Rows are first counted per distinct value. A hash of the value then picks
about ``PIECES`` values over all groups as cutting points, which split each group into pieces in
proportion to its size; ranks are taken inside a piece and shifted by the counts of the pieces
before it. The cutting points only decide how the work is divided, never the result.

The counted values are read several times, so they are checkpointed once: what produced them (often
a whole estimation plan) runs a single time and lost executors cost no recomputation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelens.session import cut_lineage

PIECES = 256


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group keys, rows with a null key forming a group of their own."""
    own = {k: f"_right_{k}" for k in keys}
    other = right.withColumnsRenamed(own)
    on = [left[k].eqNullSafe(other[name]) for k, name in own.items()]
    return left.join(other, on, how).drop(*own.values())


def value_ranks(
    df: DataFrame, keys: Sequence[str], value: str, pieces: int = PIECES
) -> DataFrame:
    """One row per group and distinct value: ``n`` rows with it, ``upto`` rows at or below it,
    ``total`` rows in the group. Null values do not count."""
    keys = list(keys)
    counts = cut_lineage(
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    distinct = counts.agg(F.count(F.lit(1)).alias("n")).scalar()
    every = F.greatest(F.lit(1), F.call_function("div", distinct, F.lit(pieces)))
    chosen = F.pmod(F.xxhash64(value, *keys), every) == 0
    # About `pieces` values in total, whatever the input size.
    cuts = (
        counts.where(chosen)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(value)).alias("_cuts"))
    )
    if keys:
        cut = join_groups(counts, F.broadcast(cuts), keys, "left")
    else:
        cut = counts.crossJoin(F.broadcast(cuts))
    below = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    located = cut.select(
        *keys,
        value,
        "n",
        F.when(F.col("_cuts").isNull(), 0).otherwise(below).alias("_piece"),
    )
    sizes = located.groupBy(*keys, "_piece").agg(F.sum("n").alias("_n"))
    group = Window.partitionBy(*keys)
    starts = sizes.select(
        *keys,
        "_piece",
        F.coalesce(
            F.sum("_n").over(group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_start"),
        F.sum("_n").over(group).alias("total"),
    )
    inside = (
        Window.partitionBy(*keys, "_piece")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return join_groups(located, starts, [*keys, "_piece"]).select(
        *keys,
        value,
        "n",
        (F.col("_start") + F.sum("n").over(inside)).alias("upto"),
        "total",
    )


def ecdf(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Share of the group's rows at or below each distinct value."""
    ranks = value_ranks(df, keys, value)
    return ranks.select(*keys, value, (F.col("upto") / F.col("total")).alias("cume"))


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs``."""
    ranks = value_ranks(df, keys, value)

    def at(place: Column) -> Column:
        held = (F.col("upto") > place) & (F.col("upto") - F.col("n") <= place)
        return F.max(F.when(held, F.col(value).cast("double")))

    parts, result = [], []
    for name, p in probs.items():
        h = (F.col("total") - 1) * F.lit(float(p))
        parts += [
            at(F.floor(h)).alias(f"_lo_{name}"),
            at(F.ceil(h)).alias(f"_hi_{name}"),
            F.max(h - F.floor(h)).alias(f"_f_{name}"),
        ]
        lo, hi, f = (F.col(f"_{x}_{name}") for x in ("lo", "hi", "f"))
        result.append((lo + (hi - lo) * f).alias(name))
    grouped = ranks.groupBy(*keys) if keys else ranks
    return grouped.agg(*parts).select(*keys, *result)


def positions(df: DataFrame, keys: Sequence[str], order: str, name: str = "pos") -> DataFrame:
    """Add the 0-based position of a row in its group, and the group size ``total``.

    ``order`` must be unique within a group.
    """
    ranks = value_ranks(df, keys, order).select(
        *keys, order, (F.col("upto") - 1).alias(name), "total"
    )
    return join_groups(df, ranks, [*keys, order])
