"""Order-dependent work over traces of any length.

A trace is a time-ordered row sequence, and one trace may hold a large share of all rows. Nothing
here therefore partitions a packet window by ``trace_id`` alone. Packets carry a ``chunk``: a run of
the trace in (time, packet order), short enough to hold a bounded number of rows. All per-row windows
run over ``(trace_id, chunk)``; what must pass from one chunk to the next (the last few rows, running
counts, totals) is first reduced to one row per chunk, combined over the trace in that small
table, and joined back on ``(trace_id, chunk)``, the partitioning the packets already have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelens.functions import SECOND_US, idiv
from framelens.session import cut_lineage

KEYS = ["trace_id", "chunk"]
ORDER = ["t_us", "pkt_ord"]
ROWS_PER_CHUNK = 200_000
MAX_CHUNK_US = 30 * SECOND_US
# A chunk's number: its stretch of trace time, then its place within that, then within one time.
PART_BITS, SUB_BITS = 14, 18
# A crowded stretch is counted in so many cells first, and a crowded cell by single times.
CELLS = 1_024
CELL = ["trace_id", "_stretch", "_cell"]
LONGEST = "longest_trace"


def _stretches(packets: DataFrame, span_us: int) -> DataFrame:
    return packets.select("trace_id", idiv("t_us", span_us).alias("_stretch"), "t_us", "pkt_ord")


def _cell(span_us: int) -> Column:
    """The cell of a time within its stretch of trace time."""
    width = max(1, -(-span_us // CELLS))
    return idiv(F.col("t_us") - F.col("_stretch") * span_us, width)


def crowded_cells(packets: DataFrame, crowded: DataFrame, rows_per_chunk: int, span_us: int) -> tuple:
    """Where to cut the crowded stretches: tables of places by cell, by single time and within one.

    Rows are counted per cell; cells with more than half of ``rows_per_chunk`` again per time. Running
    sums over these counts give every cell or time its place in the stretch, a new one for every such
    half, so a place holds ``rows_per_chunk`` rows at most. Within a time with more rows than a half,
    the packet order is cut at packets picked by hash, one in a sixteenth of ``rows_per_chunk``.
    """
    half = max(1, rows_per_chunk // 2)
    rows = _stretches(packets, span_us).join(crowded.select("trace_id", "_stretch"), ["trace_id", "_stretch"])
    rows = rows.select(*CELL[:2], _cell(span_us).alias("_cell"), "t_us", "pkt_ord")
    full = rows.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > half)
    single = F.when(F.col("_full"), F.col("t_us")).alias("t_us")
    by_leaf = rows.join(full.select(*CELL, F.lit(True).alias("_full")), CELL, "left").groupBy(*CELL, single)
    leaves = by_leaf.agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*CELL[:2]).orderBy("_cell", "t_us").rowsBetween(Window.unboundedPreceding, -1)
    sub = F.floor(F.coalesce(F.sum("n").over(order), F.lit(0)) / half)
    placed = cut_lineage(leaves.select(*CELL, "t_us", "n", sub.cast("bigint").alias("_sub")))
    bursts = placed.where(F.col("t_us").isNotNull() & (F.col("n") > half)).select("trace_id", "t_us")
    every = F.lit(max(1, rows_per_chunk // 16))
    picked = rows.join(bursts, ["trace_id", "t_us"]).where(
        F.pmod(F.xxhash64("trace_id", "t_us", "pkt_ord"), every) == 0
    )
    cuts = picked.groupBy("trace_id", "t_us").agg(F.sort_array(F.collect_set("pkt_ord")).alias("_cuts"))
    by_cell = placed.where(F.col("t_us").isNull()).select(*CELL, F.col("_sub").alias("_by_cell"))
    by_time = placed.where(F.col("t_us").isNotNull()).select("trace_id", "t_us", F.col("_sub").alias("_by_time"))
    return by_cell, by_time, cut_lineage(cuts)


def _numbered(stretch: Column, sub=None, part=None) -> Column:
    number = stretch * (1 << (SUB_BITS + PART_BITS))
    return number if sub is None else number + sub * (1 << PART_BITS) + F.least(part, F.lit((1 << PART_BITS) - 1))


def assign_chunks(
    packets: DataFrame, span_us: int | None = None, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Add ``chunk``: ``span_us`` of trace time each, or fitted to hold about ``rows_per_chunk`` rows.

    One job counts rows per stretch of ``MAX_CHUNK_US``. At call rates no stretch is crowded and the
    chunk is an expression of the time. Crowded stretches, wherever they are, are cut by counts at
    (time, packet order), even inside one microsecond; the cuts are tables that rows are joined to, so
    nothing about single traces comes to the driver. The column's metadata keeps the number of rows of
    the longest trace.
    """
    columns = [c for c in packets.columns if c != "chunk"]
    if span_us is not None:
        return packets.select(*columns, _numbered(idiv("t_us", span_us)).alias("chunk"))
    span = MAX_CHUNK_US
    counts = _stretches(packets, span).groupBy(*CELL[:2]).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("trace_id").agg(F.sum("n").alias("n"), F.max("n").alias("fullest"))
    longest, fullest = totals.agg(F.max("n"), F.max("fullest")).first()
    known = {LONGEST: longest or 0}
    if (fullest or 0) <= rows_per_chunk:
        return packets.select(*columns, _numbered(idiv("t_us", span)).alias("chunk", metadata=known))
    crowded = cut_lineage(counts.where(F.col("n") > rows_per_chunk))
    by_cell, by_time, cuts = crowded_cells(packets, crowded, rows_per_chunk, span)
    rows = packets.select(*columns, idiv("t_us", span).alias("_stretch")).withColumn("_cell", _cell(span))
    rows = rows.join(by_cell, CELL, "left").join(by_time, ["trace_id", "t_us"], "left").join(cuts, ["trace_id", "t_us"], "left")
    sub = F.coalesce("_by_time", "_by_cell", F.lit(0))
    part = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c <= F.col("pkt_ord"))))
    return rows.select(*columns, _numbered(F.col("_stretch"), sub, part).alias("chunk", metadata=known))


def longest_trace(packets: DataFrame) -> int | None:
    """Rows of the longest trace when chunks were fitted, if known; filters since only took rows away."""
    return packets.schema["chunk"].metadata.get(LONGEST)


def in_chunk(order: Sequence[str] = ORDER):
    return Window.partitionBy(*KEYS).orderBy(*order)


def before_chunk():
    """Over a one-row-per-chunk table: all earlier chunks of the trace."""
    return (
        Window.partitionBy("trace_id")
        .orderBy("chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def after_chunk():
    """All later chunks, nearest last, as a growing frame (linear cost)."""
    return (
        Window.partitionBy("trace_id")
        .orderBy(F.col("chunk").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def whole_trace():
    """Over a one-row-per-chunk table: every chunk of the trace."""
    return Window.partitionBy("trace_id")


def with_previous(
    df: DataFrame,
    fields: Sequence[str],
    offsets: Sequence[int],
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Add ``prev_<k>``, a struct of ``fields`` from the row ``k`` places earlier in the trace.

    Inside a chunk this is ``lag``. The first rows of a chunk take theirs from the last rows of
    the chunks before, gathered at most ``max(offsets)`` per chunk. Narrow ``df`` to the columns
    that are used afterwards: both branches then read the same exchange.
    """
    reach = max(offsets)
    w = in_chunk(order)
    body = [c for c in df.columns if c not in KEYS]
    local = df.select(
        "*",
        F.row_number().over(w).alias("_rn"),
        F.lead(F.lit(1), reach).over(w).isNull().alias("_tail"),
        *[F.lag(F.struct(*fields), k).over(w).alias(f"_lag_{k}") for k in offsets],
    )
    tails = (
        local.where("_tail")
        .groupBy(*KEYS)
        .agg(
            F.sort_array(
                F.collect_list(F.struct("_rn", F.struct(*body).alias("row"))), asc=False
            ).alias("_last")
        )
    )
    carried = tails.select(*KEYS, nearest_before("_last", reach).alias("_carry"))
    joined = local.join(carried, KEYS, "left")

    def earlier(k: int) -> Column:
        row = F.get("_carry", F.lit(k) - F.col("_rn"))["row"]
        from_carry = F.when(
            row.isNotNull(), F.struct(*[row[f].alias(f) for f in fields])
        )
        return F.coalesce(F.col(f"_lag_{k}"), from_carry).alias(f"prev_{k}")

    return joined.select(*df.columns, *[earlier(k) for k in offsets])


def total_before(value) -> Column:
    """Over a one-row-per-chunk table: the sum over all earlier chunks of the trace."""
    return F.coalesce(F.sum(value).over(before_chunk()), F.lit(0))


def nearest_before(values: str, reach: int) -> Column:
    """Over a one-row-per-chunk table: the ``reach`` array elements closest before the chunk.

    ``values`` lists up to ``reach`` last elements of each chunk, latest first; so does the result.
    """
    near = Window.partitionBy("trace_id").orderBy("chunk").rowsBetween(-reach, -1)
    return F.slice(F.flatten(F.reverse(F.collect_list(values).over(near))), 1, reach)
