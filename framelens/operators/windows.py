"""Anchor-reset prediction windows.

A window opens at a packet more than ``window_us`` after the packet that opened the window before
it, so where a window starts depends on all packets before it. Cut into chunks this becomes: what
is the last anchor of a chunk, given the last anchor before it? Later entries never give earlier
exits, so the answer is a step function per chunk, with at most as many steps as the chunk has
different times in its first window. Step functions of neighbours compose to one of their union,
which gives a tree over the chunks of a trace:

1. per chunk, in parallel: the step function, by pointer doubling over the sorted times;
2. upwards, level by level: functions of neighbouring chunks are composed, until the functions of
   a trace fit one group; no group takes more than 1.5 times ``STEPS_PER_GROUP`` steps, or three
   functions where single ones are larger than that allows;
3. downwards: the anchor each node, then each chunk, is entered with;
4. per chunk, in parallel: the anchors, now that the entry is known.

Where the longest trace is known to have at most ``STEPS_PER_GROUP`` rows, its functions fit one
group to begin with and no tree is built. Packets are then placed by comparing their time with the
few anchors of their chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.functions import SECOND_US, second_of
from framelens.operators.chunks import KEYS, after_chunk, before_chunk, longest_trace
from framelens.session import cut_lineage

# After the two key columns, whose types follow the packets.
STEPS = "limits array<bigint>, exits array<bigint>"
ENTRIES = "entry bigint"
ANCHORS = (
    "entry bigint, last_epoch bigint, "
    "anchors array<struct<t_us:bigint,pkt_ord:bigint,epoch_us:bigint>>"
)
# 64 MB of limits and exits.
STEPS_PER_GROUP = 4_000_000
FUNCTIONS_PER_GROUP = 4_096
BEFORE_ALL = -(1 << 62)

INTS = pa.list_(pa.int64())


def _row(rows: pa.Table, **columns: pa.Array) -> pa.Table:
    """One output row with the keys of its group."""
    head = rows.select(KEYS).slice(0, 1)
    return pa.table({**{k: head[k] for k in KEYS}, **columns})


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.asarray(v.values) for part in column.chunks for v in part]


def _follow(times: np.ndarray, window_us: int) -> np.ndarray:
    """Index of the first time more than one window later, or len(times)."""
    return np.searchsorted(times, times + window_us, side="right")


def chunk_steps(times: np.ndarray, window_us: int) -> tuple[np.ndarray, np.ndarray]:
    """The step function of one chunk.

    With ``x`` the end of the window open at entry, the last anchor inside the chunk is
    ``exits[i]`` for the first ``limits[i] > x``; without such a limit no window opens here.
    """
    after = _follow(times, window_us)
    here = np.arange(len(times))
    jump = np.where(after < len(times), after, here)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    # Only a time up to the first one past a full window can be the first anchor.
    entries = min(after[0], len(times) - 1) + 1
    exits = jump[:entries]
    last = np.append(np.flatnonzero(np.diff(exits)), entries - 1)
    return times[last], times[exits[last]]


def chunk_anchors(times: np.ndarray, entry: int | None, window_us: int) -> list[int]:
    """Positions in ``times`` that open a window, given the anchor open at entry."""
    after = _follow(times, window_us)
    at = 0 if entry is None else int(np.searchsorted(times, entry + window_us, side="right"))
    found = []
    while at < len(times):
        found.append(at)
        at = int(after[at])
    return found


def composed(
    functions: list[tuple[np.ndarray, np.ndarray]], window_us: int
) -> tuple[np.ndarray, np.ndarray]:
    """The step function of neighbouring chunks, out of theirs in time order."""
    limits, exits = functions[0]
    for further, last in functions[1:]:
        at = np.searchsorted(further, exits + window_us, side="right")
        moved = np.where(at < len(further), last[np.minimum(at, len(further) - 1)], exits)
        limits, exits = np.concatenate([limits, further]), np.concatenate([moved, last])
        # The window open at entry began before the first time, so it ends before this.
        reach = np.searchsorted(limits, limits[0] + window_us, side="left") + 1
        limits, exits = limits[:reach], exits[:reach]
        ends = np.append(np.flatnonzero(np.diff(exits)), len(exits) - 1)
        limits, exits = limits[ends], exits[ends]
    return limits, exits


def entered_with(
    functions: list[tuple[np.ndarray, np.ndarray]], anchor: int | None, window_us: int
) -> list[int | None]:
    """The anchor open at entry of each of neighbouring chunks, given that of the first."""
    entered = []
    for limits, exits in functions:
        entered.append(anchor)
        reach = BEFORE_ALL if anchor is None else anchor + window_us
        at = int(np.searchsorted(limits, reach, side="right"))
        if at < len(limits):
            anchor = int(exits[at])
    return entered


def _functions(rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    return list(zip(_lists(rows["limits"]), _lists(rows["exits"])))


def with_nodes(functions: DataFrame, budget: int) -> DataFrame:
    """The functions with ``node``, the number of the stretch of neighbours they are composed in.

    Numbers come from running sums over one narrow row per chunk; the steps are joined on after.
    """
    weight = F.greatest(F.size("limits"), F.lit(max(1, budget // FUNCTIONS_PER_GROUP)))
    slim = functions.select(*KEYS, weight.cast("bigint").alias("_n"))
    before = F.coalesce(F.sum("_n").over(before_chunk()), F.lit(0))
    nodes = slim.select(*KEYS, F.floor(before / F.lit(budget)).cast("bigint").alias("node"))
    return functions.join(nodes, KEYS)


def _sizes(functions: DataFrame) -> tuple[int, int, int]:
    """The most steps and functions of a trace, and the most steps of a function."""
    n = F.size("limits")
    per_trace = functions.groupBy("trace_id").agg(
        F.sum(n).alias("steps"), F.count(F.lit(1)).alias("rows"), F.max(n).alias("largest")
    )
    found = per_trace.agg(F.max("steps"), F.max("rows"), F.max("largest")).first()
    return tuple(v or 0 for v in found)


def chunk_entries(functions: DataFrame, window_us: int, whole: bool) -> DataFrame:
    """(trace_id, chunk, entry): the anchor each chunk is entered with, null at the trace start.

    ``whole``: the functions of every trace are known to fit one group.
    """
    types = dict(functions.dtypes)
    keyed = f"trace_id {types['trace_id']}, chunk bigint, "

    def entries(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        found = entered_with(_functions(rows), None, window_us)
        return rows.select(KEYS).append_column("entry", pa.array(found, pa.int64()))

    def up(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        limits, exits = composed(_functions(rows), window_us)
        head = rows.select(["trace_id", "node"]).slice(0, 1).rename_columns(KEYS)
        return head.append_column("limits", pa.array([limits], INTS)).append_column(
            "exits", pa.array([exits], INTS)
        )

    def down(rows: pa.Table, node: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        found = entered_with(_functions(rows), node["entry"][0].as_py(), window_us)
        return rows.select(KEYS).append_column("entry", pa.array(found, pa.int64()))

    levels = []
    if not whole:
        functions = cut_lineage(functions)
        while True:
            steps, rows, largest = _sizes(functions)
            if steps <= STEPS_PER_GROUP and rows <= FUNCTIONS_PER_GROUP:
                break
            # At least two functions to a node, so that every level is half the one below.
            levels.append(with_nodes(functions, max(STEPS_PER_GROUP, 2 * largest)))
            nodes = levels[-1].groupBy("trace_id", "node").applyInArrow(up, keyed + STEPS)
            functions = cut_lineage(nodes)
            if _sizes(functions)[1] == 1:
                break
    entered = functions.groupBy("trace_id").applyInArrow(entries, keyed + ENTRIES)
    for level in reversed(levels):
        parents = entered.select("trace_id", F.col("chunk").alias("node"), "entry")
        entered = (
            level.groupBy("trace_id", "node")
            .cogroup(parents.groupBy("trace_id", "node"))
            .applyInArrow(down, keyed + ENTRIES)
        )
    return entered


def anchor_table(packets: DataFrame, window_us: int = SECOND_US) -> DataFrame:
    """One row per chunk: its anchors and how intervals continue over its borders.

    Columns: entry (anchor time open at entry, null at the trace start), anchors,
    opened (windows opened before the chunk), next_epoch (epoch of the next anchor after the
    chunk), final_epoch (epoch of the last packet of the trace).
    """
    times = packets.select(*KEYS, "t_us", "pkt_ord", "epoch_us")
    keyed = f"trace_id {dict(packets.dtypes)['trace_id']}, chunk bigint, "

    def steps(rows: pa.Table) -> pa.Table:
        limits, exits = chunk_steps(np.unique(rows["t_us"].to_numpy()), window_us)
        return _row(rows, limits=pa.array([limits], INTS), exits=pa.array([exits], INTS))

    def anchors(rows: pa.Table, entry: pa.Table) -> pa.Table:
        t, n, e = (rows[c].to_numpy() for c in ("t_us", "pkt_ord", "epoch_us"))
        order = np.lexsort((n, t))
        t, n, e = t[order], n[order], e[order]
        before = entry["entry"][0].as_py()
        at = chunk_anchors(t, before, window_us)
        opened = pa.StructArray.from_arrays(
            [pa.array(v[at]) for v in (t, n, e)], names=["t_us", "pkt_ord", "epoch_us"]
        )
        return _row(
            rows,
            entry=pa.array([before], pa.int64()),
            last_epoch=pa.array([e[-1]], pa.int64()),
            anchors=pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), opened),
        )

    per_chunk = times.groupBy(*KEYS)
    longest = longest_trace(packets)
    entered = chunk_entries(
        per_chunk.applyInArrow(steps, keyed + STEPS),
        window_us,
        whole=longest is not None and longest <= STEPS_PER_GROUP,
    )
    found = per_chunk.cogroup(entered.groupBy(*KEYS)).applyInArrow(anchors, keyed + ANCHORS)
    first_here = F.get("anchors", F.lit(0))["epoch_us"]
    opened = F.sum(F.size("anchors")).over(before_chunk())
    return found.select(
        *KEYS,
        "entry",
        "anchors",
        F.coalesce(opened, F.lit(0)).alias("opened"),
        F.last(first_here, ignorenulls=True).over(after_chunk()).alias("next_epoch"),
        F.coalesce(F.first("last_epoch").over(after_chunk()), F.col("last_epoch")).alias(
            "final_epoch"
        ),
    )


def assign_windows(
    packets: DataFrame,
    window_us: int = SECOND_US,
    closed: str = "left",
    table: DataFrame | None = None,
) -> DataFrame:
    """Add ``interval`` (1-based), ``interval_start`` (anchor time) and ``et``.

    ``closed='left'``: the packet that opens a window belongs to it. ``closed='right'``: that
    packet still counts in the window it closes (header features); the first window keeps its
    opener. ``table`` is the anchor table of the same packets, if it is at hand: derive it from
    them before other columns are joined on, so that work is not repeated for it. ``et`` is the epoch second of the packet that opens the next window, or of the last
    packet of the trace.
    """
    if table is None:
        table = anchor_table(packets, window_us)
    placed = packets.join(table, KEYS).withColumn(
        "_pos", F.size(F.filter("anchors", lambda a: a["t_us"] <= F.col("t_us")))
    )
    if closed == "right":
        at = F.get("anchors", F.col("_pos") - 1)
        opener = (at["t_us"] == F.col("t_us")) & (at["pkt_ord"] == F.col("pkt_ord"))
        behind = opener & (F.col("opened") + F.col("_pos") > 1)
        # Packets sharing the opener's time but after it in order stay in the new window.
        placed = placed.withColumn(
            "_pos", F.col("_pos") - F.coalesce(behind.cast("int"), F.lit(0))
        )
    start = F.when(F.col("_pos") > 0, F.get("anchors", F.col("_pos") - 1)["t_us"]).otherwise(
        F.col("entry")
    )
    end = F.coalesce(F.get("anchors", F.col("_pos"))["epoch_us"], "next_epoch", "final_epoch")
    return placed.select(
        *packets.columns,
        (F.col("opened") + F.col("_pos")).alias("interval"),
        start.alias("interval_start"),
        second_of(end).alias("et"),
    )
