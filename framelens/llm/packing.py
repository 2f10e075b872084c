"""Packing of documents into token sequences of fixed capacity by minimum bin slack.

A document's tokens are cut into pieces of at most the capacity. Full pieces are sequences of their own.
The rest have lengths below the capacity, so however many documents there are, what is left to pack is a
histogram of fewer than `capacity` counts. The plan is made from that histogram alone: for each window, a
bitset subset-sum programme finds the multiset of remaining lengths, with the longest one in it, whose
sum comes closest to the capacity; the multiset is traced back with its counts and used as often as the
histogram allows. Pieces then look up their place by length and rank within their length.

Nulls: a null text is an empty one. Its only token is the end id. A null doc_id is an id like any other.
Repeated rows are packed as often as they come. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm.common import spread, stored, text_or_empty
from framelens.llm.vocab import encoder

# Tasks among which the pieces of one length are ranked.
RANK_WAYS = 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece of at most `capacity` ids of each text, the end id included."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch[0].to_pylist(), encode(batch[1].to_pylist()), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return docs.select("doc_id", text_or_empty()).mapInArrow(cut, PIECES)


def fullest(left: list[int], room: int) -> dict[int, int]:
    """The multiset of lengths whose sum comes closest to `room` from below, as counts by length.

    left[i] is how many pieces of length i remain. Counts are split into powers of two, each one item;
    bit s of a set says that the items so far can sum to s.
    """
    reach, items, within = [1], [], (1 << (room + 1)) - 1
    for length in range(room, 0, -1):
        many, part = min(left[length], room // length), 1
        while many:
            part = min(part, many)
            many -= part
            items.append((length, part))
            reach.append((reach[-1] | reach[-1] << (length * part)) & within)
            part *= 2
        if reach[-1] >> room & 1:
            break
    total, counts = reach[-1].bit_length() - 1, {}
    for at in range(len(items), 0, -1):
        if not reach[at - 1] >> total & 1:
            length, part = items[at - 1]
            counts[length] = counts.get(length, 0) + part
            total -= length * part
    return counts


def bin_slack_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, how many in a sequence, offset of the first, first sequence, sequences).

    Sequences are numbered from 0. Every row says: from that rank on, so many pieces of that length go
    side by side into each of so many sequences that follow one another.
    """
    left = [0] * (capacity + 1)
    for length, n in histogram.items():
        left[length] = n
    used, plan, sequence, longest = [0] * (capacity + 1), [], 0, capacity
    while longest:
        if not left[longest]:
            longest -= 1
            continue
        left[longest] -= 1
        counts = fullest(left, capacity - longest)
        left[longest] += 1
        counts[longest] = counts.get(longest, 0) + 1
        times = min(left[length] // n for length, n in counts.items())
        lengths = sorted(counts, reverse=True)
        for length, offset in zip(lengths, accumulate([0, *(n * counts[n] for n in lengths[:-1])]), strict=True):
            plan.append((length, used[length], counts[length], offset, sequence, times))
            used[length] += counts[length] * times
            left[length] -= counts[length] * times
        sequence += times
    return plan


def ranked(pieces: DataFrame) -> DataFrame:
    """Pieces with their rank within their length, from 0; many tasks share a length."""
    dealt = pieces.withColumn("deal", spread("doc_id", "start", ways=RANK_WAYS))
    before = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("length", "deal")
        .agg(F.count("*").alias("n"))
        .select("length", "deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    within = Window.partitionBy("length", "deal").orderBy("doc_id", "start")
    return (
        dealt.withColumn("rank", F.row_number().over(within) - 1)
        .join(starts, ["length", "deal"])
        .withColumn("rank", F.col("rank") + F.col("first"))
        .drop("deal", "first")
    )


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Pieces with sequence_id and offset. Pieces must be stored: they are read more than once."""
    histogram = {
        r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    }  # at most `capacity` rows
    plan = np.array(bin_slack_plan(histogram, capacity), np.int64).reshape(-1, 6)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rank and length in one number, so one search finds the row of the plan.
        wide = int(plan[:, 1].max(initial=0)) + 1
        keys = plan[:, 0] * wide + plan[:, 1]
        for batch in batches:
            length, rank = (batch[c].to_numpy() for c in ("length", "rank"))
            row = plan[np.searchsorted(keys, length * wide + np.minimum(rank, wide - 1), "right") - 1]
            turn, side = np.divmod(rank - row[:, 1], np.maximum(row[:, 2], 1))
            out = [*batch.columns[:-1], pa.array(row[:, 4] + turn), pa.array(row[:, 3] + side * length)]
            yield pa.RecordBatch.from_arrays(out, [*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked(pieces).select(*PIECE_COLUMNS, F.col("rank").cast("long")).mapInArrow(
        look_up, f"{PIECES}, sequence_id long, offset long"
    )


PIECE_COLUMNS = [c.split()[0] for c in PIECES.split(", ")]


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """One row per piece: its document, its place in it and its sequence and offset there."""
    return place(stored(token_pieces(docs, vocabulary, end_id, capacity), "pieces"), capacity)
