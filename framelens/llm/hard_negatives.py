"""Hard negatives from candidate blocks along a Hilbert curve, chosen by interval arithmetic.

Candidates are sorted along a Hilbert curve through all dimensions, the most spread ones first, and written
as Parquet in folders of about FOLDER_ROWS rows, cut into ranges and those into blocks of BLOCK_ROWS. A zone map
holds the least and greatest component of a block in every dimension, and its labels. For an anchor a, its scores
in a block lie between sum(min(a_i * low_i, a_i * high_i)) and sum(max(...)), so a block is read for an
anchor only if this interval meets what is looked for:

- positives: the PROBES blocks with the greatest upper bounds are read first; their fifth best score is a
  lower bound that decides which other blocks are read;
- negatives: the blocks whose interval meets one of the anchor's windows [80 % of a positive's score, its score].

Anchors come in tiles of neighbouring folders or ranges. A unit of work is a tile and a page of zone maps, or a tile
and a range of candidates: both bounded at any input size. Nothing but the spread of the dimensions passes
through the driver. Scores are 64-bit integers by limb-split products (vectors.exact_dot).

Nulls: rows with a null label, a null or empty vector or a null or non-finite component take no part, nor do
vectors of another length than the first one's. A row with a null id is a candidate that loses all ties, never
an anchor. Rows that repeat an id are candidates of their own, but never of an anchor of that id; a repeated
anchor has its rows as often as it is repeated. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm.common import shared_folder, small, stored
from framelens.llm.vectors import NO_ID, exact_dot, floors, id_or_last, lists, whole_rows

SCALE, ANCHOR_STEP, MOVED_STEP, LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES = 5, 5
LOW_SHARE, HIGH_SHARE = 4, 5  # 80 and 100 per cent
FOLDER_ROWS, RANGE_ROWS, BLOCK_ROWS, ZONES_PER_PAGE, PROBES = 1 << 19, 1 << 13, 1 << 9, 4_096, 2
ANCHORS_PER_TILE, RANGES_PER_TILE = 8_192, 16
FOLDER = 1 << 20  # ranges are numbered within a folder, from this multiple of its number
BLOCK = ["folder", "range", "block"]
BITS = 3  # of a dimension's place on the curve
# Up to so many rows (about 32 MB) of a list of blocks are sent to all executors.
MANY = 1_000_000


def hilbert(places: np.ndarray, bits: int) -> list[bytes]:
    """Keys whose byte order is the order along a Hilbert curve through a grid of 2^bits cells a dimension.

    The first dimensions decide first. Reflections and exchanges of axes are undone bit by bit from the
    top, and what is left is the Gray code of the way along the curve.
    """
    x = places.T.astype(np.int64).copy()
    if not x.size:
        return [b""] * len(places)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(len(x)):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
        bit >>= 1
    x = np.bitwise_xor.accumulate(x, axis=0)
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where(x[-1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= flip
    shifts = np.arange(bits - 1, -1, -1)
    planes = (x.T[:, None, :] >> shifts[None, :, None]) & 1
    return [k.tobytes() for k in np.packbits(planes.reshape(len(places), -1).astype(np.uint8), axis=1)]


def _matrix(rows: pa.Table | pa.RecordBatch, column: str, width: int) -> np.ndarray:
    lists_ = rows[column]
    if isinstance(lists_, pa.ChunkedArray):
        lists_ = lists_.combine_chunks()
    return lists_.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists_), width)


def _apart(df: DataFrame) -> DataFrame:
    """The same rows under columns of their own, so that two sides of one origin can be grouped together."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def candidates(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, label and the vector as it came, of the rows that take part; and the vectors' length."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % MOVED_STEP == 0, (label + 1) % LABELS).otherwise(label)
    rows = vectors.where(F.col("label").isNotNull()).select(
        id_or_last("vec_id").alias("vec_id"), moved.alias("label"), "embedding"
    )
    return whole_rows(rows, "vec_id", "embedding")


def spread_of(rows: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Dimensions by falling variance, least and greatest components in that order, and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = floors(batch["embedding"], dims, SCALE)
            if len(x):
                sums = [x.min(0), x.max(0), x.sum(0).astype(np.float64), (x.astype(np.float64) ** 2).sum(0), np.full(dims, len(x))]
                names = ["low", "high", "one", "two", "n"]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), *map(pa.array, sums)], ["dim", *names])

    parts = rows.select("embedding").mapInArrow(run, "dim long, low long, high long, one double, two double, n long")
    found = parts.groupBy("dim").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"),
        (F.sum("two") / F.sum("n") - (F.sum("one") / F.sum("n")) ** 2).alias("variance"),
    ).orderBy(F.desc("variance"), "dim").toArrow()
    dim, low, high, n = (found[c].to_numpy() for c in ("dim", "low", "high", "n"))
    return dim, low, high, int(n[0]) if len(n) else 0


def write_blocks(rows: DataFrame, dims: int, path: str) -> None:
    """Write the candidates as folder, range, block, vec_id, label, vec, in the order of the curve."""
    dim, low, high, n = spread_of(rows, dims)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = floors(batch["embedding"], dims, SCALE)
            places = ((x[:, dim] - low) << BITS) // (high - low + 1)
            keys = pa.array(hilbert(places, BITS), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["label"], lists(x, pa.int32()), keys], ["vec_id", "label", "vec", "key"]
            )

    kept = rows.select("vec_id", "label", "embedding")
    curve = kept.mapInArrow(keyed, "vec_id long, label long, vec array<int>, key binary")
    # The id parts long runs of one key.
    dealt = curve.repartitionByRange(max(1, -(-n // FOLDER_ROWS)), "key", "vec_id").sortWithinPartitions("key", "vec_id")
    # Unlike a window, counts in the order the rows are in.
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = dealt.select(F.spark_partition_id().alias("folder"), within.alias("at"), "vec_id", "label", "vec")
    range_ = (F.col("folder").cast("long") * FOLDER + F.floor(F.col("at") / RANGE_ROWS)).alias("range")
    placed.select("folder", range_, F.floor(F.col("at") / BLOCK_ROWS).alias("block"), "vec_id", "label", "vec").write.partitionBy(
        "folder"
    ).parquet(path)


def zone_maps(blocks: DataFrame, dims: int) -> DataFrame:
    """Per block, or piece of one that a task reads: the least and greatest component by dimension, and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, label = _matrix(batch, "vec", dims), batch["label"].to_numpy()
            place = np.stack([batch[c].to_numpy() for c in ("folder", "range", "block")])
            starts = np.append(0, np.flatnonzero((np.diff(place) != 0).any(0)) + 1)
            ends = [f.reduceat(y, starts, axis=0) for y in (label, x) for f in (np.minimum, np.maximum)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(p[starts]) for p in place.astype(np.int64)]
                + [pa.array(ends[0]), pa.array(ends[1]), lists(ends[2], pa.int32()), lists(ends[3], pa.int32())],
                ["folder", "range", "block", "label_low", "label_high", "low", "high"],
            )

    schema = "folder long, range long, block long, label_low long, label_high long, low array<int>, high array<int>"
    places = [F.col(c).cast("long").alias(c) for c in BLOCK]
    return blocks.select(*places, "label", "vec").mapInArrow(run, schema)


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest inner product of each row of a with any vector between low and high."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return exact_dot(up, low) + exact_dot(down, high), exact_dot(up, high) + exact_dot(down, low)


def _tiles(anchors: DataFrame) -> DataFrame:
    """Per folder, the tile of its anchors: neighbouring folders share one up to ANCHORS_PER_TILE; a folder with more has several."""
    counts = anchors.groupBy("folder").agg(F.count("*").alias("n"))
    # One row a folder.
    before = F.sum("n").over(Window.orderBy("folder").rowsBetween(Window.unboundedPreceding, -1))
    number = F.floor(F.coalesce(before, F.lit(0)) / ANCHORS_PER_TILE)
    crowded = F.col("n") > ANCHORS_PER_TILE
    # Crowded folders count from their own number, which no other tile has.
    first = F.when(crowded, -(F.col("folder") + 1) * FOLDER).otherwise(number)
    return counts.select("folder", first.cast("long").alias("first"), crowded.alias("crowded"))


class Search:
    """The stored blocks, their zone maps and the anchors, and one pass over the blocks that are chosen."""

    def __init__(self, spark, path: str, dims: int):
        self.dims = dims
        layout = "range long, block long, vec_id long, label long, vec array<int>, folder int"
        self.blocks = spark.read.schema(layout).parquet(path)
        zones = stored(zone_maps(self.blocks, dims), "zones")
        picked = self.blocks.where((F.col("vec_id") % ANCHOR_STEP == 0) & (F.col("vec_id") != NO_ID))
        numbered = picked.join(small(stored(_tiles(picked), "tiles"), MANY), "folder").select(
            (F.col("first") + F.when(F.col("crowded"), F.floor(F.col("range") % FOLDER / RANGES_PER_TILE)).otherwise(0)).alias("tile"),
            F.monotonically_increasing_id().alias("anchor"),
            "vec_id",
            "label",
            "vec",
        )
        self.anchors = stored(numbered, "anchors")
        pages = 1 + zones.count() // ZONES_PER_PAGE
        tiles = self.anchors.select("tile").distinct()
        page = F.pmod(F.xxhash64(*BLOCK), F.lit(pages)).alias("page")
        # Every tile meets every page of zone maps once: a query set against all rows, in bounded blocks.
        self.pages_of_tiles = tiles.select("tile", F.explode(F.sequence(*[F.lit(i).cast("long") for i in (0, pages - 1)])).alias("page"))
        self.zones = zones.select("*", page).join(self.pages_of_tiles, "page")

    def choose(self, anchors: DataFrame, rule) -> DataFrame:
        """tile, anchor, block and bound of the blocks that rule(anchors, zones, least, most) says yes to."""
        dims = self.dims

        def run(key, mine: pa.Table, zones: pa.Table) -> pa.Table:
            if not len(mine) or not len(zones):
                return pa.table([pa.array([], pa.int64())] * 6, names=["tile", "anchor", *BLOCK, "bound"])
            least, most = bounds(_matrix(mine, "vec", dims), _matrix(zones, "low", dims), _matrix(zones, "high", dims))
            a, z = np.nonzero(rule(mine, zones, least, most))
            taken = [mine[c].to_numpy()[a] for c in ("tile", "anchor")] + [zones[c].to_numpy()[z] for c in BLOCK]
            return pa.table([*map(pa.array, taken), pa.array(most[a, z])], names=["tile", "anchor", *BLOCK, "bound"])

        left = _apart(anchors.join(self.pages_of_tiles, "tile")).groupBy("tile", "page")
        picked = left.cogroup(_apart(self.zones).groupBy("tile", "page")).applyInArrow(
            run, "tile long, anchor long, folder long, range long, block long, bound long"
        )
        # A block that several tasks read has several zone maps.
        return picked.groupBy("tile", "anchor", *BLOCK).agg(F.max("bound").alias("bound"))

    def scored(self, anchors: DataFrame, wanted: DataFrame, pick, k: int) -> DataFrame:
        """anchor, slot, vec_id and score: the k best candidates of every slot in the wanted blocks.

        pick(anchors, labels, ids, scores) gives (slot, mask) pairs: which candidates count for which slot.
        """
        dims = self.dims
        need = small(stored(wanted.select("tile", *BLOCK).distinct(), "needed"), MANY)
        units = self.blocks.join(need, BLOCK)
        per_range = wanted.groupBy("tile", "anchor", "range").agg(F.collect_set("block").alias("blocks"))
        work = per_range.join(anchors.drop("tile"), "anchor")

        def run(key, mine: pa.Table, rows: pa.Table) -> pa.Table:
            out = [[np.zeros(0, np.int64)] for _ in range(4)]
            if len(mine) and len(rows):
                rows = rows.sort_by("vec_id")
                ids, labels, block = (rows[c].to_numpy() for c in ("vec_id", "label", "block"))
                x, a, number = _matrix(rows, "vec", dims), _matrix(mine, "vec", dims), mine["anchor"].to_numpy()
                lists_ = mine["blocks"].combine_chunks()
                owner = np.repeat(np.arange(len(mine)), np.diff(lists_.offsets.to_numpy()))
                asked = lists_.flatten().to_numpy()
                for b in np.unique(asked):
                    who, here = owner[asked == b], np.flatnonzero(block == b)
                    score = exact_dot(a[who], x[here])
                    for slot, mask in pick(mine.take(pa.array(who)), labels[here], ids[here], score):
                        # Ids ascend, so a stable sort leaves the smaller one first.
                        ranked = np.where(mask, -score, NO_ID)
                        best = np.argsort(ranked, axis=1, kind="stable")[:, :k]
                        at, col = np.nonzero(np.take_along_axis(mask, best, 1))
                        chosen = best[at, col]
                        for to, column in zip(out, (number[who[at]], np.full(len(at), slot), ids[here[chosen]], score[at, chosen]), strict=True):
                            to.append(column)
            return pa.table([pa.array(np.concatenate(o)) for o in out], names=["anchor", "slot", "vec_id", "score"])

        found = _apart(work).groupBy("tile", "range").cogroup(_apart(units).groupBy("tile", "range")).applyInArrow(
            run, "anchor long, slot long, vec_id long, score long"
        )
        return best(found, k)


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and slot with their rank, smaller ids first among equal scores."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def positives(search: Search) -> DataFrame:
    """anchor, vec_id, score and rank of the best rows of each anchor's label, itself left out."""

    def same(mine: pa.Table, labels: np.ndarray, ids: np.ndarray, score: np.ndarray):
        own, number = mine["label"].to_numpy()[:, None], mine["vec_id"].to_numpy()[:, None]
        return [(0, (labels == own) & (ids != number))]

    def has_label(mine: pa.Table, zones: pa.Table) -> np.ndarray:
        own = mine["label"].to_numpy()[:, None]
        return (zones["label_low"].to_numpy() <= own) & (own <= zones["label_high"].to_numpy())

    def top(mine: pa.Table, zones: pa.Table, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        ranked = np.where(has_label(mine, zones), -most, NO_ID)
        chosen = np.zeros(most.shape, bool)
        np.put_along_axis(chosen, np.argsort(ranked, axis=1, kind="stable")[:, :PROBES], True, 1)
        return chosen & (ranked != NO_ID)

    def above(mine: pa.Table, zones: pa.Table, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        floor = mine["least"].to_numpy()[:, None]
        return has_label(mine, zones) & (most >= floor)

    order = Window.partitionBy("anchor").orderBy(F.desc("bound"), *BLOCK)
    first = search.choose(search.anchors, top).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= PROBES)
    first = stored(first.drop("nth"), "probes")
    probed = stored(search.scored(search.anchors, first, same, POSITIVES), "probed")
    # The fifth best so far; no bound while there are fewer.
    known = probed.where(F.col("rank") == POSITIVES).select("anchor", F.col("score").alias("least"))
    waiting = search.anchors.join(known, "anchor", "left").fillna(-NO_ID, ["least"])
    rest = search.choose(waiting, above).join(first.select("anchor", *BLOCK), ["anchor", *BLOCK], "left_anti")
    more = search.scored(search.anchors, stored(rest, "rest"), same, POSITIVES)
    return best(probed.drop("rank").unionByName(more.drop("rank")), POSITIVES)


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, by the rules above."""
    spark = vectors.sparkSession
    rows, dims = candidates(vectors)
    path = shared_folder(spark, "blocks")
    write_blocks(rows, dims, path)
    search = Search(spark, path, dims)
    found = stored(positives(search), "positives")
    windows = found.groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("rank", _least("score").alias("low"), F.col("score").alias("high")))).alias("w")
    )
    looking = search.anchors.join(windows, "anchor").select(
        *search.anchors.columns, F.col("w.low").alias("lows"), F.col("w.high").alias("highs")
    )
    looking = stored(looking, "windows")

    def spans(mine: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Slot by slot, the anchors' windows; one that an anchor lacks is empty."""
        columns = [mine[c].to_pylist() for c in ("lows", "highs")]
        for slot in range(POSITIVES):
            low = np.array([x[slot] if slot < len(x) else 1 for x in columns[0]], np.int64)
            high = np.array([x[slot] if slot < len(x) else 0 for x in columns[1]], np.int64)
            yield slot, low[:, None], high[:, None]

    def meets(mine: pa.Table, zones: pa.Table, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        own = mine["label"].to_numpy()[:, None]
        other = (zones["label_low"].to_numpy() != own) | (zones["label_high"].to_numpy() != own)
        met = np.zeros(most.shape, bool)
        for _, low, high in spans(mine):
            met |= (low <= high) & (least <= high) & (low <= most)
        return met & other

    def within(mine: pa.Table, labels: np.ndarray, ids: np.ndarray, score: np.ndarray):
        other = (labels != mine["label"].to_numpy()[:, None]) & (ids != mine["vec_id"].to_numpy()[:, None])
        for slot, low, high in spans(mine):
            yield slot, other & (low <= score) & (score <= high)

    wanted = stored(search.choose(looking, meets), "wanted")
    negatives = search.scored(looking, wanted, within, NEGATIVES)
    pairs = found.select(
        "anchor", (F.col("rank") - 1).cast("long").alias("slot"), F.col("vec_id").alias("positive"), F.col("score").alias("positive_score")
    )
    ids = search.anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    return negatives.join(pairs, ["anchor", "slot"]).join(ids, "anchor").select(
        "anchor_id",
        _id("positive").alias("positive_id"),
        "rank",
        _id("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def _least(positive: str) -> Column:
    """The least whole n with LOW_SHARE * positive <= HIGH_SHARE * n."""
    product = F.col(positive) * LOW_SHARE
    over = F.pmod(product, F.lit(HIGH_SHARE))
    return F.call_function("div", product - over, F.lit(HIGH_SHARE)) + (over > 0).cast("long")


def _id(name: str) -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name))
