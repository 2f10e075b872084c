"""Benchmark decontamination by a positional inverted index of the training texts.

Texts are cut into words and, segment by segment (a stretch of rows that one task reads), turned into
posting lists: one row per segment and term, holding all places of the term as row * 2^32 + place. Nothing
is shuffled for that. Test items are looked up with their rarest terms first:

1. counts of every test term over all segments;
2. a window of an item is probed with its RAREST rarest terms: their lists, moved back by the terms' offsets
   in the item, are intersected within a segment, and what is left are places where the item could start;
3. those starts are confirmed by intersecting the lists of all terms of the item with the places expected,
   and runs of at least a window's length are the exact phrase matches.

Proximity matches come from step 2 with a tolerance in place of equality.

A term in a third of all words is one list per segment, which bounds it; it is moved only if a window holds
nothing rarer. Windows of one item with the same rarest terms are probed once. The index is kept to the terms
of given items where there are at most MANY_TERMS of them, and holds every term otherwise.

Nulls: a null text has no words; a null doc_id keeps its rows. Rows that repeat an id are documents of their
own. An item with a null id counts as one more item and is listed as an empty string; items equal in id and
words count once. Empty tables: no documents give no rows; no items leave every document clean. Columns but
doc_id, item_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelens.llm.common import small, stored, text_or_empty

WINDOW = 10
RAREST = 3
# A document of over so many bytes is a segment of its own.
SEGMENT_BYTES = 8 << 20
MANY_TERMS = 1_000_000
# Up to so many narrow rows (16 MB) are sent to all executors in place of moving posting lists.
MANY = 500_000
# Letters lowered, and what parts words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STORED = "segment long, term string, n long, places array<long>, row long, doc_id long, n_words long, kind string"


def words_of(text: str) -> Column:
    """The words of a text column in order."""
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(plain, APART, -1), lambda w: w != "")


def _classes() -> np.ndarray:
    """By byte: its lower case if it belongs to words, else 0. Bytes of other than ASCII characters do."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[65:91] = word[128:] = True
    table[~word] = 0
    return table


CLASSES = _classes()


def split_words(texts: pa.StringArray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, and the number of words of each text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    lowered = CLASSES[raw]
    inside = lowered != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < np.minimum(offsets[1:], len(raw))]
    starts[first] |= inside[first]
    at = np.flatnonzero(starts)
    # How many bytes of words lie before each word.
    kept = np.cumsum(inside, dtype=np.int32)
    ends = np.append(kept[at] - 1, kept[-1] if len(kept) else 0).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(lowered[inside])])
    before = np.searchsorted(at, offsets)
    return words, np.diff(before)


def _segments(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        before = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + SEGMENT_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def write_index(docs: DataFrame, path: str, terms: DataFrame | None = None) -> None:
    """Write the index: kind=postings (segment, term, n, places) and kind=documents (segment, row, doc_id, n_words).

    terms, with a column term, limits it to those, if they are few enough to be sent to all tasks.
    """
    kept = None
    if terms is not None and terms.limit(MANY_TERMS + 1).count() <= MANY_TERMS:
        found = terms.select("term").toArrow()["term"].combine_chunks()
        kept = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in _segments(batch):
                words, counts = split_words(some["text"])
                rows = np.arange(len(some), dtype=np.int64)
                firsts = np.cumsum(counts) - counts
                places = (np.repeat(rows << 32, counts)) + np.arange(len(words)) - np.repeat(firsts, counts)
                if kept is not None:
                    known = pc.index_in(words, value_set=kept.value).fill_null(-1).to_numpy(zero_copy_only=False)
                    places, code, names = places[known >= 0], known[known >= 0], kept.value
                else:
                    coded = words.dictionary_encode()
                    code, names = coded.indices.to_numpy(), coded.dictionary
                order = np.argsort(code, kind="stable")
                used, starts, n = np.unique(code[order], return_index=True, return_counts=True)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(starts, len(order)).astype(np.int32)), pa.array(places[order])
                )
                yield _filled(
                    len(used),
                    segment=pa.array(np.full(len(used), number)),
                    term=names.take(pa.array(used)),
                    n=pa.array(n.astype(np.int64)),
                    places=lists,
                    kind=pa.array(["postings"] * len(used), pa.string()),
                )
                yield _filled(
                    len(some),
                    segment=pa.array(np.full(len(some), number)),
                    row=pa.array(rows),
                    doc_id=some["doc_id"],
                    n_words=pa.array(counts.astype(np.int64)),
                    kind=pa.array(["documents"] * len(some), pa.string()),
                )
                number += 1

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    texts.mapInArrow(run, STORED).write.partitionBy("kind").option("compression", "zstd").parquet(path)


KINDS = {
    "segment": pa.int64(),
    "term": pa.string(),
    "n": pa.int64(),
    "places": pa.list_(pa.int64()),
    "row": pa.int64(),
    "doc_id": pa.int64(),
    "n_words": pa.int64(),
    "kind": pa.string(),
}


def _filled(length: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [columns.get(c, pa.nulls(length, kind)) for c, kind in KINDS.items()], list(KINDS)
    )


def postings(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(STORED).parquet(path).where(F.col("kind") == "postings")
    return rows.select("segment", "term", "n", "places")


def documents(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(STORED).parquet(path).where(F.col("kind") == "documents")
    return rows.select("segment", "row", "doc_id", "n_words")


def numbered_items(items: DataFrame) -> DataFrame:
    """item (a number), item_id and words of the items that have words."""
    rows = items.select("item_id", words_of("text").alias("words")).where(F.size("words") > 0).distinct()
    return stored(rows.select(F.monotonically_increasing_id().alias("item"), "item_id", "words"), "items")


def item_terms(items: DataFrame) -> DataFrame:
    return items.select("item", F.posexplode("words").alias("at", "term"))


def probes(items: DataFrame, index: DataFrame) -> DataFrame:
    """item, at (offsets of a window's rarest terms, the rarest first), nth, offset and term; each set of offsets once.

    Windows with a term that no document has are left out.
    """
    terms = item_terms(items)
    counts = index.select("term", "n").join(small(stored(terms.select("term").distinct(), "terms"), MANY), "term")
    counts = stored(counts.groupBy("term").agg(F.sum("n").alias("n")), "term-counts")
    known = terms.join(small(counts, MANY), "term", "left")
    rows = known.groupBy("item").agg(
        F.sort_array(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("all")
    )
    width = F.least(F.size("all"), F.lit(WINDOW))
    windows = rows.select("item", F.explode(F.sequence(F.lit(1), F.size("all") - width + 1)).alias("from"), "all", width.alias("width"))
    places = F.transform(F.slice("all", F.col("from"), F.col("width")), lambda t: F.struct(t["n"].alias("n"), t["at"].alias("at"), t["term"].alias("term")))
    ranked = windows.select("item", F.slice(F.sort_array(places), 1, RAREST).alias("rarest")).where(F.col("rarest")[0]["n"] > 0)
    once = ranked.select("item", "rarest", F.col("rarest.at").alias("probe")).dropDuplicates(["item", "probe"])
    return once.select("item", "probe", F.posexplode("rarest").alias("nth", "t")).select(
        "item", "probe", "nth", F.col("t.at").alias("offset"), F.col("t.term").alias("term")
    )


def _started(probed: DataFrame, index: DataFrame) -> DataFrame:
    """The lists of the probes' terms, moved back to where the item would start."""
    return index.select("segment", "term", "places").join(small(probed, MANY), "term").select(
        "segment", "item", "probe", "nth", F.expr("transform(places, p -> p - offset)").alias("starts")
    )


def candidate_starts(probed: DataFrame, index: DataFrame) -> DataFrame:
    """segment, item and start of every place where the rarest terms of a window stand as in the item."""
    lists = _started(probed, index).groupBy("segment", "item", "probe").agg(
        # The rarest first, so that what is carried on is short.
        F.sort_array(F.collect_list(F.struct(F.size("starts").alias("n"), "nth", "starts"))).alias("lists")
    )
    whole = lists.where(F.size("lists") == F.size("probe"))
    met = F.aggregate(
        F.slice("lists", 2, RAREST), F.col("lists")[0]["starts"], lambda kept, more: F.array_intersect(kept, more["starts"])
    )
    return whole.select("segment", "item", F.explode(met).alias("start")).distinct()


def confirmed_words(starts: DataFrame, items: DataFrame, index: DataFrame) -> DataFrame:
    """segment, item, start and at of every word of an item that stands where it should."""
    expected = starts.join(small(item_terms(items), MANY), "item").withColumn("place", F.col("start") + F.col("at"))
    wanted = expected.groupBy("segment", "term").agg(F.collect_set("place").alias("wanted"))
    there = index.select("segment", "term", "places").join(wanted, ["segment", "term"]).select(
        "segment", "term", F.explode(F.array_intersect("wanted", "places")).alias("place")
    )
    return expected.join(there, ["segment", "term", "place"]).select("segment", "item", "start", "at")


def phrase_matches(items: DataFrame, index: DataFrame) -> DataFrame:
    """segment, row, item, place and length of the runs of item words, a window or more, found in documents."""
    probed = stored(probes(items, index), "probes")
    starts = stored(candidate_starts(probed, index), "starts")
    words = confirmed_words(starts, items, index)
    along = Window.partitionBy("segment", "item", "start").orderBy("at")
    runs = (
        words.withColumn("run", F.col("at") - F.row_number().over(along))
        .groupBy("segment", "item", "start", "run")
        .agg(F.min("at").alias("at"), F.count("*").alias("length"))
        .join(small(items.select("item", F.least(F.size("words"), F.lit(WINDOW)).alias("least")), MANY), "item")
        .where("length >= least")
    )
    place = F.col("start") + F.col("at")
    return runs.select(
        "segment", F.shiftright(place, 32).alias("row"), "item", place.bitwiseAND(F.lit((1 << 32) - 1)).alias("place"), "length"
    )


def proximity_matches(items: DataFrame, index: DataFrame, slop: int) -> DataFrame:
    """segment, row, item, probe and place of windows whose rarest terms lie near each other as in the item.

    place is where the item would start by the window's rarest term (before the document if negative); every
    other of its rarest terms has an occurrence within slop words of where that start puts it.
    """
    probed = stored(probes(items, index), "probes")
    rows = _started(probed, index).select("segment", "item", "probe", "nth", F.explode("starts").alias("start"))
    width = slop + 1
    bucket = F.floor(F.col("start") / width) if slop else F.col("start")
    key = ["segment", "item", "probe", "bucket"]
    heads = rows.where("nth = 0").select(
        "segment", "item", "probe", F.col("start").alias("head"), F.explode(F.array(*[bucket + i for i in (-1, 0, 1)])).alias("bucket")
    )
    others = rows.where("nth > 0").select("segment", "item", "probe", "nth", "start", bucket.alias("bucket"))
    near = heads.join(others, key).where(F.abs(F.col("head") - F.col("start")) <= slop)
    met = near.groupBy("segment", "item", "probe", "head").agg(F.count_distinct("nth").alias("n"))
    alone = rows.where((F.col("nth") == 0) & (F.size("probe") == 1)).select("segment", "item", "probe", F.col("start").alias("head"))
    found = met.where(F.col("n") == F.size("probe") - 1).drop("n").unionByName(alone)
    # A start before the document lies in the half below its row.
    row = F.shiftright(F.col("head") + (1 << 31), 32)
    return found.select("segment", row.alias("row"), "item", "probe", (F.col("head") - row * (1 << 32)).alias("place"))


def contamination(docs: DataFrame, items: DataFrame, path: str) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated. The index stays in path."""
    spark = docs.sparkSession
    items = numbered_items(items)
    write_index(docs, path, item_terms(items).select("term").distinct())
    index = postings(spark, path)
    matches = stored(phrase_matches(items, index), "matches")
    hit = matches.select(
        "segment", "row", F.explode(F.sequence("place", F.col("place") + F.col("length") - 1)).alias("place")
    )
    hits = hit.distinct().groupBy("segment", "row").agg(F.count("*").alias("n_hit"))
    names = matches.select("segment", "row", "item").distinct().join(small(items.select("item", "item_id"), MANY), "item")
    found = names.select("segment", "row", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name")).distinct()
    listed = found.groupBy("segment", "row").agg(F.sort_array(F.collect_list("name")).alias("names"))
    rows = documents(spark, path).join(hits, ["segment", "row"], "left").join(listed, ["segment", "row"], "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    zero = F.lit(0).cast("long")
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
