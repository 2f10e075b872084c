"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, links confirmed on full sets.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Documents with equal sets are
one from the start, so copies are never paired. A signature has SYMBOLS MinHash values of 16 bits each,
cut into CHUNKS chunks. Two signatures that differ in at most RADIUS places differ in at most
ERRORS = RADIUS // CHUNKS = 1 places of some chunk (pigeonhole), so enumerating the chunk with each one
of its places left out finds every such pair. At similarity 0.75 a signature differs in 16 places on
average; more than RADIUS happens about once in 10^5 pairs that have no other link.

Only components are asked for, so pairs known to be in one component are not compared:
1. every document is confirmed against the hub of its most shared buckets, which is the member that meets
   most others in all its buckets;
2. within a bucket only signatures of different components so far are compared, in blocks of bounded size;
   each document is confirmed against the nearest one of another component, a single one each;
3. what is still of different components, each pair in the first bucket it shares, is confirmed too.
Steps 2 and 3 compare documents that share a bucket without being linked, often the variants of one text.
Their signatures are lengthened by MORE one-byte symbols first: sets of unlike sizes, and pairs that differ
in over FAR of all SYMBOLS + MORE places (a link does about once in 10^5), go no further.
Full sets meet in tiles of bounded size: a document travels once to each tile pair that needs it, and a
tile emits the links of a forest, not all links.

Nulls: texts that are null or without words have an empty set and no links. A document is a doc_id with a
text and goes by a hash of the two until the answer is given: rows with a null id, or with one id, are
documents of their own if their texts differ (null ids after all others, else in the order of that hash),
and get the same answer if they don't. A component of null ids only has a null component_id, but one row
of it is kept. In the report every row whose doc_id names the component is kept; the stage that leaves
copies out keeps one document of each component. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm.common import free_prefix, row_key, small, stored, text_or_empty
from framelens.llm.components import components

SHINGLE = 5
SIMILAR = (75, 100)
SYMBOLS, CHUNKS, RADIUS = 64, 16, 31
PER_CHUNK, ERRORS = SYMBOLS // CHUNKS, RADIUS // CHUNKS
# One-byte symbols added for documents that share buckets, and the distance beyond which pairs are no links.
MORE, FAR = 192, 94
# Documents of a tile, whose full sets are held at once, and rows of a block of a bucket.
BLOCK, BUCKET_BLOCK = 1024, 4096
# Names of documents that a task remembers having sent for; beyond it some are sent for again.
NAMED = 1_000_000
# Up to so many ids (16 MB) are sent to all executors in place of moving all texts.
MANY = 1_000_000
NO_ID = (1 << 63) - 1

_FACTORS = np.array([int(xxhash.xxh64_intdigest(b"f%d" % i)) | 1 for i in range(SYMBOLS + MORE)], np.uint64)
_OFFSETS = np.array([int(xxhash.xxh64_intdigest(b"o%d" % i)) for i in range(SYMBOLS + MORE)], np.uint64)
_PLACES = np.array([int(xxhash.xxh64_intdigest(b"p%d" % i)) | 1 for i in range(SHINGLE)], np.uint64)


def shingles(text: str) -> np.ndarray:
    """The sorted hashes of the distinct shingles. Lower-casing bytes changes A-Z only."""
    hashed = xxhash.xxh3_64_intdigest
    words = np.array([hashed(w) for w in text.encode("utf-8", "surrogatepass").lower().split()], np.uint64)
    if not len(words):
        return words
    width = min(SHINGLE, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out += words[k : len(words) - width + 1 + k] * _PLACES[k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def _least_hashes(hashes: np.ndarray, first: int, last: int) -> np.ndarray:
    """For each of these hash functions the mixed least hash of the set."""
    least = np.full(last - first, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):  # bounds the memory of long texts
        some = hashes[at : at + 2048, None] * _FACTORS[first:last] + _OFFSETS[first:last]
        np.minimum(least, some.min(axis=0), out=least)
    return least * np.uint64(0xD6E8FEB86659FD93)


def signature(hashes: np.ndarray) -> bytes:
    return (_least_hashes(hashes, 0, SYMBOLS) >> np.uint64(48)).astype("<u2").tobytes()


def more_symbols(hashes: np.ndarray) -> bytes:
    return (_least_hashes(hashes, SYMBOLS, SYMBOLS + MORE) >> np.uint64(56)).astype("u1").tobytes()


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame) -> DataFrame:
    """id, doc_id, set size, digest of the set and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, marks = [], [], []
            for text in batch["text"]:
                found = shingles(text.as_py())
                n.append(len(found))
                keys.append(digest(found) if n[-1] else None)
                marks.append(signature(found) if n[-1] else None)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["doc_id"], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary())],
                ["id", "doc_id", "n_shingles", "set_key", "signature"],
            )

    return _with_id(docs).mapInArrow(run, "id long, doc_id long, n_shingles long, set_key binary, signature binary")


def _with_id(docs: DataFrame) -> DataFrame:
    """The documents under `id`, the hash by which they go."""
    return docs.select(row_key().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())


def _rank() -> Column:
    """What the least document of several has the least of."""
    return F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("order"), "id", "doc_id")


def chunk_keys(reps: DataFrame) -> DataFrame:
    """(key, id): each chunk with each one of its symbols left out, the place written into the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.frombuffer(b"".join(batch["signature"].to_pylist()), "<u2").reshape(-1, CHUNKS, PER_CHUNK)
            keys = np.empty((len(marks), CHUNKS, PER_CHUNK), np.int64)
            for out in range(PER_CHUNK):
                key = np.arange(CHUNKS, dtype=np.int64)[None, :] * PER_CHUNK + out
                for k in range(PER_CHUNK):
                    if k != out:
                        key = (key << 16) | marks[:, :, k]
                keys[:, :, out] = key
            ids = np.repeat(batch["id"].to_numpy(), CHUNKS * PER_CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "id"])

    return reps.select("id", "signature").mapInArrow(run, "key long, id long")


def _tile(center: str, member: str, size: str) -> list:
    """A tile: a star's centre and a block of its members, about BLOCK of them."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    return [F.col(center).alias("star"), F.pmod(F.xxhash64(member), blocks).cast("int").alias("block")]


TILES = "star_a long, block_a int, star_b long, block_b int"
TILE = [c.split()[0] for c in TILES.split(", ")]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows with equal keys, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(len(batch) - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def longer(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and further symbols of the documents named by a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [more_symbols(shingles(text.as_py())) for text in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(marks, pa.binary())], ["id", "more"])

    texts = _with_id(docs).join(small(ids, MANY), "id").select("id", "text")
    return texts.mapInArrow(run, "id long, more binary").groupBy("id").agg(F.min("more").alias("more"))


def _blocks(members: DataFrame, *columns: str) -> DataFrame:
    """Members of a bucket, dealt to all pairs (lo, hi) of its blocks of about BUCKET_BLOCK rows."""
    many = Window.partitionBy("key")
    blocks = F.ceil(F.count("*").over(many) / BUCKET_BLOCK).cast("int")
    dealt = members.withColumn("parts", blocks).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    return (
        dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", *columns)
        .repartition("key", "lo", "hi")
        .sortWithinPartitions("key", "lo", "hi", "id")
    )


def _near(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per row of a block pair: the row, later rows of other labels that may be links, their wrong symbols
    and distances."""
    marks = np.frombuffer(b"".join(table["signature"].to_pylist()), "<u2").reshape(-1, SYMBOLS)
    more = np.frombuffer(b"".join(table["more"].to_pylist()), "u1").reshape(-1, MORE)
    labels, sizes, part = (table[c].to_numpy() for c in ("label", "n_shingles", "part"))
    across = table["lo"][0].as_py() != table["hi"][0].as_py()
    percent, whole = SIMILAR
    for i in range(len(marks) - 1):
        fit = labels[i + 1 :] != labels[i]
        if across:
            fit &= part[i + 1 :] != part[i]
        fit &= whole * np.minimum(sizes[i + 1 :], sizes[i]) >= percent * np.maximum(sizes[i + 1 :], sizes[i])
        others = np.flatnonzero(fit) + i + 1
        if not len(others):
            continue
        wrong = marks[others] != marks[i]
        far = wrong.sum(axis=1)
        near = far <= RADIUS
        others, wrong, far = others[near], wrong[near], far[near]
        far += (more[others] != more[i]).sum(axis=1)
        near = far <= FAR
        if near.any():
            yield i, others[near], wrong[near], far[near]


LEFT = ("id", "label", "n_shingles", "signature", "more")


def nearest(members: DataFrame) -> DataFrame:
    """(id, center): for each document the nearest candidate of another label in any of its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["key", "lo", "hi"]):
            ids = table["id"].to_numpy()
            least, which = np.full(len(ids), SYMBOLS + MORE + 1), np.zeros(len(ids), np.int64)
            for i, others, _, far in _near(table):
                at = np.argmin(far)
                if far[at] < least[i]:
                    least[i], which[i] = far[at], others[at]
                closer = far < least[others]
                least[others[closer]], which[others[closer]] = far[closer], i
            have = np.flatnonzero(least <= FAR)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[have]), pa.array(least[have]), pa.array(ids[which[have]])], ["id", "far", "center"]
            )

    found = _blocks(members, *LEFT).mapInArrow(run, "id long, far long, center long")
    return found.groupBy("id").agg(F.min(F.struct("far", "center")).alias("least")).select("id", "least.center")


def near_pairs(members: DataFrame) -> DataFrame:
    """Candidates of different labels, each in the first bucket that the two share.

    members: key, id, label, n_shingles, star, block, signature, more. One row per document and tile pair:
    the tile pair, the document, its partners, nearest first, and `fresh`, those of them that the task has
    not named for this tile pair before, so that a document is sent for once and not once a pair or bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        named: dict[tuple, set[int]] = {}
        n_named = 0
        for table in _runs(batches, ["key", "lo", "hi"]):
            if n_named > NAMED:
                named, n_named = {}, 0
            ids, star, block = (table[c].to_numpy() for c in ("id", "star", "block"))
            place = int(table["key"][0].as_py()) >> 48
            for i, others, wrong, far in _near(table):
                wrong = wrong.reshape(-1, CHUNKS, PER_CHUNK)
                errors = wrong.sum(axis=2)
                first = np.argmax(errors <= ERRORS, axis=1)
                at = np.arange(len(others))
                out = np.where(errors[at, first] == 0, 0, np.argmax(wrong[at, first], axis=1))
                here = first * PER_CHUNK + out == place
                others = others[here][np.argsort(far[here], kind="stable")]
                for pair in {(star[j], block[j]) for j in others}:
                    inside = others[(star[others] == pair[0]) & (block[others] == pair[1])]
                    a, b = (star[i], block[i]), pair
                    a, b = min(a, b), max(a, b)
                    known = named.setdefault((*a, *b), set())
                    fresh = {int(ids[i]), *ids[inside].tolist()} - known
                    known |= fresh
                    n_named += len(fresh)
                    rows.append(
                        dict(zip(TILE, (*a, *b), strict=True))
                        | {"id": ids[i], "partners": ids[inside].tolist(), "fresh": list(fresh)}
                    )
            if len(rows) > 2000:
                yield pa.RecordBatch.from_pylist(rows, PAIR_SCHEMA)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, PAIR_SCHEMA)

    return _blocks(members, *LEFT, "star", "block").mapInArrow(
        run, f"{TILES}, id long, partners array<long>, fresh array<long>"
    )


PAIR_SCHEMA = pa.schema(
    [
        ("star_a", pa.int64()),
        ("block_a", pa.int32()),
        ("star_b", pa.int64()),
        ("block_b", pa.int32()),
        ("id", pa.int64()),
        ("partners", pa.list_(pa.int64())),
        ("fresh", pa.list_(pa.int64())),
    ]
)


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges (a, b) of a forest of the pairs whose full sets are similar enough, per tile pair."""
    need = stored(pairs.select(*TILE, F.explode("fresh").alias("id")).distinct(), "need")
    texts = _with_id(docs).join(small(need, MANY), "id").select(*TILE, F.lit(0).alias("kind"), "id", "text", F.lit(None).cast("array<long>").alias("partners"))
    lists = pairs.select(*TILE, F.lit(1).alias("kind"), "id", F.lit(None).cast("string").alias("text"), "partners")
    percent, whole = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, sets, root, marks = None, {}, {}, {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for row in batch.to_pylist():
                own = tuple(row[c] for c in TILE)
                if own != tile:
                    tile, sets, root, marks = own, {}, {}, {}
                x = row["id"]
                if row["kind"] == 0:
                    found = shingles(row["text"])
                    if len(found):
                        mark = digest(found)
                        if x not in marks or mark < marks[x]:
                            marks[x], sets[x] = mark, frozenset(found.tolist())
                    continue
                for y in row["partners"]:
                    p, q = top(x), top(y)
                    if p == q or x not in sets or y not in sets:
                        continue
                    one, two = sets[x], sets[y]
                    if whole * min(len(one), len(two)) < percent * max(len(one), len(two)):
                        continue
                    both = len(one & two)
                    if whole * both >= percent * (len(one) + len(two) - both):
                        root[max(p, q)] = min(p, q)
                        a.append(max(x, y))
                        b.append(min(x, y))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return (
        texts.unionByName(lists)
        .repartition(*TILE)
        .sortWithinPartitions(*TILE, "kind", "id")
        .mapInArrow(run, "a long, b long")
    )


def _stars(edges: DataFrame) -> DataFrame:
    """Edges (id, center) with the tile each is confirmed in."""
    sizes = edges.groupBy("center").agg(F.count("*").alias("size"))
    return edges.join(sizes, "center").select("id", "center", *_tile("center", "id", "size"))


def _confirmed_stars(docs: DataFrame, stars: DataFrame) -> DataFrame:
    tiles = [F.col("star").alias("star_a"), F.col("block").alias("block_a"), F.col("star").alias("star_b"), F.col("block").alias("block_b")]
    return confirmed(docs, stars.select(*tiles, "id", F.array("center").alias("partners"), F.array("id", "center").alias("fresh")))


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members under their labels so far, of those buckets alone that hold more than one."""
    marked = members.join(labels, F.col("id") == F.col("node"), "left").withColumn("label", F.coalesce("label", "id")).drop("node")
    mixed = marked.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("key")
    return marked.join(mixed, "key", "left_semi")


def _judged(docs: DataFrame) -> DataFrame:
    """id, doc_id, n_shingles, component_id and kept of every row."""
    rows = stored(signatures(docs), "signatures")
    sets = rows.where("n_shingles > 0").groupBy("set_key").agg(
        F.min(F.struct(_rank().alias("rank"), "signature", "n_shingles")).alias("first")
    )
    reps = stored(
        sets.select("set_key", "first.rank.id", "first.rank.doc_id", "first.signature", "first.n_shingles"), "sets"
    )

    bucket = Window.partitionBy("key")
    members = stored(chunk_keys(reps).withColumn("n", F.count("*").over(bucket)).where("n > 1"), "members")
    # How many others a document meets in its buckets; who meets most is likely to be near most of them.
    met = members.groupBy("id").agg(F.sum("n").alias("met"))
    hubs = members.join(met, "id").groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("least"))).alias("hub"))
    shared = (
        members.join(hubs.select("key", (-F.col("hub.least")).alias("center")), "key")
        .where("id != center")
        .groupBy("id", "center")
        .agg(F.count("*").alias("n"))
    )
    stars = shared.groupBy("id").agg(F.max_by("center", F.struct("n", -F.col("center"))).alias("center"))
    stars = stored(_stars(stars), "stars")
    links = stored(_confirmed_stars(docs, stars), "links")

    # What is left: buckets that hold more than one component so far.
    left = stored(_apart(members.select("key", "id"), components(links)), "left")
    ids = stored(left.select("id").distinct(), "ids")
    known = reps.select("id", "signature", "n_shingles").join(longer(docs, ids), "id")
    known = known.join(stars.select("id", "star", "block"), "id", "left")
    known = known.withColumn("star", F.coalesce("star", "id")).withColumn("block", F.coalesce("block", F.lit(0)))
    left = stored(left.join(known, "id"), "left")
    near = stored(_stars(nearest(left)), "nearest")
    links = stored(links.unionByName(_confirmed_stars(docs, near)), "links")
    left = _apart(left.drop("label"), components(links))
    more = confirmed(docs, stored(near_pairs(left), "pairs"))
    final = components(links.unionByName(more))

    # The least document of each component, by which it is named.
    final = final.unionByName(final.select(F.col("label").alias("node"), "label").distinct())
    ranked = final.join(reps.select(F.col("id").alias("node"), _rank().alias("rank")), "node")
    least = ranked.groupBy("label").agg(F.min("rank").alias("least"))
    heads = final.join(least, "label").select("node", "least")
    named = rows.join(reps.select("set_key", F.col("id").alias("rep"), _rank().alias("rank")), "set_key", "left").join(
        heads, F.col("rep") == F.col("node"), "left"
    )
    head = F.coalesce("least", "rank", _rank())
    return named.select("id", "doc_id", "n_shingles", head.alias("head")).select(
        "id",
        "doc_id",
        "n_shingles",
        F.col("head.doc_id").alias("component_id"),
        (F.col("id") == F.col("head.id")).alias("kept"),
    )


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    named = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("kept"))
    return _judged(docs).withColumn("kept", named).drop("id")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, one of each component: that with the least id."""
    own = free_prefix(docs.columns, "near_dedup_")
    found = _judged(docs).where("not kept")
    gone = found.select(F.col("id").alias(own + "id"), F.col("doc_id").alias(own + "doc")).distinct()
    same = (row_key() == F.col(own + "id")) & F.col("doc_id").cast("long").eqNullSafe(F.col(own + "doc"))
    return docs.join(gone, same, "left_anti")
