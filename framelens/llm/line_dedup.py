"""Removal of repeated and nearly repeated lines by a segment-partition edit join.

Two lines are linked if their edit distance, in code points, is at most TAU. A line is cut into TAU + 1
segments; a line within TAU edits contains at least one of them unchanged, near the same place. So every
line is entered in an index under each of its segments, with its length, and looks up the substrings that
the segments of lines of its own or a smaller length could be. What meets there is filtered by signatures
that lose no link (an edit flips at most two of 64 parity bits of the characters and four of those of
neighbouring characters) and confirmed by a bit-parallel edit distance on a band of 2 TAU + 1 diagonals.

An occurrence of a line stays if it is the first of its text, in the order of doc_id, document and line
number, and no linked text has an earlier first occurrence. Lines under LEAST_CHARS code points are always kept.

Only DataFrame functions are used. A line in a third of all documents is one entry: occurrences are
summed on the map side, for index keys as for texts, before any shuffle. Index entries carry hashes, not
texts; texts are fetched for lines that share an entry with another line. Keys are made once and stored, first
without the length, where several of a line's look-ups are one; lengths are put back for keys that are shared.

Nulls: a null text has no lines and stays null. A document is a doc_id with a text: rows with a null id, or
with one id, are documents of their own if their texts differ, in the order of a hash (null ids after all
others), and one document, given several times, if they don't. An empty table gives no rows. Columns but
doc_id, text and n_chars are passed on as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import free_prefix, row_key, small, stored

TAU = 2
PARTS = TAU + 1
LEAST_CHARS = 20
# Up to so many hashes (16 MB) are sent to all executors in place of moving the entries of all lines.
MANY = 1_000_000
NO_ID = (1 << 63) - 1
TEXT = ["h1", "h2"]
DOC = ["id", "row"]


def _doc() -> list[Column]:
    """The columns DOC, never null."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), row_key().alias("row")]


def all_lines(docs: DataFrame) -> DataFrame:
    """Document, line number, length, text and two independent hashes of every line long enough to compare."""
    return (
        # In two steps, so that a document is hashed once and not once a line.
        docs.select(*_doc(), F.split("text", "\n", -1).alias("lines"))
        .select(*DOC, F.posexplode("lines").alias("at", "line"))
        .where(F.char_length("line") >= LEAST_CHARS)
        .select(
            *DOC,
            "at",
            F.char_length("line").alias("size"),
            "line",
            F.xxhash64("line").alias("h1"),
            F.xxhash64(F.lit(1), F.col("line")).alias("h2"),
        )
    )


def _segment(length: int, i: int) -> tuple[int, int]:
    """Start (from 0) and length of segment i of a line of that length; the last ones are the longer."""
    base, extra = divmod(length, PARTS)
    return i * base + max(0, i - (PARTS - extra)), base + (i >= PARTS - extra)


def _places() -> list[list[dict[tuple[int, int], list[int]]]]:
    """Per segment and remainder of a line's length by PARTS: where in the line the segment can stand, its own place first.

    A segment i of a line shorter by `less` can start up to i places to either side, and up to TAU - i
    places to either side of where it would be if counted from the end. Start and length are given less
    those of a line cut evenly, with every `less` that leads there: 7 or 8 places for 12 look-ups.
    """
    base, found = 2 * PARTS, []
    for i in range(PARTS):
        found.append([])
        for extra in range(PARTS):
            at: dict[tuple[int, int], list[int]] = {}
            size = base * PARTS + extra
            start, length = _segment(size, i)
            at[start - i * base, length - base] = []
            for less in range(TAU + 1):
                start, length = _segment(size - less, i)
                for move in range(max(-i, less - (TAU - i)), min(i, less + TAU - i) + 1):
                    at.setdefault((start + move - i * base, length - base), []).append(less)
            found[-1].append(at)
    return found


# (segment, per remainder ((start, length), every less), or None where that remainder has fewer places).
PLACES = [
    (i, [list(at.items())[n] if n < len(at) else None for at in found])
    for i, found in enumerate(_places())
    for n in range(max(map(len, found)))
]
OWN = [n for n, (i, _) in enumerate(PLACES) if n == 0 or PLACES[n - 1][0] < i]
KEYS = [f"key_{n}" for n in range(len(PLACES))]


def with_keys(lines: DataFrame) -> DataFrame:
    """The lines without their text, with a key for every place; null for places that their length has not.

    Keys leave the length out, so that look-ups for lines of several lengths are one; `sized` puts it back.
    """
    base, extra = F.floor(F.col("size") / PARTS).cast("int"), F.col("size") % PARTS

    def pick(values: list[int]) -> Column:
        out = F.lit(values[-1])
        for n in reversed(range(PARTS - 1)):
            out = F.when(extra == n, values[n]).otherwise(out) if len({*values[n:]}) > 1 else F.lit(values[n])
        return out

    # A window for every segment first: finding a place in it is a shorter way than from the line's start.
    windows, keys = [], []
    for i in range(PARTS):
        spans = [at for j, per in PLACES if j == i for at, _ in filter(None, per)]
        low, high = min(s for s, _ in spans), max(s + n for s, n in spans)
        windows.append(F.substring(F.col("line"), i * base + (low + 1), base + (high - low)).alias(f"window_{i}"))
        for j, per in PLACES:
            if j == i:
                has = [n for n, one in enumerate(per) if one]
                starts, lengths = ([(one or per[has[0]])[0][k] for one in per] for k in (0, 1))
                part = F.substring(F.col(f"window_{i}"), pick([s - low + 1 for s in starts]), base + pick(lengths))
                key = F.xxhash64(F.lit(i), part)
                keys.append((F.when(extra.isin(has), key) if len(has) < PARTS else key).alias(KEYS[len(keys)]))
    return lines.select("*", *windows).select(*[c for c in lines.columns if c != "line"], *keys)


def entries(kept: DataFrame) -> DataFrame:
    """(key, h1, size, place, enters) for every line and place."""
    rows = kept.select("h1", "size", F.posexplode(F.array(*KEYS)).alias("place", "key")).where("key is not null")
    return rows.select("key", "h1", "size", "place", F.col("place").isin(OWN).alias("enters"))


def sized(rows: DataFrame) -> DataFrame:
    """(key, h1, enters) of entries, their keys with the length of the line that is entered or looked for."""
    table = F.array(*[F.array(*[F.array(*map(F.lit, one[1] if one else [])).cast("array<int>") for one in per]) for _, per in PLACES])
    ways = F.get(F.get(table, F.col("place")), F.col("size") % PARTS)
    less = rows.select("*", F.explode(ways).alias("less"))
    return less.select(
        F.xxhash64("key", F.col("size") - F.col("less")).alias("key"), "h1", (F.col("enters") & (F.col("less") == 0)).alias("enters")
    )


def shared_keys(rows: DataFrame) -> DataFrame:
    """Keys under which one text is entered and another one looks; combined on the map side."""
    return (
        rows.groupBy("key")
        .agg(F.min("h1").alias("x"), F.max("h1").alias("y"), F.max("enters").alias("some"))
        .where("x != y and some")
        .select("key")
    )


def signatures(line: Column) -> Column:
    """Two 64-bit words: bit b is the parity of the number of codes, or of neighbours' codes, that are b modulo 64."""

    def parity(codes: Column) -> Column:
        # A shift of 64 bits is modulo 64 itself.
        return F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), c)))

    def words(codes: Column) -> Column:
        pairs = F.zip_with(codes, F.slice(codes, F.lit(2), F.size(codes)), lambda a, b: a * 31 + b)
        return F.struct(
            parity(codes).alias("s1"), parity(F.slice(pairs, F.lit(1), F.greatest(F.size(codes) - 1, F.lit(0)))).alias("s2")
        )

    # Kept in a one-element array and taken up again, so that the line is split once.
    return F.element_at(F.transform(F.array(F.transform(F.split(line, ""), F.ascii)), words), 1)


def banded_distance(long: Column, short: Column) -> Column:
    """Edit distance of two arrays of characters, exact up to TAU; greater if it is greater.

    Column by column of the shorter one, bits hold the vertical differences of 2 TAU + 1 rows around the
    diagonal, the window moving down with it. The distance is followed along the diagonal that ends in the
    last cell, where a step costs nothing if its bit in `zero` is set. `long` must not be the shorter.
    """
    width, mask = 2 * TAU + 1, (1 << (2 * TAU + 1)) - 1
    shift = F.size(long) - F.size(short)

    def step(a: Column, j: Column) -> Column:
        c = F.get(short, j)
        same = F.lit(0)
        for i in range(width):
            same = same + F.when(F.get(long, j + (i - TAU)) == c, 1 << i).otherwise(0)
        # Kept in a one-element array and taken up again, so that each is worked out once.
        return F.element_at(
            F.transform(
                F.transform(
                    F.array(F.struct(same.alias("x"), a["up"].alias("up"), a["down"].alias("down"))),
                    lambda s: F.struct(
                        ((s["x"].bitwiseAND(s["up"]) + s["up"]).bitwiseXOR(s["up"])).bitwiseOR(s["x"]).bitwiseOR(s["down"]).bitwiseAND(F.lit(mask)).alias("zero"),
                        s["up"].alias("up"),
                        s["down"].alias("down"),
                    ),
                ),
                lambda s: F.struct(
                    s["zero"].bitwiseAND(s["up"])
                    .bitwiseOR(F.bitwise_not(F.shiftright(s["zero"], 1).bitwiseOR(_plus(s))))
                    .bitwiseAND(F.lit(mask))
                    .alias("up"),
                    F.shiftright(s["zero"], 1).bitwiseAND(_plus(s)).bitwiseAND(F.lit(mask)).alias("down"),
                    (a["cost"] + 1 - F.call_function("shiftright", s["zero"], shift + TAU).bitwiseAND(F.lit(1))).alias("cost"),
                ),
            ),
            1,
        )

    start = F.struct(
        F.lit(mask & (mask << TAU)).alias("up"), F.lit(0).alias("down"), shift.alias("cost")
    )
    columns = F.when(F.size(short) > 0, F.sequence(F.lit(0), F.size(short) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(columns, start, step, lambda a: a["cost"])


def _plus(s: Column) -> Column:
    """Rows whose value grows from the last column to this one."""
    return s["down"].bitwiseOR(F.bitwise_not(s["zero"].bitwiseOR(s["up"])))


def links(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """(a1, a2, b1, b2): hashes of every two different line texts within TAU edits, both ways.

    kept: the lines as with_keys gives them, stored.
    """
    rows = entries(kept)
    shared = stored(shared_keys(rows), "keys")
    # First without lengths, for all lines, then with them, for the few that are left.
    met = stored(sized(rows.join(small(shared, MANY), "key").distinct()), "met")
    shared = stored(shared_keys(met), "keys")
    met = stored(met.join(small(shared, MANY), "key").groupBy("key", "h1").agg(F.max("enters").alias("enters")), "met")
    wanted = small(stored(met.select("h1").distinct(), "wanted"), MANY)
    texts = lines.join(wanted, "h1").groupBy(*TEXT).agg(F.min("line").alias("line"))
    signed = texts.select(*TEXT, "line", F.char_length("line").alias("size"), signatures(F.col("line")).alias("signed"))
    texts = stored(signed.select(*TEXT, "line", "size", "signed.s1", "signed.s2"), "texts")
    placed = met.join(texts.drop("line"), "h1")
    a = placed.where("enters").select("key", *[F.col(c).alias(f"a_{c}") for c in (*TEXT, "size", "s1", "s2")])
    b = placed.select("key", *[F.col(c).alias(f"b_{c}") for c in (*TEXT, "size", "s1", "s2")])
    fits = (
        (a["key"] == b["key"])
        & ((F.col("a_h1") != F.col("b_h1")) | (F.col("a_h2") != F.col("b_h2")))
        & (F.col("b_size") - F.col("a_size")).between(0, TAU)
        & (F.bit_count(F.col("a_s1").bitwiseXOR(F.col("b_s1"))) <= 2 * TAU)
        & (F.bit_count(F.col("a_s2").bitwiseXOR(F.col("b_s2"))) <= 4 * TAU)
    )
    pairs = a.join(b, fits).select("a_h1", "a_h2", "b_h1", "b_h2").distinct()
    for side in ("a", "b"):
        own = texts.select(*[F.col(c).alias(f"{side}_{c}") for c in TEXT], F.col("line").alias(f"{side}_line"))
        pairs = pairs.join(own, [f"{side}_{c}" for c in TEXT])
    # Few bytes but long work: dealt to all tasks. The entered line is not the longer of the two.
    ways = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = F.struct(F.split("b_line", "").alias("long"), F.split("a_line", "").alias("short"))
    # Split once, before the steps along the line.
    distance = F.element_at(F.transform(F.array(both), lambda s: banded_distance(s["long"], s["short"])), 1)
    # As an aggregate, since a filter would be moved below the dealing out.
    keys = [f"{side}_{c}" for side in "ab" for c in TEXT]
    near = pairs.repartition(ways).groupBy(*keys).agg(F.min(distance).alias("distance")).where(F.col("distance") <= TAU)
    one_way = near.select(*[F.col(f"{s}_{c}").alias(f"{s}{c[1]}") for s in "ab" for c in TEXT])
    other = one_way.select(*[F.col(f"{s}{k}").alias(f"{t}{k}") for s, t in ("ab", "ba") for k in "12"])
    return stored(one_way.unionByName(other).distinct(), "links")


def marked_lines(docs: DataFrame) -> DataFrame:
    """id, row, at, size, exact, near and n_links of every compared line that is repeated or linked.

    exact: it is not the first of its text. near: a linked text occurs earlier.
    """
    lines = all_lines(docs)
    # Texts are read and cut into lines and keys once; only the texts of lines that meet others are read again.
    kept = stored(with_keys(lines), "lines")
    texts = kept.groupBy(*TEXT).agg(F.min(F.struct(*DOC, "at")).alias("first"), F.count("*").alias("times"))
    texts = stored(texts.select(*TEXT, "first", "times"), "firsts")
    found = links(lines, kept)
    own = found.join(texts.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("first").alias("mine")), ["a1", "a2"])
    both = own.join(texts.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("first").alias("theirs")), ["b1", "b2"])
    near = both.groupBy(F.col("a1").alias("h1"), F.col("a2").alias("h2")).agg(
        F.count("*").alias("n_links"), F.max(F.col("theirs") < F.col("mine")).alias("near")
    )
    marks = texts.join(near, TEXT, "left").where("times > 1 or n_links is not null")
    return kept.join(marks, TEXT).select(
        *DOC,
        "at",
        "size",
        (F.struct(*DOC, "at") != F.col("first")).alias("exact"),
        F.coalesce("near", F.lit(False)).alias("near"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """Per row of docs: its lines, how many go and why, links of its lines, and which lines go, from 0."""
    per_doc = (
        marked_lines(docs)
        .distinct()
        .groupBy(*DOC)
        .agg(
            F.count_if("exact").alias("n_exact"),
            F.count_if(F.expr("near and not exact")).alias("n_near"),
            F.sum("n_links").alias("n_links"),
            F.sum(F.expr("case when exact or near then size else 0 end")).alias("gone_chars"),
            F.sort_array(F.collect_list(F.expr("case when exact or near then at end"))).alias("dropped_lines"),
        )
    )
    heads = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *_doc(),
        F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n_lines"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"),
    ).withColumn("n_lines", F.greatest("n_lines", F.lit(0)).cast("long"))
    rows = heads.join(per_doc, DOC, "left")
    zero = F.lit(0).cast("long")
    return rows.select(
        "doc_id",
        "n_lines",
        *[F.coalesce(c, zero).alias(c) for c in ("n_exact", "n_near", "n_links")],
        # Code points of the lines that stay, without line ends.
        (F.col("n_chars") - F.greatest(F.col("n_lines") - 1, zero) - F.coalesce("gone_chars", zero)).alias("kept_chars"),
        F.coalesce("dropped_lines", F.array().cast("array<int>")).alias("dropped_lines"),
    )


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents without the lines that go, all columns kept, n_chars counted anew where text changes.

    Documents that lose all their words this way are left out.
    """
    own = free_prefix(docs.columns, "line_dedup_")
    gone, text = own + "gone", own + "text"
    drop = (
        marked_lines(docs)
        .where("exact or near")
        .groupBy(*[F.col(c).alias(own + c) for c in DOC])
        .agg(F.collect_set("at").alias(gone))
    )
    rows = docs.join(drop, [mine == F.col(own + c) for mine, c in zip(_doc(), DOC, strict=True)], "left")
    lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    shorter = F.when(
        F.col(gone).isNotNull() & F.col("text").isNotNull(),
        F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"),
    ).otherwise(F.col("text"))
    changed = rows.withColumn(text, shorter).where(
        F.col(gone).isNull() | F.col(text).isNull() | F.col(text).rlike(r"[^\x20\x09-\x0D]")
    )
    length = F.when(F.col(gone).isNull(), docs["n_chars"]).otherwise(F.char_length(text).cast("long")) if "n_chars" in docs.columns else None
    return changed.select(
        *[F.col(text).alias("text") if c == "text" else length.alias(c) if c == "n_chars" else docs[c] for c in docs.columns]
    )
