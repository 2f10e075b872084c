"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when equal after all blanks are deleted. Rows alone in their normalised length are unique
and are set aside; of the rest, rows alone in length and prefix hash; only what is left has its whole
content hashed and compared. Each step shuffles ids and hashes, not texts, and counts on the map side
first. A group of copies may hold a third of all rows: its rows are dealt over salts, each salt is summed
up, and the summaries, at most one per salt, decide.

Nulls: a null text equals an empty one. A null doc_id sorts after all others and stays only if no other
row of its group is as long. Rows that repeat an id are copies, and stay or go together. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import BLANKS, row_key, small, spread, stored, text_or_empty

PREFIX = 256
SALTS = 64
# Up to so many ids (16 MB) are sent to all executors in place of moving texts to them.
MANY = 1_000_000


def _crowded(keys: DataFrame, *by: str) -> DataFrame:
    """The rows that share these columns with another row."""
    counts = keys.groupBy(*by).agg(F.count("*").alias("rows_")).where("rows_ > 1").drop("rows_")
    return keys.join(counts, list(by), "left_semi")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, and a hash of its id and text. Of a group, the longest original text stays."""
    plain = F.regexp_replace("text", f"{BLANKS}+", "")
    rows = docs.select("doc_id", text_or_empty()).withColumn("plain_", plain)
    order = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    keys = rows.select(
        "doc_id",
        row_key().alias("row"),
        F.struct(F.char_length("text").alias("long"), (-order).alias("early"), F.col("doc_id").alias("id")).alias("rank"),
        F.octet_length("plain_").alias("bytes"),
        F.xxhash64(F.substring("plain_", 1, PREFIX)).alias("prefix"),
    )
    keys = stored(keys, "lengths")
    twice = _crowded(_crowded(keys, "bytes"), "bytes", "prefix")
    suspects = small(stored(twice.select("doc_id").distinct(), "suspects"), MANY)
    # Full content only for what both cheap steps left.
    full = (
        rows.join(suspects, rows["doc_id"].eqNullSafe(suspects["doc_id"]), "left_semi")
        .select(
            "doc_id",
            row_key().alias("row"),
            F.struct(F.char_length("text").alias("long"), (-order).alias("early"), F.col("doc_id").alias("id")).alias("rank"),
            F.octet_length("plain_").alias("bytes"),
            F.xxhash64(F.substring("plain_", 1, PREFIX)).alias("prefix"),
            F.unhex(F.sha2("plain_", 256)).alias("full"),
            spread("doc_id", ways=SALTS).alias("salt"),
        )
    )
    full = stored(full, "full")
    key = ["bytes", "full"]
    parts = full.groupBy(*key, "salt").agg(F.max("rank").alias("best"), F.count("*").alias("n"))
    groups = parts.groupBy(*key).agg(
        F.max("best").alias("best"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts")
    )
    per_salt = groups.select(*key, "best", "group_size", F.explode("salts").alias("salt"))
    met = full.join(per_salt, [*key, "salt"]).select("doc_id", "row", "rank", "best", "group_size")
    alone = keys.join(suspects, keys["doc_id"].eqNullSafe(suspects["doc_id"]), "left_anti").select(
        "doc_id", "row", "rank", F.col("rank").alias("best"), F.lit(1).cast("long").alias("group_size")
    )
    return alone.unionByName(met).select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        F.col("rank").eqNullSafe(F.col("best")).alias("kept"),
        "row",
    )


def with_digest(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The groups with the SHA-256 of each row's normalised text, joined by a hash of the row's id and text."""
    plain = F.regexp_replace(text_or_empty(), f"{BLANKS}+", "")
    digests = docs.select(
        F.col("doc_id").alias("id_"), row_key().alias("row_"), F.sha2(plain, 256).alias("text_sha256")
    ).distinct()
    same = groups["doc_id"].eqNullSafe(digests["id_"]) & (groups["row"] == digests["row_"])
    return groups.join(digests, same).select(*[groups[c] for c in groups.columns], "text_sha256")
