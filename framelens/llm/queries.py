"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.llm import (
    exact_dedup,
    hard_negatives,
    html_text,
    line_dedup,
    near_dedup,
    packing,
    phrase_index,
    piece_codec,
    quality,
    token_counts,
    token_store,
    vector_codes,
    warc,
)
from framelens.llm.common import read, shared_folder
from framelens.llm.sql import ORACLES

END_ID, CAPACITY, TOKEN_LIMIT = 1, 2048, 1024


def op1_pack_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID, CAPACITY)


def op2_exact_dedup_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = exact_dedup.with_digest(docs, exact_dedup.exact_groups(docs))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "archives")
    warc.archive(read(spark, sf_dir, "pages"), path)
    read_back = warc.resolved(warc.read_archive(spark, path, payloads=False))
    return read_back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_html_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.with_length(html_text.main_text(read(spark, sf_dir, "pages")))


def op5_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read(spark, sf_dir, "documents"))


def op6_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(read(spark, sf_dir, "documents"))


def op7_token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "tokens")
    token_store.write_tokens(
        read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), END_ID
    )
    return token_store.with_starts(spark, path)


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = piece_codec.there_and_back(read(spark, sf_dir, "documents"), model)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids_crc32",
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "index")
    return phrase_index.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), path)


def op12_hilbert_zone_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(read(spark, sf_dir, "embeddings"))


def op13_limb_split_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pack_bin_slack,
        op2_exact_dedup_refined,
        op3_warc_revisits,
        op4_html_text_density,
        op5_line_edit_join,
        op6_minhash_hamming,
        op7_token_lists,
        op8_piece_codec,
        op9_token_counts,
        op10_quality_votes,
        op11_phrase_index,
        op12_hilbert_zone_negatives,
        op13_limb_split_codes,
    )
}
SQL: dict[str, str] = {name: ORACLES[name] for name in QUERIES if name in ORACLES}
