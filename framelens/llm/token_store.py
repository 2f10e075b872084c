"""Token ids in Parquet: one row per document in id order, ids as a list column.

Ids are dictionary-encoded (few distinct ids) or delta-encoded; row groups and pages have set sizes, and
Spark's writer adds column and offset indexes, so a reader of the metadata columns opens no ids and a
reader of a range of documents opens only the pages that hold it.

Nulls: a null text has the end id alone; rows with a null doc_id come first. Rows that repeat an id are
stored next to one another. An empty table gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelens.llm.common import text_or_empty
from framelens.llm.vocab import encoder

STORED = "doc_id long, n_tokens long, ids array<int>"


def with_ids(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens and ids of each text, the end id included, in the order of the rows."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            ids = [x + end for x in encode(batch[1].to_pylist())]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            lists = pa.ListArray.from_arrays(offsets, values)
            yield pa.RecordBatch.from_arrays(
                [batch[0].cast(pa.int64()), pa.array(n), lists], ["doc_id", "n_tokens", "ids"]
            )

    return docs.select("doc_id", text_or_empty()).mapInArrow(run, STORED)


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int = 1,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 1 << 20,
    rows_per_file: int = 100_000,
) -> None:
    """Write the token files. Texts are dealt by id range before they are encoded, so encoded once.

    encoding: "dictionary", or "delta" (DELTA_BINARY_PACKED) for vocabularies too large for one.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding}")
    in_order = docs.select("doc_id", text_or_empty()).repartitionByRange("doc_id").sortWithinPartitions(
        "doc_id", F.xxhash64("text")
    )
    (
        with_ids(in_order, vocabulary, end_id)
        .write.option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.writer.version", "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.dictionary.page.size", page_bytes)
        .option("maxRecordsPerFile", rows_per_file)
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The stored rows; only the named columns are read."""
    stored = spark.read.schema(STORED).parquet(path)
    return stored.select(*columns) if columns else stored


def _placed(stored: DataFrame) -> list:
    """File and row of each stored row; file names sort by part, then by file of the part."""
    name = F.col("_metadata.file_name")
    return [
        F.regexp_extract(name, r"part-(\d+)", 1).cast("long").alias("part"),
        F.regexp_extract(name, r"-c(\d+)\.", 1).cast("long").alias("file"),
        F.col("_metadata.row_index").alias("at"),
    ]


def with_starts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every stored document.

    Sums are taken per file from the n_tokens column alone, then over the files (one row each), then over
    the rows within a file, whose number write_tokens bounds.
    """
    stored = read_tokens(spark, path)
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = (
        stored.select("n_tokens", *_placed(stored))
        .groupBy("part", "file")
        .agg(F.sum("n_tokens").alias("tokens"))
        .select("part", "file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first"))
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            values = lists.values.to_numpy().astype("<u4", copy=False)
            ends = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            out = [*(batch[c] for c in ("doc_id", "n_tokens", "part", "file", "at")), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "part", "file", "at", "ids_crc32"])

    sums = stored.select("doc_id", "n_tokens", *_placed(stored), "ids").mapInArrow(
        check, "doc_id long, n_tokens long, part long, file long, at long, ids_crc32 long"
    )
    earlier = Window.partitionBy("part", "file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sums.withColumn("within", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
        .join(files, ["part", "file"])
        .select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
    )
