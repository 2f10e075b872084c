"""Product-quantization codes of vectors, with codebooks refined by rounds of exact integer arithmetic.

Components become integers; a vector is cut into PARTS consecutive parts of equal length. The codebook of a
part starts as that part of the first vectors by id. A round assigns every part to its nearest entry and
moves each entry to the floor of its parts' mean; entries without parts stay. Distances come from inner
products by limb-split float64 matrix products (vectors.exact_dot), so ties are true ties and the first
entry wins, whatever the machine and the order of work.

Only the codebooks, PARTS * ENTRIES vector parts at any input size, pass through the driver. A round reads
the vectors once; a task sends one sum per part, entry and place, however many of its rows fall to an entry.

Nulls: rows whose vector is null, empty or holds null or non-finite components take no part, nor do vectors
of another length than the first one's; a null id comes after all others. Equal vectors have equal codes;
rows that repeat an id each have a row. With fewer rows than ENTRIES a codebook has as many entries as
there are rows. An empty table gives no rows. Vectors whose length is no multiple of PARTS are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import small, stored
from framelens.llm.vectors import exact_dot, floors, id_or_last, whole_rows

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
ROWS_AT_ONCE = 4096
# Up to so many label sums (16 MB) are sent to all executors.
MANY_LABELS = 1_000_000


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row, and the squared distance to it."""
    offset = (entries * entries).sum(1) - 2 * exact_dot(rows, entries)
    code = offset.argmin(1)
    return code, offset[np.arange(len(rows)), code] + (rows * rows).sum(1)


def first_codebooks(rows: DataFrame, dims: int) -> np.ndarray:
    """Integers by part, entry and place: the first vectors by id, equal ids in the order of the vectors."""
    first = rows.orderBy(id_or_last("vec_id"), "embedding").limit(ENTRIES).select("embedding").toArrow()
    start = floors(first["embedding"].combine_chunks(), dims, SCALE)
    return start.reshape(len(start), PARTS, dims // PARTS).swapaxes(0, 1)


def _pieces(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), ROWS_AT_ONCE):
            some = batch.slice(at, ROWS_AT_ONCE)
            yield some, floors(some["embedding"], dims, SCALE).reshape(len(some), PARTS, dims // PARTS)


def refined(rows: DataFrame, books: np.ndarray, dims: int) -> np.ndarray:
    """The codebooks after one round."""
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        total, count = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for _, parts in _pieces(batches, dims):
            for p, book in enumerate(books):
                code, _ = nearest(parts[:, p], book)
                order = np.argsort(code, kind="stable")
                found, starts, n = np.unique(code[order], return_index=True, return_counts=True)
                total[p, found] += np.add.reduceat(parts[order, p], starts)
                count[p, found] += n
        part, entry = np.nonzero(count)
        width = books.shape[2]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(part, width).astype(np.int32)),
                pa.array(np.repeat(entry, width).astype(np.int32)),
                pa.array(np.tile(np.arange(width, dtype=np.int32), len(part))),
                pa.array(total[part, entry].ravel()),
                pa.array(np.repeat(count[part, entry], width)),
            ],
            ["part", "entry", "place", "total", "n"],
        )

    found = rows.select("embedding").mapInArrow(sums, "part int, entry int, place int, total long, n long")
    means = found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    part, entry, place, total, n = (means[c].to_numpy() for c in ("part", "entry", "place", "total", "n"))
    after = books.copy()
    after[part, entry, place] = total // n
    return after


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(rows: DataFrame, books: np.ndarray, dims: int) -> DataFrame:
    """vec_id, label, code and error of every row: the codes of the parts in hex, and the squared distances summed."""
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, parts in _pieces(batches, dims):
            codes, errors = zip(*(nearest(parts[:, p], book) for p, book in enumerate(sent.value)), strict=True)
            names = [bytes(c).hex() for c in np.stack(codes, 1).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [some["vec_id"], some["label"], pa.array(names), pa.array(np.sum(errors, 0))],
                ["vec_id", "label", "code", "error"],
            )

    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    return kept.mapInArrow(run, f"vec_id long, label {dict(rows.dtypes)['label']}, code string, error long")


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (the errors of all rows of its label) and codebooks_sha256."""
    rows, dims = whole_rows(vectors.select("vec_id", "label", "embedding"), "vec_id", "embedding")
    if dims % PARTS:
        raise ValueError(f"vectors of length {dims} have no {PARTS} equal parts")
    books = first_codebooks(rows, dims) if dims else np.zeros((PARTS, 1, 1), np.int64)
    for _ in range(ROUNDS if dims else 0):
        books = refined(rows, books, dims)
    codes = stored(coded(rows, books, max(dims, PARTS)), "codes")
    sums = stored(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    return codes.join(small(sums, MANY_LABELS), F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
