"""Integer vectors out of float ones, and exact inner products of them by float64 BLAS.

An integer is split into limbs so narrow that every sum of limb products stays within 2^53, where float64
is exact in any order of summation. The products of limbs are put together again in 64-bit integers, whose
carry-over past 2^64 cancels out wherever the inner product itself fits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = 53  # bits of a float64 that count whole numbers
LIMIT = 1 << 24  # of components, so that distances and products of some thousand of them fit in 64 bits
NO_ID = (1 << 63) - 1


def whole_rows(rows: DataFrame, row_id: str, vector: str) -> tuple[DataFrame, int]:
    """The rows with a whole vector, and its length.

    A vector is whole if it has components, none of them null or not finite, and as many as the whole
    vector of the smallest id (null ids come last); there is no such length in an empty table: 0.
    """
    v = F.col(vector)
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    found = rows.where(v.isNotNull() & fine)
    order = F.struct(F.col(row_id).isNull().alias("last"), F.col(row_id).alias("id"), F.size(v).alias("dims"))
    least = found.agg(F.min(order)["dims"].alias("dims")).first()["dims"] or 0
    return found.where(F.size(v) == least), least


def id_or_last(row_id: str) -> Column:
    """The id as a long; null ids become the greatest long, so that they lose every tie."""
    return F.coalesce(F.col(row_id).cast("long"), F.lit(NO_ID))


def floors(vectors: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of the components of whole vectors, a row each."""
    found = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if found.size and np.abs(found).max() >= LIMIT:
        raise ValueError(f"components beyond {LIMIT / scale:g} are not supported")
    return found.astype(np.int64).reshape(len(vectors), dims)


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """x as a sum of limbs, least first, limb i worth 2^(bits * i); only the last is signed."""
    top = int(np.abs(x).max()) if x.size else 0
    count = max(1, -(-top.bit_length() // bits))
    mask = (1 << bits) - 1
    parts = [(x >> (bits * i)) & mask for i in range(count - 1)] + [x >> (bits * (count - 1))]
    return [p.astype(np.float64) for p in parts]


def exact_dot(a: np.ndarray, b: np.ndarray, bits: int | None = None) -> np.ndarray:
    """The 64-bit inner products of the rows of a with the rows of b, exact if they fit in 64 bits."""
    dims = max(1, a.shape[1])
    bits = bits or (EXACT - dims.bit_length()) // 2
    out = np.zeros((len(a), len(b)), np.int64)
    right = [y.T for y in limbs(b, bits)]
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            if bits * (i + j) < 64:
                out += (x @ y).astype(np.int64) << (bits * (i + j))
    return out


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A two-dimensional array as a list column."""
    n, width = rows.shape
    ends = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(rows).ravel()).cast(kind))
