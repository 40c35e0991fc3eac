"""Vectors as rows of integers, for the operators that must count exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer components lie within this; beyond it the operators raise an error instead of giving rounded sums.
LIMIT = 1 << 31


def usable(vector: Column) -> Column:
    """True for a vector that isn't null and has no null, NaN or infinite component."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def integer_vectors(rows: DataFrame, vector: str, scale: int, multiple: int = 1) -> tuple[DataFrame, int]:
    """Usable rows with ints array<long>, floor(scale * x) of each component, in place of vector; and their width.

    The width is the longest vector's, rounded up to a multiple; shorter vectors count as followed by zeros.
    """
    kept = rows.where(usable(F.col(vector)))
    longest = kept.agg(F.max(F.size(vector))).first()[0] or 0
    width = max(multiple, -(-longest // multiple) * multiple)
    ints = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    padded = F.concat(ints, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(vector)))
    return kept.withColumn("ints", padded).drop(*({vector} - {"ints"})), width


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of one width as an int64 matrix; an error names the limit where a component is beyond it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)
    if out.size and max(int(out.max()), -int(out.min())) > LIMIT:
        raise ValueError(f"a scaled component is beyond {LIMIT}")
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exactly: in floating point where no partial sum can pass 2**53, else with Python's integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(object) @ b.astype(object).T
