"""Embedding columns as exact integer vectors, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 256


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds neither NULL nor NaN nor an infinite entry."""
    entry_ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(F.forall(vector.cast("array<double>"), entry_ok), F.lit(False))


def integer_vector(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * entry) as long, the entry taken as double."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(scale * c))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column whose lists are equally long, as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = np.asarray(column.flatten())
    return flat.reshape(rows, len(flat) // rows if rows else 0)


def largest(x: np.ndarray) -> int:
    """Largest absolute entry, as a Python integer."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def exactly(x: np.ndarray, terms: int, other: int | None = None) -> np.ndarray:
    """`x` in a type in which sums of `terms` products of its entries (with entries up to `other`) are exact:
    doubles where 53 bits suffice, else Python integers."""
    most = largest(x)
    small = terms * most * (most if other is None else other) < 1 << 53
    return x.astype(np.float64) if small else x.astype(object)
