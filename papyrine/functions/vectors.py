"""Vector functions. Sums are taken in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from papyrine.functions.text import _c


@F.pandas_udf(DoubleType())
def _norms(s: pd.Series) -> pd.Series:
    lists = pa.array(s, pa.list_(pa.float64()))
    length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
    out = np.zeros(len(lists))
    some = np.flatnonzero(length > 0)
    with np.errstate(all="ignore"):
        if len(some):
            out[some] = np.sqrt(np.add.reduceat(flat * flat, (np.cumsum(length) - length)[some]))
    return pd.Series(out).where(s.notna(), None)


def norm(c: str | Column) -> Column:
    """Euclidean length, one Arrow call per batch (Spark's array lambdas are interpreted entry by entry)."""
    return _norms(_c(c))


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of exactly ``dim`` entries without nulls, as positions and a float64 matrix."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dim)
    if not len(at):
        return at, np.empty((0, dim))
    x = column.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1)
    return at[good], x[good]


def batches_of(it: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for b in it:
        for s in range(0, b.num_rows, n):
            yield b.slice(s, n)
