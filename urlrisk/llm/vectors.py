"""What the operators on vectors share: which rows take part, and vectors as bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key that holds more than one row in so many is hot: there are at most as many hot keys.
HOT_SHARE = 1000


def is_finite(v: str) -> Column:
    """Whether the array ``v`` is not null or empty and all its components are finite numbers."""
    return F.expr(f"coalesce(size({v}) > 0 AND forall({v}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <> double('inf')), false)")


def common_size(df: DataFrame, v: str) -> int | None:
    """The most common number of components of ``v`` (ties: the smaller); None without rows."""
    row = df.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return row.d if row else None


def as_bytes(df: DataFrame, v: str) -> Column:
    """The array ``v`` of numbers as the bytes of its doubles; equal vectors have equal bytes
    (a negative zero is zero)."""

    @F.pandas_udf("binary")
    def pack(rows):
        return rows.map(lambda x: (np.asarray(x, "<f8") + 0.0).tobytes())

    return pack(F.col(v))


def matrix(column: pa.Array, dtype: str, d: int) -> np.ndarray:
    """A binary column of vectors of ``d`` numbers as a matrix, row by row."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, d)


def unit(x: np.ndarray) -> np.ndarray:
    """The rows of ``x``, none of them zero, at length one, in double precision."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def join_hot(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` with the row of ``table`` of their ``key`` (one for each key; an inner join).

    ``count`` is the column of ``table`` with the number of rows of the key. Keys that hold
    over 1 in ``HOT_SHARE`` of all ``total`` rows, of which there are under ``HOT_SHARE``, are
    broadcast, so that no task gets all rows of such a key; the others are shuffled.
    """
    is_hot = F.col(count) > total // HOT_SHARE
    hot, rest = table.where(is_hot), table.where(~is_hot)
    at_once = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return at_once.unionByName(others)
