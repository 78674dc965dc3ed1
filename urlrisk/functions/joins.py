"""Equi joins that hold for hot keys and for tables of which few rows have a partner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key that holds more than one row in so many is hot: there are fewer hot keys than this.
HOT_SHARE = 1000
#: Bits of a filter, in words of 64: its table has at most 2 ** 18 rows of two numbers.
FILTER_BITS = 1 << 24


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


def _bit(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def filter_of(table: DataFrame, key: str) -> DataFrame:
    """``word, bits``: which of ``FILTER_BITS`` hash values the keys of ``table`` have. Bounded,
    whatever the size of ``table``; a table of very many keys only lets more through."""
    one = F.bit_or(F.expr("shiftleft(1L, cast(b & 63 AS int))"))
    return table.select(_bit(key).alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(one.alias("bits"))


def let_through(rows: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """Those of ``rows`` whose ``key`` may be in the table that ``filter_of`` was given, and
    all that are: a look-up before any shuffle."""
    held = rows.withColumn("_bit", _bit(key)).withColumn("word", F.shiftright("_bit", 6)).join(F.broadcast(words), "word")
    return held.where(F.expr("shiftright(bits, cast(_bit & 63 AS int)) & 1 = 1")).select(*rows.columns)
