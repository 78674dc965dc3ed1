"""Numbers without gaps for the rows of a table, in an order, without one task seeing all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.sources.scratch import written

#: ``monotonically_increasing_id`` has the number of the partition above these bits.
_PART_BITS = 33


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... by ``order``, whose columns may be of any type that Spark
    sorts; nulls come first. Rows that tie in all of ``order`` are numbered in any order.

    Spark sorts by range, and each range's rows are counted as they lie. A range's first
    number follows from the counts of the ranges before it, of which there are as many as
    shuffle partitions at most: this is all that the driver sees.
    """
    place = "_place_in_range"
    while place in df.columns or f"{place}_part" in df.columns:
        place = "_" + place
    part = f"{place}_part"
    spark = df.sparkSession
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    rows = written(ordered, "numbered").withColumn(part, F.shiftright(place, _PART_BITS))
    counts = sorted(tuple(r) for r in rows.groupBy(part).count().collect())
    starts, before = [], 0
    for k, n in counts:
        starts.append((k, before))
        before += n
    first = spark.createDataFrame(starts, f"{part} long, {place}_first long")
    number = F.col(f"{place}_first") + F.expr(f"`{place}` & {2**_PART_BITS - 1}L") + 1
    return rows.join(F.broadcast(first), part).select(*df.columns, number.alias(name))
