"""Best-fit packing by a plan over the histogram of piece lengths.

``encode_pieces`` turns documents into pieces of at most ``capacity`` ids,
``plan_best_fit`` runs best-fit decreasing over the *counts* of each length, and
``assign_slots`` lets every piece take a planned slot by joining on its rank within
its length. The plan depends on the number of distinct lengths only, at most
``capacity``, whatever the number of documents.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import map_batches, materialize
from .tokens import ENCODE_BYTES, ENCODE_ROWS, encoder

PIECES = "doc_id long, piece int, start long, length long"
PLAN = ["length", "first_rank", "last_rank", "first_sequence", "per_sequence", "base"]


def encode_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", digest: bool = False
) -> DataFrame:
    """One row per piece: the ids of a document, then ``separator``, cut every ``capacity`` ids.

    ids: little-endian unsigned 32-bit values; with ``digest`` there is ``ids_crc32 long``,
    their CRC-32, in their place. Null and empty texts are the separator alone. Documents
    of at most ``capacity`` ids are one piece; of a longer one the last piece may be
    shorter. Null ids and repeated rows are kept. Other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, starts = encoder(tokenizer).encode(batch.column(1), separator)
        n_pieces = -(-np.diff(starts) // capacity)
        owner = np.repeat(np.arange(batch.num_rows), n_pieces)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
        first = starts[owner] + capacity * piece
        length = np.minimum(capacity, starts[owner + 1] - first)
        # pieces follow one another, so each ends where the next begins
        cuts, data = (4 * np.append(first, len(ids))).astype(np.int32), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
        if digest:
            view = memoryview(data)
            last = pa.array([zlib.crc32(view[a:z]) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.int64())
        else:
            last = pa.BinaryArray.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(cuts), data])
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(capacity * piece), pa.array(length), last],
            names=["doc_id", "piece", "start", "length", "ids_crc32" if digest else "ids"],
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, PIECES + (", ids_crc32 long" if digest else ", ids binary"), ENCODE_ROWS, ENCODE_BYTES)


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. A class is a range of sequences that are filled
    alike; placing a length into the fullest class that has room fills its sequences one
    after the other, so at most one class is split in three for each length.

    Returns rows of ``PLAN``: the pieces of ``length`` with ranks first..last go to the
    sequences from ``first_sequence`` on, ``per_sequence`` to each, the first of each at
    offset ``base``.
    """
    classes: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)
    rooms: list[int] = []
    plan, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in classes:
                classes[room] = []
                insort(rooms, room)
            classes[room].append((first, n))

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = classes[room].pop()
                if not classes[room]:
                    del classes[room], rooms[at]
            else:
                room, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            each = room // length
            full, rest = min(n, left // each), 0
            if full:
                plan.append((length, rank, rank + full * each - 1, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n:
                if left:
                    plan.append((length, rank, rank + left - 1, first + full, left, capacity - room))
                    put(room - left * length, first + full, 1)
                    rank, left, rest = rank + left, 0, 1
                put(room, first + full + rest, n - full - rest)
    return plan


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    """Whole numbers, which Spark takes as they are: plain rows would go through Python workers of their own."""
    cols = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=names)


def assign_slots(pieces: DataFrame, capacity: int = 2048, row_col: str | None = None) -> DataFrame:
    """``pieces`` (with a ``length``) plus ``sequence_id`` and ``offset``.

    ``row_col`` is a column that is different in every row, which deals equal rows to
    different buckets; it is not returned. Without one all columns tell rows apart.

    ``pieces`` must be cheap to read twice (a written table). Ranks within a length are
    made of buckets: the n rows of a length are dealt to about sqrt(n) buckets, ranked
    there, and shifted by the counts of the buckets before. A length that a third of all
    rows share is so spread over many tasks, and neither a bucket nor the number of
    buckets of a length grows faster than the root of its rows. Column names of ``pieces`` other
    than ``length`` are kept; none may be one of the new names. No rows give no rows.
    """
    spark = pieces.sparkSession
    kept = [c for c in pieces.columns if c != row_col]
    keys = [row_col] if row_col else [c for c in kept if dict(pieces.dtypes)[c] != "binary"]
    counted = pieces.groupBy("length").count().collect()  # at most one row for each length up to capacity
    histogram = {r["length"]: r["count"] for r in counted}
    buckets = spark.createDataFrame(_table([(k, isqrt(n) + 1) for k, n in histogram.items()], ["length", "_buckets"]))
    dealt = pieces.join(F.broadcast(buckets), "length").withColumn("_bucket", F.expr(f"pmod(xxhash64({', '.join(keys)}), _buckets)"))
    before = (
        dealt.groupBy("length", "_bucket")
        .count()
        .withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("count"))
        .drop("count")
    )
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*keys)).cast("long") - 1)
    ranked = ranked.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    plan = spark.createDataFrame(_table(plan_best_fit(histogram, capacity), PLAN)).withColumnRenamed("length", "_length")
    placed = ranked.join(F.broadcast(plan), F.expr("length = _length AND _rank BETWEEN first_rank AND last_rank"))
    nth = F.col("_rank") - F.col("first_rank")
    return placed.select(
        *kept,
        (F.col("first_sequence") + F.floor(nth / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("base") + (nth % F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each piece of each document goes: ``doc_id, piece, start, length,
    ids_crc32, sequence_id, offset`` (sequences are filled from offset 0 without gaps).

    Nulls, empty texts, repeated rows and an empty table as in ``encode_pieces``.
    """
    pieces = encode_pieces(docs, tokenizer, capacity, separator, id_col, text_col, digest=True)
    return assign_slots(materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces"), capacity, "_row")


def build_sequences(pieces: DataFrame, slots: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids binary, lengths array<long>``.

    ``pieces`` as from ``encode_pieces`` and ``slots`` as from ``pack``, joined on
    ``(doc_id, piece)``, which must be unique and not null. A group is one sequence, so
    at most ``capacity`` ids.
    """
    both = slots.select("doc_id", "piece", "sequence_id", "offset", "length").join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return (
        both.groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select(
            "sequence_id",
            F.expr("unhex(array_join(transform(parts, p -> hex(p.ids)), ''))").alias("ids"),
            F.expr("transform(parts, p -> p.length)").alias("lengths"),
        )
    )
