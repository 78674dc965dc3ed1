"""Token-id files: fixed-width bit packing in blocks.

A shard file is ``MAGIC``, a header of eight little-endian unsigned 64-bit numbers
(bits per id, ids in a block, documents, ids, blocks, then three zeros), the document
ids (signed 64-bit), a null flag byte per document, the first id of each document
(unsigned 64-bit, within the shard), the byte offset of each block (unsigned 64-bit,
from the start of the data), and the data. Each block packs its ids in ``bits`` bits
each, lowest bit first, padded to a whole byte. ``bits`` is the least width that holds
every id of the vocabulary. Any run of ids can be read from its own blocks alone.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import slices
from .tokens import ENCODE_ROWS, encoder

MAGIC = b"TOKBITS1"
BLOCK = 4096
#: Ids that are unpacked at a time.
READ_IDS = 1_000_000


def width(vocabulary: int) -> int:
    """Least number of bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` (unsigned) at ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    """The ``n`` ids that ``pack_bits`` wrote, as unsigned 32-bit numbers."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def dump(docs: list[int | None], ids: np.ndarray, starts: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """A shard file of documents and their ids (unsigned 32-bit), those of document k being
    ``ids[starts[k]:starts[k + 1]]``."""
    blocks = [pack_bits(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype="<u8")
    head = np.array([bits, block, len(docs), len(ids), len(blocks), 0, 0, 0], "<u8").tobytes()
    names = np.array([0 if d is None else d for d in docs], "<i8").tobytes()
    nulls = bytes(d is None for d in docs)
    return b"".join([MAGIC, head, names, nulls, starts.astype("<u8").tobytes(), offsets.tobytes(), *blocks])


class Shard:
    """Random access to a shard file, read through ``read(offset, n) -> bytes``."""

    def __init__(self, read):
        if read(0, 8) != MAGIC:
            raise ValueError("not a token file")
        self._read = read
        self.bits, self.block, self.n_docs, self.n_ids, self.n_blocks = map(int, np.frombuffer(read(8, 64), "<u8")[:5])
        at = 72
        names = np.frombuffer(read(at, 8 * self.n_docs), "<i8")
        at += 8 * self.n_docs
        nulls = np.frombuffer(read(at, self.n_docs), np.uint8)
        at += self.n_docs
        self.docs = [None if z else int(d) for d, z in zip(names, nulls, strict=True)]
        self.starts = np.frombuffer(read(at, 8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.offsets = np.frombuffer(read(at, 8 * (self.n_blocks + 1)), "<u8").astype(np.int64)
        self._data = at + 8 * (self.n_blocks + 1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop`` of the shard; only their blocks are read."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        raw = self._read(self._data + int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        parts = []
        for b in range(first, last + 1):
            a = int(self.offsets[b] - self.offsets[first])
            z = int(self.offsets[b + 1] - self.offsets[first])
            parts.append(unpack_bits(raw[a:z], min(self.block, self.n_ids - b * self.block), self.bits))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


MANIFEST = "path string, part int, shard int, n_docs long, n_ids long"
TOKENS = "doc_id long, start long, n_tokens long"


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, shard_ids: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each, write shard files in ascending
    document order to ``folder`` (a URI that all executors share) and a manifest
    ``folder/manifest`` with one row per shard, which is returned:
    ``path, part int, shard int, n_docs long, n_ids long``, ordered by (part, shard).

    Null and empty texts hold ``end_id`` alone; null ids come first; rows of equal id are
    ordered by a hash of their texts, and equal rows follow each other. Ranges are cut
    within an id and within equal rows too, so no id is a hot key. A task streams: it holds
    one shard at a time, which exceeds ``shard_ids`` by less than one document. Each
    attempt of a task writes under names of its own and the manifest names those of the
    attempt that Spark accepted, so nothing is ever renamed or overwritten; files of lost
    attempts are named nowhere.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("n", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("doc_id", "h", "n").sortWithinPartitions("doc_id", "h", "n").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        bits = width(max(enc.size, end_id + 1))
        part, shard, attempt = TaskContext.get().partitionId(), 0, uuid.uuid4().hex
        disk, root = fs.FileSystem.from_uri(folder)
        disk.create_dir(root, recursive=True)
        names: list[int | None] = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            path = f"part-{part:06d}-{shard:06d}-{attempt}.tok"
            with disk.open_output_stream(f"{root}/{path}") as out:
                out.write(dump(names, np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(sizes))), bits))
            row = [path], [part], [shard], [len(names)], [held]
            kinds = pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["path", "part", "shard", "n_docs", "n_ids"])

        for batch in (x for b in batches for x in slices(b, ENCODE_ROWS)):
            docs_here = batch.column(0).to_pylist()
            ids, starts = enc.encode(batch.column(1), end_id)
            at = 0
            while at < len(docs_here):
                # documents up to the one that fills the shard
                stop = min(len(docs_here), int(np.searchsorted(starts, starts[at] + shard_ids - held)))
                names += docs_here[at:stop]
                parts.append(ids[starts[at] : starts[stop]])
                sizes.append(np.diff(starts[at : stop + 1]))
                held += int(starts[stop] - starts[at])
                at = stop
                if held >= shard_ids:
                    yield flush()
                    shard, names, parts, sizes, held = shard + 1, [], [], [], 0
        if names:
            yield flush()

    rows.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("part", "shard")


def read_token_files(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """Every document of the shard files: ``doc_id, start long, n_tokens long, ids binary``,
    or ``ids_crc32 long``, the CRC-32 of the ids, in place of them.

    ``start`` is the number of ids of all documents before it: the ids of the parts before
    (one sum for each writing task), of the shards before in the part, and the place in
    the shard.
    """
    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    n_shards = shards.count()
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    sums = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("parts_before"))
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    placed = shards.withColumn("own", own).join(sums, "part").select("path", (F.col("own") + F.col("parts_before")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with disk.open_input_file(os.path.join(root, path)) as f:
                    shard = Shard(lambda at, n, f=f: f.read_at(n, at))
                    k = 0
                    while k < shard.n_docs:
                        # documents of about a million ids at a time
                        stop = min(shard.n_docs, max(k + 1, int(np.searchsorted(shard.starts, shard.starts[k] + READ_IDS))))
                        flat = np.ascontiguousarray(shard.ids(int(shard.starts[k]), int(shard.starts[stop])), "<u4")
                        at = 4 * (shard.starts[k : stop + 1] - shard.starts[k])
                        if digest:
                            view = memoryview(flat).cast("B")
                            last = pa.array([zlib.crc32(view[a:z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64())
                        else:
                            last = pa.BinaryArray.from_buffers(pa.binary(), stop - k, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat)])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard.docs[k:stop], pa.int64()), pa.array(shard.starts[k:stop] + before, pa.int64()), pa.array(np.diff(at) // 4, pa.int64()), last],
                            names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                        )
                        k = stop

    tasks = max(1, min(n_shards, 4 * spark.sparkContext.defaultParallelism))
    return placed.repartition(tasks, "path").mapInArrow(run, TOKENS + (", ids_crc32 long" if digest else ", ids binary"))
