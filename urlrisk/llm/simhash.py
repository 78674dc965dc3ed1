"""SimHash near-duplicate detection with pigeonhole blocks.

Fingerprints that differ in at most three of 64 bits agree on at least two of five
blocks, so each fingerprint is filed under the ten pairs of blocks. A bucket is
compared where it stands and gives the edges of a spanning forest of its links, not all
its pairs. Buckets with more than ``max_bucket`` distinct fingerprints are split again:
the bits that the key leaves free are cut into four blocks, of which close pairs again
share one. After a few levels so few bits are free that every bucket is small, so the
links found are exact whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import connected_components, giving_back, keep_rows, map_batches, materialize

#: Distinct fingerprints that one task compares with each other.
MAX_BUCKET = 2048
#: Buckets of up to so many fingerprints are looked through together for any link.
SMALL = 32


def _fingerprint(words: list[bytes], width: int) -> int:
    if not words:
        return 0
    if len(words) <= width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return majority(np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit ``hashes``."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        part = np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += part.sum(axis=0, dtype=np.int32)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _with_hash(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, h, fp``: as ``fingerprints``, with the hash of the text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [_fingerprint((t or "").encode("utf-8", "surrogatepass").lower().split(), width) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(out, "<u8").view("<i8"))], names=["doc_id", "h", "fp"])

    text = F.col(text_col).cast("string")
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")), run, "doc_id long, h long, fp long")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id long, fp long``: the 64-bit SimHash of each whole text, as a signed number.

    A-Z is lower-cased; words are runs of other than blank, tab, newline, vertical tab,
    form feed and return; shingles are ``width`` words, repeats included, joined by one
    blank (fewer words: all of them). A shingle's hash is XXH64 of its UTF-8, seed 42. A
    bit is set if it is set in over half of the hashes. Null and blank texts have the
    fingerprint 0. Null ids and repeated rows are kept; other columns are ignored.
    """
    return _with_hash(docs, width, id_col, text_col).select("doc_id", "fp")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cut(free: list[int], n: int) -> list[int]:
    """Masks of ``n`` blocks of the bit numbers in ``free``."""
    return [sum(1 << b for b in free[len(free) * k // n : len(free) * (k + 1) // n]) for k in range(n)]


def block_masks(distance: int = 3) -> list[int]:
    """The masks of the first level: every pair of ``distance + 2`` blocks."""
    return [a | b for a, b in combinations(_cut(list(range(64)), distance + 2), 2)]


def finer_masks(mask: int, distance: int = 3) -> list[int]:
    """``mask`` with one more of ``distance + 1`` blocks of its free bits."""
    return [mask | m for m in _cut([b for b in range(64) if not mask >> b & 1], distance + 1)]


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among sorted distinct fingerprints."""
    edges, left = [], np.ones(len(fps), bool)
    for i in range(len(fps)):
        if not left[i]:
            continue
        left[i] = False
        found = [i]
        while found:
            j = found.pop()
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(fps[rest] ^ fps[j]) <= distance]
            left[near] = False
            found.extend(near.tolist())
            edges.extend((i, k) for k in near.tolist())
    return edges


def _links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (mask, key, fp); a bucket may reach over batches."""
        kept = [np.zeros(0, np.int64)] * 3
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def compare(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((np.diff(mask) != 0) | (np.diff(key) != 0)) + 1
            starts, stops = np.append(0, cuts), np.append(cuts, len(fp))
            size = stops - starts
            two = starts[size == 2]
            near = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= distance]
            a, b = [fp[near]], [fp[near + 1]]
            small = (size > 2) & (size <= SMALL)
            bucket = np.repeat(np.arange(len(size)), np.where(small, size, 0))
            at = np.arange(len(bucket)) - np.repeat(np.cumsum(size * small) - size * small, size * small) + starts[bucket]
            linked = size > SMALL
            for step in range(1, SMALL):
                inside = at + step < stops[bucket]
                bucket, at = bucket[inside], at[inside]
                linked[bucket[np.bitwise_count((fp[at] ^ fp[at + step]).view(np.uint64)) <= distance]] = True
            for s, z in zip(starts[linked].tolist(), stops[linked].tolist(), strict=True):
                if edges := _forest(fp[s:z].view(np.uint64), distance):
                    i, j = np.array(edges).T
                    a.append(fp[s + i])
                    b.append(fp[s + j])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=schema)

        for batch in batches:
            cols = [np.concatenate([k, c.to_numpy(zero_copy_only=False)]) for k, c in zip(kept, batch.columns, strict=True)]
            if not len(cols[0]):
                continue
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            at = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            if at:
                yield compare(*(c[:at] for c in cols))
            kept = [c[at:] for c in cols]
        if len(kept[0]):
            yield compare(*kept)

    return run


def links(fps: DataFrame, distance: int = 3, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """``fps(fp long)``, distinct and cheap to read again, to edges ``(a, b)`` whose
    components are those of all links at ``distance`` or fewer differing bits."""
    masks, found = block_masks(distance), []
    rows = fps.select(F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"), "fp")
    while True:
        rows = rows.withColumn("key", F.col("mask").bitwiseAND(F.col("fp")))
        free = 64 - min(m.bit_count() for m in masks)
        hot = None
        if 2**free > max_bucket:
            hot = rows.groupBy("mask", "key").count().where(F.col("count") > max_bucket).select("mask", "key")
            hot = materialize(hot, "hot")
            if hot.isEmpty():
                hot = None
        cold = rows if hot is None else rows.join(hot, ["mask", "key"], "left_anti")
        dealt = cold.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        found.append(dealt.mapInArrow(giving_back(_links(distance)), "a long, b long"))
        if hot is None:
            break
        finer = {_signed(m): [_signed(x) for x in finer_masks(m, distance)] for m in masks}
        table = F.create_map(*(x for m, xs in finer.items() for x in (F.lit(m), F.array(*map(F.lit, xs)))))
        rows = rows.join(hot, ["mask", "key"], "left_semi").select(F.explode(table[F.col("mask")]).alias("mask"), "fp").distinct()
        masks = sorted({x for xs in finer.values() for x in (y % (1 << 64) for y in xs)})
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _grouped(docs: DataFrame, width: int, distance: int, max_bucket: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(table, named)``: ``doc_id, h, fp`` of all documents, and ``fp, root, component_id``."""
    table = materialize(_with_hash(docs, width, id_col, text_col), "fingerprints")
    least = materialize(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(links(least.select("fp"), distance, max_bucket))
    joined = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    joined = materialize(joined, "roots")
    groups = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return table, joined.join(groups, "root").select("fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, width: int = 3, distance: int = 3, max_bucket: int = MAX_BUCKET, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, fp long, component_id``: documents linked through fingerprints that
    differ in at most ``distance`` bits share the smallest ``doc_id`` of those reachable.

    Copies share a fingerprint, which is compared once. A null id has a component but
    names none: if all ids of a component are null, so is its ``component_id``. Repeated
    rows stay; an empty table gives no rows.
    """
    table, named = _grouped(docs, width, distance, max_bucket, id_col, text_col)
    return table.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, width: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each component: that of the smallest id,
    and of several texts under that id the one with the least hash.

    Rows whose id is null stay, as they can't be named; of rows with the same id and text
    one stays. Rows of one id whose texts are in different components are told apart.
    """
    table, named = _grouped(docs, width, distance, MAX_BUCKET, id_col, text_col)
    firsts = table.join(named, "fp").where("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("f"))
    return keep_rows(docs, firsts.select("f.doc_id", "f.h"), id_col, text_col)
