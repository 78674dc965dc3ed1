"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts with the same set of shingles are one node, and every link is verified by the exact
similarity of the whole sets. Candidates are found in two steps. The SimHash of a node is that of
its set; the pigeonhole blocks of ``simhash.links`` give the classes of fingerprints that differ
in at most six bits, and the nodes of a class are compared. Sets right at 0.8 differ in about ten
bits, more than blocks can search, so MinHash finds the rest: nodes that agree on all of
six values in one of 32 bands are candidates (at a similarity of 0.8 all but 1 in 17,000
pairs, at 0.9 none to speak of are missed). A band's bucket is compared unless all its nodes are linked by then.

A bucket, be it a class or of a band, is compared where it stands and gives the edges of
a spanning forest of its links. A bucket of too many shingles is dealt
into parts, with eight of its nodes in each; nodes that are not in its largest component
then are dealt to parts of their own, and each of these meets each part of the bucket in a group of
bounded size, so its links are those of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._common import connected_components, giving_back, keep_rows, map_batches, materialize

#: Bits in which the fingerprints of candidates differ at most: 28 pairs of eight blocks, keys of 16 bits.
DISTANCE = 6
BANDS, ROWS = 32, 6
#: Odd factors: each orders all 32-bit hashes anew.
_FACTORS = np.random.default_rng(5).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Shingles of a bucket that one task compares; a node counts as ``LEAST_WEIGHT`` at least.
MAX_WEIGHT, LEAST_WEIGHT = 1 << 21, 2048
#: Nodes of a bucket that stand in all its parts.
HEADS = 8


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text: A-Z is lower-cased, words are
    runs of other than white space; fewer words than ``width`` are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) > width else [b" ".join(words)] if words else []
    return np.array(sorted({xxhash.xxh64_intdigest(g, 42) for g in grams}), "<u8")


def _node(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), 42)).view(np.int64))


def _minhashes(grams: np.ndarray) -> np.ndarray:
    short = (grams >> np.uint64(32)).astype(np.uint32)
    room = np.empty_like(short)
    return np.array([np.multiply(short, f, out=room).min() for f in _FACTORS], "<u4")


def signatures(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, h, node, size, fp, keys``: the hash of a text, the set of its shingles by its
    hash, their number, its SimHash and the key of each band."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sizes, fps, keys = [], [], [], []
        for text in batch.column(1).to_pylist():
            grams = shingles(text, width)
            nodes.append(_node(grams))
            sizes.append(len(grams))
            fps.append(simhash.majority(grams))
            if not len(grams):
                keys.append([])
                continue
            bands = _minhashes(grams).reshape(BANDS, ROWS)
            keys.append(np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)], "<u8").view("<i8"))
        cols = [batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(fps, "<u8").view("<i8")), pa.array(keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "h", "node", "size", "fp", "keys"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    return map_batches(rows, run, "doc_id long, h long, node long, size long, fp long, keys array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``node, grams`` of ``docs(doc_id, text)``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t, width) for t in batch.column(1).to_pylist()]
        cols = [pa.array([_node(g) for g in found], pa.int64()), pa.array([g.view("<i8") for g in found], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, names=["node", "grams"])

    return map_batches(docs, run, "node long, grams array<long>")


def forest(sets: list[np.ndarray], tenths: int = 8) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among sets of hashes."""
    sizes = np.array([len(s) for s in sets])
    codes = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    marks = np.zeros(int(sizes.sum()), bool)
    edges, left = [], np.arange(len(sets))
    while len(left) > 1:
        first, left = int(left[0]), left[1:]
        found = [first]
        flat = None
        while found and len(left):
            j = found.pop()
            if flat is None:
                flat, starts = np.concatenate([codes[k] for k in left]), np.append(0, np.cumsum(sizes[left])[:-1])
            marks[codes[j]] = True
            both = np.add.reduceat(marks[flat], starts, dtype=np.int64)
            marks[codes[j]] = False
            near = 10 * both >= tenths * (sizes[left] + sizes[j] - both)
            if near.any():
                edges.extend((first, k) for k in left[near].tolist())
                found.extend(left[near].tolist())
                left, flat = left[~near], None
    return edges


def _links(tenths: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key; a bucket may reach over batches."""
        key, nodes, sets = None, [], []

        def edges() -> pa.RecordBatch:
            pairs = forest(sets, tenths) if len(sets) > 1 else []
            cols = [pa.array([nodes[p[k]] for p in pairs], pa.int64()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(cols, names=["a", "b"])

        for batch in batches:
            grams = batch.column(2)
            values, at = grams.values.to_numpy(zero_copy_only=False), grams.offsets.to_numpy()
            for k, (bucket, node) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if bucket != key:
                    yield edges()
                    key, nodes, sets = bucket, [], []
                nodes.append(node)
                sets.append(values[at[k] : at[k + 1]].copy())
        yield edges()

    return run


def _weight() -> Column:
    return F.sum(F.greatest("size", F.lit(LEAST_WEIGHT)))


def _part(part) -> Column:
    return F.xxhash64("key", part, F.lit(1)).alias("key")


#: What tells whether two buckets have the same nodes.
_MEMBERS = ("n", "low", "high", "h")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows of ``rows(key, node, size)`` whose key several have."""
    many = materialize(rows.groupBy("key").count().where("count > 1").select("key"), "many")
    return materialize(rows.join(many, "key", "left_semi"), "shared")


def _buckets(rows: DataFrame) -> DataFrame:
    """``key, n, low, high, h`` and the weight ``w`` of the buckets of ``rows(key, node, size, root)``
    whose nodes have more than one root."""
    members = F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h")
    roots = F.min("root").alias("first"), F.max("root").alias("last")
    return rows.groupBy("key").agg(*members, *roots, _weight().alias("w")).where("first <> last").drop("first", "last")


def _once(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``key, node`` of one of the ``buckets`` with the same nodes each."""
    same = buckets.groupBy(*_MEMBERS).agg(F.min("key").alias("key"))
    return rows.select("key", "node").join(materialize(same.select("key"), "once"), "key", "left_semi")


def pairs_of_parts(apart: DataFrame, split: DataFrame, max_weight: int) -> DataFrame:
    """``key, node``: groups in which every node of ``apart`` meets every node of its bucket.

    ``split(key, node, size, parts)`` has all nodes of the heavy buckets, ``apart`` some of
    them. Each side is dealt to parts of about ``max_weight``, so a group has at most about twice that.
    """
    groups = apart.groupBy("key").agg(F.ceil(_weight() / max_weight).cast("long").alias("groups"))
    own = lambda seed, n: F.expr(f"pmod(xxhash64(node, {seed}), {n})")
    asking = apart.join(groups, "key").withColumn("g", own(1, "groups")).withColumn("p", F.explode(F.expr("sequence(0L, parts - 1)")))
    asked = split.join(groups, "key").withColumn("p", own(2, "parts")).withColumn("g", F.explode(F.expr("sequence(0L, groups - 1)")))
    both = asking.select("key", "g", "p", "node").unionByName(asked.select("key", "g", "p", "node"))
    return both.select(F.xxhash64("key", "g", "p", F.lit(2)).alias("key"), "node").distinct()


def _with_roots(rows: DataFrame, edges: DataFrame | None) -> DataFrame:
    """``rows`` with the ``root`` of each node in the components of ``edges``."""
    if edges is None:
        return rows.withColumn("root", F.col("node"))
    return materialize(rows.join(connected_components(edges), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")


def _more_edges(shared: DataFrame, edges: DataFrame | None, sets: DataFrame, tenths: int, max_weight: int) -> DataFrame:
    """``edges`` and those of the links in the buckets of ``shared(key, node, size)`` that join components of theirs."""
    rows = _with_roots(shared, edges)
    buckets = materialize(_buckets(rows), "buckets")
    is_hot = (F.col("w") > max_weight) & (F.col("n") > 2)
    hot = buckets.where(is_hot).select("key", F.ceil(F.col("w") / max_weight).alias("parts"))
    large = not hot.isEmpty()
    small = _once(rows, buckets.where(~is_hot))
    if large:
        split = materialize(rows.join(hot, "key").select("key", "node", "size", "root", "parts"), "split")
        parts = split.select(_part(F.expr("pmod(xxhash64(node), parts)")), "node", "size", "root")
        heads = F.array_distinct(F.array(*(F.min_by(F.struct("node", "size", "root"), F.xxhash64("node", F.lit(k))) for k in range(HEADS))))
        heads = split.groupBy("key", "parts").agg(heads.alias("heads")).select("key", "parts", F.explode("heads").alias("e"))
        heads = heads.withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)"))).select(_part(F.col("part")), "e.node", "e.size", "e.root")
        dealt = materialize(parts.unionByName(heads).distinct(), "dealt")
        small = small.unionByName(_once(dealt, _buckets(dealt)))

    def compared(rows: DataFrame) -> DataFrame:
        dealt = rows.join(sets, "node").select("key", "node", "grams").repartition("key").sortWithinPartitions("key", "node")
        found = materialize(dealt.mapInArrow(giving_back(_links(tenths)), "a long, b long").distinct(), "links")
        return found if edges is None else edges.unionByName(found)

    found = compared(small)
    if large:
        split = split.drop("root")
        known = _with_roots(split, found)
        main = known.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", "count").alias("main"))
        apart = materialize(known.join(main, "key").where("root <> main").select("key", "node", "size", "parts"), "apart")
        if not apart.isEmpty():
            found = found.unionByName(compared(pairs_of_parts(apart, split, max_weight)))
    return found


def _classes(once: DataFrame) -> DataFrame:
    """``key, node, size`` of ``once(node, size, fp)``: nodes whose fingerprints are linked have one key."""
    known = once.where("size > 0").select("fp", "node", "size")
    near = connected_components(simhash.links(materialize(known.select("fp").distinct(), "distinct"), DISTANCE))
    return known.join(near.withColumnRenamed("node", "fp"), "fp", "left").select(F.coalesce("root", "fp").alias("key"), "node", "size")


def _components(
    once: DataFrame, sets_of: Callable[[DataFrame], DataFrame], tenths: int, max_weight: int, classes: DataFrame | None = None
) -> DataFrame:
    """``node, root`` of the links among ``once(node, size, keys)``, and within ``classes(key, node, size)``."""
    bands = _shared(once.select(F.explode("keys").alias("key"), "node", "size"))
    steps = [bands] if classes is None else [_shared(classes), bands]
    sets = sets_of(reduce(DataFrame.unionByName, [s.select("node") for s in steps]).distinct())
    edges = None
    for shared in steps:
        edges = _more_edges(shared, edges, sets, tenths, max_weight)
    return connected_components(edges)


def _grouped(docs: DataFrame, width: int, tenths: int, max_weight: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(table, named)``: the signatures of all texts, and ``node, root, component_id``."""
    table = materialize(signatures(docs, width, id_col, text_col), "signatures")
    once = table.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("size", "fp", "keys")))
    once = materialize(once, "nodes")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """Texts are found again by id; those of nodes with null ids only are sought among these."""
        wanted = materialize(once.join(wanted, "node", "left_semi").select("node", "least"), "wanted")
        named = texts.join(wanted.where("least IS NOT NULL").select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi")
        found = _sets(named, width)
        if not wanted.where("least IS NULL").isEmpty():
            found = found.unionByName(_sets(texts.where("doc_id IS NULL"), width))
        return materialize(found.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("grams").alias("grams")), "sets")

    roots = _components(once, sets_of, tenths, max_weight, _classes(once))
    joined = once.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    joined = materialize(joined, "roots")
    named = joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "root", "component_id")
    return table, named


def near_copies(
    docs: DataFrame, width: int = 5, tenths: int = 8, max_weight: int = MAX_WEIGHT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``node, component_id``: each distinct set of shingles with the smallest id of the
    texts reachable from it by similarities of ``tenths`` / 10 or more.

    Blank texts are copies of each other. If all ids of a component are null, so is its
    ``component_id``.
    """
    return _grouped(docs, width, tenths, max_weight, id_col, text_col)[1].select("node", "component_id")


def keep_first(docs: DataFrame, width: int = 5, tenths: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each component: that of the smallest id,
    and of several texts under that id the one with the least hash.

    Rows whose id is null stay, as they can't be named; of rows with the same id and text
    one stays. Rows of one id whose texts are in different components are told apart.
    """
    table, named = _grouped(docs, width, tenths, MAX_WEIGHT, id_col, text_col)
    firsts = table.join(named, "node").where("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("f"))
    return keep_rows(docs, firsts.select("f.doc_id", "f.h"), id_col, text_col)
