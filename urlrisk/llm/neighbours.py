"""Approximate nearest neighbours: a forest of random-projection trees.

Each inner node of a tree projects on a random direction and splits at the median of a
bounded sample; the tree grows until a leaf is expected to hold ``leaf_rows`` of all
vectors. A query walks all trees with one shared priority queue: it takes the node whose
split lies nearest among all trees, until it has taken ``n_leaves`` leaves. How many
that takes depends on the data (vectors without clusters need a large share of all), so
it is measured: for a bounded set of vectors the true neighbours are found by brute
force, and the count is the least with which the queue reaches ``recall`` of them.
Queries and vectors then meet by leaf. One matrix product in single precision leaves the
few that can be among the best; these are ranked by their exact cosine, so a leaf gives
each query no more than it can need, however many vectors are nearly equal. The best of
each leaf are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import map_batches, materialize

#: Rows on which the directions and split points are fitted; every row is indexed.
SAMPLE_ROWS = 40_000
#: Vectors whose neighbours are found by brute force to set the number of leaves.
TRIAL_ROWS = 64
#: Vectors, and queries, that one task has of a leaf: larger leaves are dealt to several.
GROUP_ROWS = 50_000
#: Sampled vectors in a leaf at least: this bounds the size of the forest.
LEAF_SAMPLE = 16


@dataclass(frozen=True)
class Forest:
    """Trees in heap order: node i of a tree has the children 2i+1 and 2i+2."""

    depth: int
    directions: np.ndarray  # tree, node, dimension
    splits: np.ndarray  # tree, node

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf number of each row of ``x`` in each tree."""
        out = np.zeros((len(x), len(self.splits)), np.int64)
        for a in range(0, len(x), 1000):
            part, at = x[a : a + 1000], out[a : a + 1000]
            for t in range(len(self.splits)):
                node = np.zeros(len(part), np.int64)
                for _ in range(self.depth):
                    side = (self.directions[t, node] * part).sum(axis=1) > self.splits[t, node]
                    node = 2 * node + 1 + side
                at[:, t] = node
        return out - (2**self.depth - 1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """As ``leaves``, with another range of numbers for each tree."""
        return self.leaves(x) + np.arange(len(self.splits), dtype=np.int64) * 2**self.depth

    def walk(self, q: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf) of all leaves in the order of the shared queue. A node's priority is
        the worst margin on the way to it, the best first."""
        first = 2**self.depth - 1
        queue = [(-np.inf, t, 0) for t in range(len(self.splits))]
        heapq.heapify(queue)
        while queue:
            worst, t, node = heapq.heappop(queue)
            while node < first:
                margin = float(self.directions[t, node] @ q - self.splits[t, node])
                near, far = (2 * node + 2, 2 * node + 1) if margin > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(worst, abs(margin)), t, far))
                node = near
            yield t, node - first

    def search(self, q: np.ndarray, n_leaves: int) -> list[tuple[int, int]]:
        """(tree, leaf) of the ``n_leaves`` leaves that the shared queue gives first."""
        return list(islice(self.walk(q), n_leaves))


def fit_forest(sample: np.ndarray, trees: int, depth: int, seed: int = 42) -> Forest:
    """Directions join two sampled points of the node (random ones where it has under
    two); a node splits at the median of its sample, an empty one at its parent's."""
    rng = np.random.default_rng(seed)
    d, inner = sample.shape[1], 2**depth - 1
    directions, splits = np.zeros((trees, inner, d), np.float32), np.zeros((trees, inner), np.float32)
    for t in range(trees):
        members = {0: np.arange(len(sample))}
        for node in range(inner):
            own = members.pop(node)
            w = rng.normal(size=d)
            if len(own) > 1:
                a, b = rng.choice(own, 2, replace=False)
                gap = sample[a] - sample[b]
                if np.any(gap):
                    w = gap
            w = (w / np.linalg.norm(w)).astype(np.float32)
            at = sample[own] @ w
            cut = np.float32(np.median(at)) if len(own) else np.float32(0)
            directions[t, node], splits[t, node] = w, cut
            if 2 * node + 1 < inner:
                members[2 * node + 1], members[2 * node + 2] = own[at <= cut], own[at > cut]
    return Forest(depth, directions, splits)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _leaves_needed(classes: DataFrame, forest: Forest, held, trial: np.ndarray, k: int, recall: float, d: int) -> int:
    """The least number of leaves with which the queue finds ``recall`` of the true ``k``
    neighbours of the ``trial`` vectors, themselves left out."""
    trial = _unit(trial)
    asked = classes.sparkSession.sparkContext.broadcast(trial)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of a task for each trial vector, with their leaves."""
        top = [[] for _ in asked.value]
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column(0), d))
            cos = asked.value @ unit.T
            cos[cos > 1 - 1e-6] = -2  # the vector itself
            near = np.argsort(-cos, axis=1)[:, :k]
            codes = held.value.codes(unit[near.ravel()]).reshape(*near.shape, -1)
            for q, row in enumerate(near):
                more = [(float(cos[q, j]), codes[q, r].tolist()) for r, j in enumerate(row) if cos[q, j] > -2]
                top[q] = sorted([*top[q], *more], key=lambda x: -x[0])[:k]
        rows = [(q, c, codes) for q, found in enumerate(top) for c, codes in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
            names=["q", "cos", "codes"],
        )

    found = classes.select("v").mapInArrow(best, "q int, cos double, codes array<long>")
    w = Window.partitionBy("q").orderBy(F.desc("cos"))
    found = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).collect()
    wanted: dict[int, list[set[int]]] = {}
    for r in found:
        wanted.setdefault(r.q, []).append(set(r.codes))
    need = []
    for q, left in wanted.items():  # walk until every neighbour has been met in some tree
        for i, (t, leaf) in enumerate(forest.walk(trial[q]), 1):
            code = t * 2**forest.depth + leaf
            met = [codes for codes in left if code in codes]
            need += [i] * len(met)
            left = [codes for codes in left if code not in codes]
            if not left:
                break
    need.sort()
    return max(len(forest.splits), need[int(np.ceil(recall * len(need))) - 1] if need else 1)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    trees: int = 16,
    leaf_rows: int = 512,
    recall: float = 0.95,
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank int, vec_id, score double``: the ``k`` vectors of largest cosine found
    for each row of ``queries``, its own id left out, ties to the smaller id.

    Both tables have ``id_col long`` and ``vector_col array``. Vectors that are null, empty,
    zero, hold a null or a number that is not finite, or whose dimension is not the most
    common one (ties: the smaller) take no part, nor do rows of a null id. Rows of the same
    id and vector count once. Equal vectors are one class: it is indexed once, and its
    ``k + 1`` smallest ids stand for it, of which no query can need more.
    """
    spark = vectors.sparkSession
    #: Vectors are carried as they are given: those of floats fill half the room.
    exact = "<f4" if all(df.schema[vector_col].dataType.elementType.typeName() == "float" for df in (vectors, queries)) else "<f8"

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        df = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND size(v) > 0")
        return df.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <> double('inf'))").where("exists(v, x -> x <> 0)")

    out = "query_id long, rank int, vec_id long, score double"
    own = usable(vectors)
    dims = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], out)
    d = dims.d
    # all rows of one vector: their k + 1 smallest ids, from partial sets of each task
    same = own.where(F.size("v") == d).distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    ranked = same.withColumn("r", F.row_number().over(Window.partitionBy("v", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = ranked.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    classes = classes.select(F.monotonically_increasing_id().alias("rep"), F.col("ids")[0].alias("least"), "ids", "v")
    classes = materialize(classes, "vectors")
    n = classes.count()
    share = min(1.0, sample_rows / n)
    picked = classes.where(F.pmod(F.xxhash64("least"), F.lit(1_000_000)) < int(1_000_000 * share) + 1).select("v").limit(2 * sample_rows)
    x = np.array([r.v for r in picked.toLocalIterator()] or [classes.first().v], np.float64)
    depth = int(np.clip(np.ceil(np.log2(max(1, n / leaf_rows))), 0, np.floor(np.log2(max(1, len(x) / LEAF_SAMPLE)))))
    forest = fit_forest(x / np.linalg.norm(x, axis=1, keepdims=True), trees, depth)
    held = spark.sparkContext.broadcast(forest)
    n_leaves = _leaves_needed(classes, forest, held, x[: TRIAL_ROWS * (len(x) // TRIAL_ROWS or 1) : len(x) // TRIAL_ROWS or 1], k, recall, d)

    def raw(x: np.ndarray) -> pa.Array:
        return pa.array([row.tobytes() for row in x.astype(exact)], pa.binary())

    def index(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch.column(2), d)
        codes = held.value.codes(_unit(x))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw(x), pa.array(codes.tolist(), pa.list_(pa.int64()))], names=["rep", "least", "v", "codes"])

    def probe(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch.column(1), d)
        codes = [[t * 2**depth + leaf for t, leaf in held.value.search(row, n_leaves)] for row in _unit(x)]
        return pa.RecordBatch.from_arrays([batch.column(0), raw(x), pa.array(codes, pa.list_(pa.int64()))], names=["id", "v", "codes"])

    indexed = materialize(map_batches(classes.select("rep", "least", "v"), index, "rep long, least long, v binary, codes array<long>"), "indexed")
    asked = usable(queries).where(F.size("v") == d).distinct()
    asked = materialize(map_batches(asked, probe, "id long, v binary, codes array<long>"), "asked")
    # a crowded leaf's vectors are dealt to several parts and so are its queries, and each part meets each
    leaves, asked = indexed.select("rep", "least", "v", F.explode("codes").alias("code")), asked.select("id", "v", F.explode("codes").alias("code"))
    parts = leaves.groupBy("code").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("v_parts"))
    parts = parts.join(asked.groupBy("code").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("q_parts")), "code")
    parts = materialize(parts, "parts")  # one row for each leaf that is asked for, at most trees * 2**depth
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    leaves = leaves.join(F.broadcast(parts), "code").withColumn("vp", deal("rep", "v_parts")).withColumn("qp", every("q_parts"))
    asked = asked.join(F.broadcast(parts.toDF("code", "vs", "qs")), "code").withColumn("qp", deal("id", "qs")).withColumn("vp", every("vs"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The best ``k + 1`` classes of a leaf for each query that came to it (ties: the smaller id)."""
        found = []
        if len(left) and len(right):
            right = right.sort_values(["least", "rep"])
            m, asks = (np.frombuffer(b"".join(t["v"]), exact).reshape(-1, d).astype(np.float64) for t in (right, left))
            sizes = np.sqrt((m * m).sum(axis=1))
            near = _unit(m)
            want = min(k + 1, len(m))
            for a in range(0, len(asks), 512):
                cos = _unit(asks[a : a + 512]) @ near.T
                # what ties, within single precision, with the last that is wanted comes along
                last = np.partition(cos, len(m) - want, axis=1)[:, len(m) - want]
                for i, (row, least) in enumerate(zip(cos, last, strict=True), a):
                    at = np.flatnonzero(row >= least - 2e-6)
                    score = (m[at] * asks[i]).sum(axis=1) / (sizes[at] * np.sqrt((asks[i] * asks[i]).sum()))
                    best = np.argsort(-score, kind="stable")[:want]
                    found.append((np.full(len(best), left["id"].iloc[i]), at[best], score[best]))
        ids, at, score = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3))
        cols = {c: right[c].to_numpy()[at] if len(at) else [] for c in ("rep", "least")}
        return pd.DataFrame({"query_id": ids, **cols, "score": score})

    sides = asked.select("code", "vp", "qp", "id", "v").groupBy("code", "vp", "qp"), leaves.select("code", "vp", "qp", "rep", "least", "v").groupBy("code", "vp", "qp")
    met = sides[0].cogroup(sides[1]).applyInPandas(meet, "query_id long, rep long, least long, score double").distinct()
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "least", "rep")
    met = met.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    scored = met.join(classes.select("rep", "ids"), "rep").select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id").distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
