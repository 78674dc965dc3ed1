"""Centroid clustering by shallot search, exact in integers.

Every vector keeps its nearest centroid, the second nearest that it remembers, an upper
bound of its distance to the first and a lower bound of that to all others. When centroids
move, the bounds give way by as much. A vector whose upper bound is below its lower one, or
below half the way from its centroid to the next, stays. The others search: distances to
the two remembered centroids are taken, the scan starts at the closer one and visits the
other centroids in the order of their distance from it, as far as that can still hide one
of the two nearest: a ball whose radius is the distance to the start plus that to the
second nearest so far, and which shrinks with the latter. Bounds and balls are floating
point with a margin; what survives them is compared in integers, ties by number.

A round is a scan without a shuffle: it reads the vectors with their bounds and writes them
with the new ones, as deep as one table is. New centroids come from the sums of the round
before and the vectors that changed their centroid, which integers make exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, map_batches, materialize_at
from .vectors import is_finite, matrix

#: Vectors that a task handles at a time.
BATCH = 4096
#: How much bounds are widened: far more than the rounding of a square root of 63 bits.
MARGIN = 1e-9
_STATE = "vec_id long, x binary, a int, b int, upper double, lower double, was int"


def largest_component(d: int) -> int:
    """The largest absolute component with which all squared distances fit 63 bits."""
    return math.isqrt((2**63 - 1) // d) // 2


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to those of ``c``, in integers."""
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap)


class Centroids:
    """Centroids of a round, their neighbours in order of distance, and how far each moved."""

    def __init__(self, c: np.ndarray, before: np.ndarray | None = None):
        self.c = c
        k = len(c)
        apart = np.sqrt(np.array([squared(np.broadcast_to(row, c.shape), c) for row in c], np.float64)) if k else np.zeros((0, 0))
        self.order = np.argsort(apart, axis=1, kind="stable")
        for i in range(k):  # itself first, whatever else lies on the same spot
            own = self.order[i]
            self.order[i] = np.concatenate([[i], own[own != i]])
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        self.half = self.apart[:, 1] / 2 if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k) if before is None else np.sqrt(squared(c, before).astype(np.float64))
        most = np.sort(self.moved)[::-1][:2]
        first = int(np.argmax(self.moved)) if k else 0
        self.others = np.array([0.0 if k == 1 else most[1] if i == first else most[0] for i in range(k)])


def search(x: np.ndarray, a: np.ndarray, b: np.ndarray, near: Centroids) -> tuple[np.ndarray, ...]:
    """``(a, b, d_a, d_b)``: the nearest and second nearest centroid of each row of ``x`` and
    their squared distances, found from the remembered ``a`` and ``b``."""
    d_a, d_b = squared(x, near.c[a]), squared(x, near.c[b])
    swap = (d_b < d_a) | (d_b == d_a) & (b < a)
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    d_a, d_b = np.where(swap, d_b, d_a), np.where(swap, d_a, d_b)
    start, other = a.copy(), b.copy()
    to_start = np.sqrt(d_a.astype(np.float64))
    ball = (to_start + np.sqrt(d_b.astype(np.float64))) * (1 + MARGIN)
    alive = np.arange(len(x))
    for place in range(1, len(near.c)):
        alive = alive[near.apart[start[alive], place] <= ball[alive]]
        if not len(alive):
            break
        j = near.order[start[alive], place]
        fresh = j != other[alive]  # known already
        at, j = alive[fresh], j[fresh]
        d = squared(x[at], near.c[j])
        best = (d < d_a[at]) | (d == d_a[at]) & (j < a[at])
        next_best = ~best & ((d < d_b[at]) | (d == d_b[at]) & (j < b[at]))
        up = at[best]
        b[up], d_b[up] = a[up], d_a[up]
        a[up], d_a[up] = j[best], d[best]
        up = at[next_best]
        b[up], d_b[up] = j[next_best], d[next_best]
        ball[at] = (to_start[at] + np.sqrt(d_b[at].astype(np.float64))) * (1 + MARGIN)
    return a, b, d_a, d_b


def step(x: np.ndarray, a: np.ndarray, b: np.ndarray, upper: np.ndarray, lower: np.ndarray, near: Centroids) -> tuple[np.ndarray, ...]:
    """``(a, b, upper, lower)`` of the rows of ``x`` after the centroids have moved to ``near``."""
    a, b = a.copy(), b.copy()
    if len(near.c) == 1:
        return np.zeros_like(a), np.zeros_like(b), np.zeros(len(x)), np.full(len(x), np.inf)
    upper = (upper + near.moved[a]) * (1 + MARGIN)
    lower = lower * (1 - MARGIN) - near.others[a] * (1 + MARGIN)
    limit = np.maximum(lower, near.half[a] * (1 - MARGIN))
    open_ = np.flatnonzero(~(upper < limit))
    upper[open_] = np.sqrt(squared(x[open_], near.c[a[open_]]).astype(np.float64)) * (1 + MARGIN)
    open_ = open_[~(upper[open_] < limit[open_])]
    a[open_], b[open_], d_a, d_b = search(x[open_], a[open_], b[open_], near)
    upper[open_] = np.sqrt(d_a.astype(np.float64)) * (1 + MARGIN)
    lower[open_] = np.sqrt(d_b.astype(np.float64)) * (1 - MARGIN)
    return a, b, upper, lower


def _integers(rows: DataFrame, d: int, scale: int) -> DataFrame:
    """``vec_id, x`` with the integer components as bytes."""
    most = largest_component(d)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)
        with np.errstate(over="ignore"):
            v = np.floor(scale * v)
        kept = np.flatnonzero((np.abs(v) <= most).all(axis=1))
        x = v[kept].astype("<i4")
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "x"])

    return map_batches(rows, run, "vec_id long, x binary", BATCH)


def _assign(state: DataFrame, near, d: int) -> DataFrame:
    """One round over the table of ``_STATE``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, upper, lower = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6))
        got = step(matrix(batch.column(1), "<i4", d).astype(np.int64), a, b, upper, lower, near.value)
        cols = [batch.column(0), batch.column(1), *(pa.array(v, t) for v, t in zip(got, (pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)), pa.array(a, pa.int32())]
        return pa.RecordBatch.from_arrays(cols, names=["vec_id", "x", "a", "b", "upper", "lower", "was"])

    return map_batches(state, run, _STATE, BATCH)


def _changes(state: DataFrame, k: int, d: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed their centroid add to the count and sum of each; Spark
    adds up ``k`` times ``d + 1`` numbers, which are all that the driver gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = matrix(batch.column(0), "<i4", d).astype(np.int64)
            x = np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1)
            for column, sign in ((1, 1),) if first else ((1, 1), (2, -1)):
                at = batch.column(column).to_numpy(zero_copy_only=False)
                for c in np.unique(at).tolist():
                    sums[c] = sums.get(c, 0) + sign * x[at == c].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))], names=["c", "s"])

    rows = state.select("x", "a", "was") if first else state.where("a <> was").select("x", "a", "was")
    parts = rows.mapInArrow(run, "c int, s array<long>").select("c", F.posexplode("s").alias("k", "v"))
    count, total = np.zeros(k, object), np.zeros((k, d), object)
    for r in parts.groupBy("c", "k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        if r.k:
            total[r.c, r.k - 1] = int(r.v)
        else:
            count[r.c] = int(r.v)
    return count, total


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, d: int = 64, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``vec_id, cluster int, distance long, cluster_inertia long, inertia long,
    centroid_sha256 string``: k-means of the vectors of ``d`` components, rounded down to
    integers after multiplying by ``scale``.

    Centroids start as the ``k`` vectors (all, if fewer) whose SHA-256 of ``seed:vec_id`` in
    hex is smallest, in that order (ties: smaller id, then bytes). Each of ``rounds`` rounds
    assigns every vector and then moves every centroid that has vectors to their mean, rounded
    down; at last vectors are assigned once more. Rounds end early if no centroid moves, which
    changes nothing.

    Vectors that are null, have another number of components, or hold a null or a number that
    is not finite take no part; neither do those with a component so large that a squared
    distance would not fit a long (``largest_component``; at 64 components, 1.9e8 after
    scaling). Rows of a null id take part but start no centroid. Repeated rows count as often
    as they are there. An inertia that does not fit a long is null. Other columns are ignored.
    Without vectors the result is empty.
    """
    spark = vectors.sparkSession
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    table, path = materialize_at(_integers(rows.where(is_finite("v") & (F.size("v") == d)), d, scale), "vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = table.where("vec_id IS NOT NULL").select(digest.alias("h"), "vec_id", "x").orderBy("h", "vec_id", "x").limit(k).collect()
    if not starts:
        return spark.createDataFrame([], out)
    c = np.array([np.frombuffer(r.x, "<i4") for r in starts], np.int64)
    k = len(c)
    state = table.selectExpr("vec_id", "x", "0 AS a", f"{min(1, k - 1)} AS b", "double('inf') AS upper", "double('-inf') AS lower")
    count, total, before = np.zeros(k, object), np.zeros((k, d), object), None
    for r in range(rounds + 1):
        near = spark.sparkContext.broadcast(Centroids(c, before))
        state, new_path = materialize_at(_assign(state, near, d), "bounds")
        discard(spark, path)
        path = new_path
        if r == rounds:
            break
        more, sums = _changes(state, k, d, first=r == 0)
        count, total, before = count + more, total + sums, c
        c = np.array([[s // n for s in total[j]] if (n := count[j]) else before[j] for j in range(k)], np.int64)
        if np.array_equal(c, before):
            break
    held = spark.sparkContext.broadcast(c)

    def distances(batch: pa.RecordBatch) -> pa.RecordBatch:
        a = batch.column(2).to_numpy(zero_copy_only=False)
        far = squared(matrix(batch.column(1), "<i4", d).astype(np.int64), held.value[a])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    found = map_batches(state.select("vec_id", "x", "a"), distances, "vec_id long, cluster int, distance long", BATCH)
    inertia = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 2**63 else None
    facts = [(j, fits(inertia.get(j, 0)), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for j in range(k)]
    of_each = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of_each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
