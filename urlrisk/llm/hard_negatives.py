"""Hard negatives by exact integer scores from Kronecker-packed products.

Components are integers. Those of several candidates are biased to be non-negative and put
into separate fields of one wide integer, each field wide enough for a whole inner product;
an anchor's component is then multiplied once for all of them, the products are summed over
the components, and the fields of the sum are the scores of all these candidates, from which
the biases are taken off. Wide integers of up to 53 bits are held in doubles, which are exact
up to there, so a block of anchors and a block of candidates is one matrix product; blocks
whose components leave no room for a field in 53 bits use integers of any width.

Anchors and candidates are dealt by hash into groups of a bounded size, and every group of
anchors meets every group of candidates in one cell, which keeps the best few for each
anchor: first its positives, then, between the limits that these set, its negatives.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize
from .vectors import common_size, is_finite

#: Anchors and candidates of a cell, about; scores of a cell that are in memory at a time.
ANCHOR_ROWS, CANDIDATE_ROWS, BLOCK_SCORES = 4096, 8192, 1 << 21
#: Bits of a wide integer in a double, and fields of one of any width.
DOUBLE_BITS, OPEN_FIELDS = 53, 16


def largest_component(d: int) -> int:
    """The largest absolute component with which a hundred times any score fits 63 bits."""
    return math.isqrt((2**63 - 1) // (100 * d))


def packed_scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The inner products of the rows of two integer matrices, exactly."""
    (n, d), m = anchors.shape, len(candidates)
    if not n or not m:
        return np.zeros((n, m), np.int64)
    bias_a, bias_c = max(0, -int(anchors.min())), max(0, -int(candidates.min()))
    a, c = anchors + bias_a, candidates + bias_c
    bits = max(1, (d * int(a.max()) * int(c.max())).bit_length())  # of a field
    fields = DOUBLE_BITS // bits or OPEN_FIELDS
    kind = np.float64 if bits <= DOUBLE_BITS else object
    wide = np.zeros((-(-m // fields), d), kind)
    for k in range(min(fields, m)):
        part = c[k::fields].astype(kind)
        wide[: len(part)] += part * kind_of(1 << k * bits, kind)
    sums = a.astype(kind) @ wide.T
    sums = sums.astype(np.int64) if kind is np.float64 else sums
    out = np.empty((n, m), np.int64)
    for k in range(min(fields, m)):
        field = (sums[:, : len(c[k::fields])] >> k * bits) & ((1 << bits) - 1)
        # sum (a - x)(c - y) = sum ac - y sum a - x sum c + dxy, with biases x and y
        field = field - bias_c * a.sum(axis=1).astype(field.dtype)[:, None] - bias_a * c[k::fields].sum(axis=1).astype(field.dtype)[None, :] + d * bias_a * bias_c
        out[:, k::fields] = field.astype(np.int64)
    return out


def kind_of(x: int, kind: type):
    return float(x) if kind is np.float64 else x


def _rows(column: pd.Series, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i4").reshape(-1, d).astype(np.int64)


def _blocks(n: int, m: int):
    """Slices of ``n`` anchors whose scores of ``m`` candidates fit in memory."""
    size = max(1, BLOCK_SCORES // max(1, m))
    return (slice(k, k + size) for k in range(0, n, size))


def _positives(n_wanted: int, d: int):
    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The best candidates of the same label for each anchor of a cell."""
        right = right.sort_values("id", kind="stable")
        found: list[tuple[np.ndarray, ...]] = []
        for label, own in left.groupby("label"):
            same = right[right["label"] == label]
            ids, x, a = same["id"].to_numpy(np.int64), _rows(same["x"], d), _rows(own["x"], d)
            keys, own_ids = own["anchor"].to_numpy(np.int64), own["id"].to_numpy(np.int64)
            for part in _blocks(len(a), len(x)):
                scores = packed_scores(a[part], x)
                for i, (key, own_id, row) in enumerate(zip(keys[part], own_ids[part], scores, strict=True)):
                    others = np.flatnonzero(ids != own_id)
                    if len(others) > n_wanted:  # with what ties with the last
                        last = np.partition(row[others], len(others) - n_wanted)[len(others) - n_wanted]
                        others = others[row[others] >= last]
                    others = others[np.argsort(-row[others], kind="stable")][:n_wanted]  # candidates stand in the order of ids
                    found.append((np.full(len(others), key), ids[others], row[others]))
        cols = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3)]
        return pd.DataFrame(dict(zip(("anchor", "positive_id", "positive_score"), cols, strict=True)))

    return cell


def _negatives(n_wanted: int, low: int, high: int, d: int):
    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """For each anchor of a cell and each of its positives, the best candidates of
        another label between the positive's limits."""
        right = right.sort_values("id", kind="stable")
        ids, labels, x = right["id"].to_numpy(np.int64), right["label"].to_numpy(np.int64), _rows(right["x"], d)
        a, own_labels = _rows(left["x"], d), left["label"].to_numpy(np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        for part in _blocks(len(a), len(x)):
            scores = packed_scores(a[part], x)
            every = zip(left["anchor"].to_numpy(np.int64)[part], own_labels[part], left["positives"].iloc[part], left["heights"].iloc[part], scores, strict=True)
            for key, label, positives, heights, row in every:
                limits = [(p, h, -(-low * h // 100), high * h // 100) for p, h in zip(map(int, positives), map(int, heights), strict=True)]
                near = np.flatnonzero((row >= min(x[2] for x in limits)) & (row <= max(x[3] for x in limits)) & (labels != label))
                near = near[np.argsort(-row[near], kind="stable")]
                falling = -row[near]
                for positive_id, score, least, most in limits:
                    first = np.searchsorted(falling, -most)
                    some = near[first : min(first + n_wanted, np.searchsorted(falling, -least, side="right"))]
                    found.append((np.full(len(some), key), np.full(len(some), positive_id), np.full(len(some), score), ids[some], row[some]))
        names = ("anchor", "positive_id", "positive_score", "negative_id", "negative_score")
        cols = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(5)]
        return pd.DataFrame(dict(zip(names, cols, strict=True)))

    return cell


def mine(
    rows: DataFrame,
    is_anchor: str,
    n_positives: int = 5,
    n_negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank int, negative_id, positive_score, negative_score``.

    The score of two rows is the inner product of their components, rounded down to integers
    after multiplying by ``scale``; higher ones come first, ties by the smaller id. An
    anchor, a row for which the SQL condition ``is_anchor`` on ``id`` holds, has as positives
    its first ``n_positives`` rows of another id and the same label. For each of them the
    first ``n_negatives`` rows of another label are returned whose score is at least ``low``
    and at most ``high`` percent of the positive's.

    Rows take no part if their id, label or vector is null, the vector is empty or holds a
    null or a number that is not finite, its number of components is not the most common
    (ties: the smaller), or a component is so large that a score would not fit
    (``largest_component``; at 64 components 3.8e7 after scaling). Rows that are equal in id,
    label and vector count once; different rows of one id are rows of their own, and none is
    the other's positive (of two positives with the same id and score one counts). Other columns are ignored; without rows the result is empty.
    """
    spark = rows.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    usable = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = usable.where("id IS NOT NULL AND label IS NOT NULL").where(is_finite("v"))
    d = common_size(usable, "v")
    if d is None:
        return spark.createDataFrame([], out)
    most = largest_component(d)

    @F.pandas_udf("binary")
    def integers(vectors: pd.Series) -> pd.Series:
        def one(v):
            with np.errstate(over="ignore"):
                x = np.floor(scale * np.asarray(v, np.float64))
            return x.astype("<i4").tobytes() if (np.abs(x) <= most).all() else None

        return vectors.map(one)

    table = usable.where(F.size("v") == d).select("id", "label", integers("v").alias("x")).where("x IS NOT NULL").distinct()
    table = materialize(table, "candidates")
    anchors = table.where(is_anchor).withColumn("anchor", F.xxhash64("id", "label", "x"))
    n_anchors, n_rows = anchors.count(), table.count()
    if not n_anchors:
        return spark.createDataFrame([], out)
    p, q = -(-n_anchors // ANCHOR_ROWS), -(-n_rows // CANDIDATE_ROWS)
    deal = lambda seed, n: F.pmod(F.xxhash64("id", "x", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def cells(asking: DataFrame, run, schema: str) -> DataFrame:
        """``run`` on each cell; every anchor goes to ``q`` cells, every candidate to ``p``."""
        left = asking.withColumn("p", deal(1, p)).withColumn("q", every(q))
        right = table.withColumn("q", deal(2, q)).withColumn("p", every(p))
        return left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(run, schema)

    found = cells(anchors, _positives(n_positives, d), "anchor long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= n_positives)
    found = found.groupBy("anchor").agg(F.collect_set(F.struct("positive_id", "positive_score")).alias("p"))  # at most n_positives
    found = found.select("anchor", F.expr("transform(p, x -> x.positive_id)").alias("positives"), F.expr("transform(p, x -> x.positive_score)").alias("heights"))
    asking = materialize(anchors.join(found, "anchor"), "anchors")
    schema = "anchor long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = cells(asking, _negatives(n_negatives, low, high, d), schema)
    first = Window.partitionBy("anchor", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n_negatives)
    named = asking.select("anchor", F.col("id").alias("anchor_id"))
    return found.join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
