"""Near copies among vectors by sorted projection passes.

Equal vectors are one class, with the number of its rows. In a pass every class gets a key
of concatenated random hashes, the signs of its products with random directions, and all
classes are ordered lexicographically by it: Spark sorts them by range. Each is compared
with the ``WINDOW`` classes before it, over the borders of ranges too, and pairs whose
cosine reaches the threshold are united. Near pairs share long beginnings of their keys in
most passes; there are as many passes as a pair right at the threshold needs to come within
a window of each other with the wanted probability, by the number of classes.

Windows find what hangs together, and their bound loses no links: the links of a vector lie
in its component, so they are counted there, exactly, by blocks of the component, without
making the pairs. Members of a large component that lie so close to its mean direction that
any two of them must link are counted without comparing them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import connected_components, map_batches, materialize
from .vectors import as_bytes, common_size, is_finite, join_hot, matrix, unit

#: Classes before it with which each is compared in a pass; bits of a key.
WINDOW, KEY_BITS = 32, 62
#: Passes that are sorted together; the classes are shuffled once for each pass.
TOGETHER = 4
#: Classes of a component that are compared where they stand; of a cell of a larger one.
SMALL_ROWS, CELL_ROWS = 256, 2048
#: Classes that one range of a pass has, about.
RANGE_ROWS = 1 << 16
#: By how much an angle or cosine may be off by rounding.
SLACK = 1e-9


def passes_needed(n: int, threshold: float, recall: float, window: int = WINDOW) -> int:
    """How many passes a pair at the threshold needs to be in one window with probability
    ``recall``: it is, if it agrees on the bits that leave at most ``window`` of ``n`` classes."""
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    once = agree ** max(0.0, math.log2(max(1, n) / window))
    return 1 if once >= recall else math.ceil(math.log(1 - recall) / math.log(1 - once))


def directions(number: int, d: int) -> np.ndarray:
    """The random directions of a pass, the same everywhere."""
    return np.random.default_rng([13, number]).normal(size=(d, KEY_BITS))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of the items 0 ... n-1 that each hangs together with by the pairs ``a, b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[new])
        if np.array_equal(new, root):
            return root
        root = new


def window_pairs(numbers: np.ndarray, x: np.ndarray, threshold: float, window: int, since: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places, at most ``window`` apart and in the same pass, whose vectors reach the
    threshold; the later place is ``since`` or more."""
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for gap in range(1, min(window, len(x) - 1) + 1):
        at = np.arange(max(gap, since), len(x))
        at = at[numbers[at] == numbers[at - gap]]
        at = at[np.einsum("ij,ij->i", x[at], x[at - gap]) >= threshold]
        first.append(at - gap)
        second.append(at)
    return np.concatenate(first), np.concatenate(second)


_SORTED = "number int, key long, node long, v binary"
_FOUND = "a long, b long, number int, v binary, part int, place long, total long"


def _keys(classes: DataFrame, numbers: range, d: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = unit(matrix(batch.column(1), "<f8", d))
        keys = [((x @ directions(k, d) > 0) @ (1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64))).astype(np.int64) for k in numbers]
        order = np.tile(np.arange(len(x)), len(numbers))
        cols = [pa.array(np.repeat(np.array(numbers, np.int32), len(x))), pa.array(np.concatenate(keys)), batch.column(0).take(pa.array(order)), batch.column(1).take(pa.array(order))]
        return pa.RecordBatch.from_arrays(cols, names=["number", "key", "node", "v"])

    return map_batches(classes.select("node", "v"), run, _SORTED)


def _windows(d: int, threshold: float, window: int):
    """Over one range of the sorted classes: what hangs together, as ``a, b``, and the first
    and last ``window`` classes, which the windows over its borders need."""

    def table(a, b, rows, part: int, total: int) -> pa.RecordBatch:
        """Links first, then border rows ``(place, number, node, v)``."""
        n, m = len(a), len(rows)
        none = [None] * n
        cols = [
            pa.array([*a, *(r[2] for r in rows)], pa.int64()),
            pa.array([*b, *[None] * m], pa.int64()),
            pa.array([*none, *(r[1] for r in rows)], pa.int32()),
            pa.array([*none, *(r[3] for r in rows)], pa.binary()),
            pa.array([*none, *[part] * m], pa.int32()),
            pa.array([*none, *(r[0] for r in rows)], pa.int64()),
            pa.array([*none, *[total] * m], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["a", "b", "number", "v", "part", "place", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, nodes, x, raw = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, d)), []
        head, total = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(nodes)
            raw = [*raw, *batch.column(3).to_pylist()]
            numbers = np.concatenate([numbers, batch.column(0).to_numpy()])
            nodes = np.concatenate([nodes, batch.column(2).to_numpy()])
            x = np.concatenate([x, unit(matrix(batch.column(3), "<f8", d))])
            a, b = window_pairs(numbers, x, threshold, window, since=old)
            root = roots(len(nodes), a, b)
            linked = np.flatnonzero(root != np.arange(len(nodes)))
            if len(linked):
                yield table(nodes[linked].tolist(), nodes[root[linked]].tolist(), [], 0, 0)
            fresh = zip(range(total, total + batch.num_rows), numbers[old:].tolist(), nodes[old:].tolist(), raw[old:], strict=True)
            head += [r for r in fresh if r[0] < window]
            total += batch.num_rows
            numbers, nodes, x, raw = numbers[-window:], nodes[-window:], x[-window:], raw[-window:]
        tail = zip(range(total - len(nodes), total), numbers.tolist(), nodes.tolist(), raw, strict=True)
        yield table([], [], [*head, *(r for r in tail if r[0] >= window)], TaskContext.get().partitionId(), total)

    return run


def _borders(totals: list[tuple[int, int]], window: int) -> list[tuple[int, int, bool]]:
    """``(part, border, is_after)`` for the ranges ``(part, rows)``, in order: each range comes
    after the border of its own number, and before it come as many as fill a window."""
    out = []
    for k, (part, _) in enumerate(totals):
        out.append((part, part, True))
        room = window
        for before, rows in reversed(totals[:k]):
            out.append((before, part, False))
            room -= rows
            if room <= 0:
                break
    return out


def _over_borders(rows: DataFrame, d: int, threshold: float, window: int) -> DataFrame:
    """``a, b`` of the pairs in windows over the borders of ranges."""
    totals = sorted((r.part, r.total) for r in rows.select("part", "total").distinct().collect())  # one row for each range
    meet = rows.sparkSession.createDataFrame(_borders(totals, window), "part int, border int, is_after boolean")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        before = group[~group["is_after"]].sort_values(["part", "place"]).iloc[-window:]
        after = group[group["is_after"]].sort_values("place").iloc[:window]
        both = pd.concat([before, after])
        x = unit(np.frombuffer(b"".join(both["v"]), "<f8").reshape(-1, d))
        a, b = window_pairs(both["number"].to_numpy(), x, threshold, window, since=len(before))
        crossing = a < len(before)
        nodes = both["node"].to_numpy(np.int64)
        return pd.DataFrame({"a": nodes[a[crossing]], "b": nodes[b[crossing]]})

    wanted = "is_after AND place < {0} OR NOT is_after AND place >= total - {0}".format(window)
    rows = rows.withColumnRenamed("a", "node").join(F.broadcast(meet), "part").where(wanted)  # a few rows for each range
    return rows.select("border", "is_after", "part", "place", "number", "node", "v").groupBy("border").applyInPandas(run, "a long, b long")


def find_links(classes: DataFrame, n: int, d: int, threshold: float, passes: int, window: int = WINDOW) -> DataFrame:
    """``a, b``: pairs of nodes of ``classes(node, v)`` that hang together by links found."""
    spark = classes.sparkSession
    edges = None
    for k in range(0, passes, TOGETHER):
        numbers = range(k, min(passes, k + TOGETHER))
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * len(numbers) // RANGE_ROWS)
        ordered = _keys(classes, numbers, d).repartitionByRange(ranges, "number", "key", "node").sortWithinPartitions("number", "key", "node")
        found = materialize(ordered.mapInArrow(_windows(d, threshold, window), _FOUND), "windows")
        some = found.where("b IS NOT NULL").select("a", "b").unionByName(_over_borders(found.where("b IS NULL"), d, threshold, window))
        edges = some if edges is None else edges.unionByName(some)
    return edges


def _weighed(x: np.ndarray, y: np.ndarray, weights: np.ndarray, threshold: float) -> np.ndarray:
    """For each row of ``x`` the weights of the rows of ``y`` that it links with."""
    out = np.zeros(len(x), np.int64)
    for k in range(0, len(x), CELL_ROWS):
        for j in range(0, len(y), CELL_ROWS):
            out[k : k + CELL_ROWS] += (x[k : k + CELL_ROWS] @ y[j : j + CELL_ROWS].T >= threshold) @ weights[j : j + CELL_ROWS]
    return out


def _count_small(members: DataFrame, d: int, threshold: float) -> DataFrame:
    """``node, links`` within components of at most ``SMALL_ROWS`` classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            """Of whole components, sorted by root."""
            cols = [np.concatenate([r.column(k).to_numpy() for r in rows]) for k in range(3)]
            x = unit(np.concatenate([matrix(r.column(3), "<f8", d) for r in rows]))
            links = np.zeros(len(x), np.int64)
            starts = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))
            for a, z in zip(starts, np.append(starts[1:], len(x)), strict=True):
                links[a:z] = _weighed(x[a:z], x[a:z], cols[2][a:z], threshold)
            return pa.RecordBatch.from_arrays([pa.array(cols[1]), pa.array(links)], names=["node", "links"])

        for batch in batches:
            if not batch.num_rows:
                continue
            root = batch.column(0).to_numpy()
            cut = int(np.flatnonzero(root == root[-1])[0])  # where the last component begins
            if held and root[0] != held[-1].column(0)[held[-1].num_rows - 1].as_py():
                yield done(held)
                held = []
            if cut:
                yield done([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield done(held)

    rows = members.select("root", "node", "rows", "v").repartition("root").sortWithinPartitions("root")
    return rows.mapInArrow(run, "node long, links long")


def _count_large(members: DataFrame, d: int, threshold: float) -> DataFrame:
    """``node, links`` within larger components, whose members are dealt to parts.

    A member is core if its angle from the mean direction of the component is less than half
    the angle of the threshold: any two of these link. Others meet all parts, part by part.
    """
    spark = members.sparkSession

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            root, x = batch.column(0).to_numpy(), unit(matrix(batch.column(1), "<f8", d))
            for r in np.unique(root).tolist():
                sums[r] = sums.get(r, 0) + x[root == r].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], names=["root", "s"])

    sums = members.select("root", "v").mapInArrow(add_up, "root long, s array<double>").select("root", F.posexplode("s").alias("k", "x"))
    means = sums.groupBy("root", "k").agg(F.sum("x").alias("x")).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("s"))
    means = means.select("root", F.expr("transform(s, e -> e.x)").alias("mean"))  # d numbers each
    sizes = materialize(members.groupBy("root").agg(F.count("*").alias("size")).join(means, "root"), "means")
    half = math.cos(math.acos(threshold) / 2) + SLACK

    def is_core(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = unit(matrix(batch.column(3), "<f8", d))
        m = np.asarray(batch.column(5).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)
        length = np.linalg.norm(m, axis=1)
        core = np.einsum("ij,ij->i", x, m) >= half * np.where(length > 0, length, np.inf)
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(core)], names=["root", "node", "rows", "v", "size", "core"])

    n = members.count()
    known = join_hot(members.select("root", "node", "rows", "v"), sizes.select("root", "size", "mean"), "root", "size", n)
    known = map_batches(known.select("root", "node", "rows", "v", "size", "mean"), is_core, "root long, node long, rows long, v binary, size long, core boolean")
    known = materialize(known, "members")
    cores = known.where("core").groupBy("root").agg(F.sum("rows").alias("core_rows"), F.count("*").alias("core_size"))
    own = join_hot(known.where("core").select("root", "node"), cores, "root", "core_size", n).select("node", F.col("core_rows").alias("links"))
    if known.where("NOT core").isEmpty():
        return own
    # others are dealt to parts too, and each of their parts meets every part of all members
    parts = F.ceil(F.col("size") / CELL_ROWS).cast("int")
    dealt = known.withColumn("parts", parts).withColumn("own", F.expr("cast(pmod(xxhash64(node), parts) AS int)"))
    fringe = known.groupBy("root").agg(F.count("*").alias("size"), F.ceil(F.count_if(~F.col("core")) / CELL_ROWS).cast("int").alias("groups"))
    dealt = join_hot(dealt.drop("size"), materialize(fringe.where("groups > 0"), "fringe"), "root", "size", n)
    asking = dealt.where("NOT core").withColumn("g", F.expr("cast(pmod(xxhash64(node, 1), groups) AS int)")).withColumn("p", F.explode(F.expr("sequence(0, parts - 1)")))
    asked = dealt.withColumn("p", F.col("own")).withColumn("g", F.explode(F.expr("sequence(0, groups - 1)")))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """What the others of one part have, and give to core members, in one cell."""
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "links": []})
        x, y = (unit(np.frombuffer(b"".join(t["v"]), "<f8").reshape(-1, d)) for t in (left, right))
        to_left = _weighed(x, y, right["rows"].to_numpy(np.int64), threshold)
        core = np.flatnonzero(right["core"].to_numpy(bool))
        to_core = _weighed(y[core], x, left["rows"].to_numpy(np.int64), threshold)
        return pd.DataFrame({"node": np.concatenate([left["node"].to_numpy(), right["node"].to_numpy()[core]]), "links": np.concatenate([to_left, to_core])})

    cols = ["root", "g", "p", "node", "rows", "v"]
    met = asking.select(*(F.col(c).alias(c) for c in cols)).groupBy("root", "g", "p").cogroup(asked.select(*cols, "core").groupBy("root", "g", "p")).applyInPandas(meet, "node long, links long")
    return own.unionByName(met).groupBy("node").agg(F.sum("links").alias("links"))


def near_vectors(
    vectors: DataFrame, threshold: float = 0.95, recall: float = 0.99, window: int = WINDOW, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``vec_id, n_links long, component_id long, kept boolean`` for every row.

    ``n_links``: the other rows whose vector has a cosine of at least ``threshold``, in double
    precision; ``component_id``: the smallest id reachable by such links, its own included;
    ``kept``: whether that is its own. ``recall``: of pairs right at the threshold this share
    is in a window of some pass; nearer pairs are in one more often, and all links within a
    component found are counted.

    Vectors that are null, empty, zero, hold a null or a number that is not finite, or whose
    number of components is not the most common (ties: the smaller) link with nothing; nor do
    rows of a null id, which have no component and are kept. Repeated rows link with each
    other. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    good = is_finite("x") & F.expr("coalesce(exists(x, e -> e <> 0), false)") & F.col("vec_id").isNotNull()
    d = common_size(rows.where(good), "x")
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if d is None:
        return alone
    good = good & (F.size("x") == d)
    usable = materialize(rows.where(good).withColumn("v", as_bytes(rows, "x")).select("vec_id", "v"), "vectors")
    classes = usable.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("rows")).withColumn("node", F.monotonically_increasing_id())
    classes = materialize(classes, "classes")
    n = classes.count()
    edges = find_links(classes, n, d, threshold, passes_needed(n, threshold, recall, window), window)
    found = materialize(connected_components(edges), "components")
    sizes = materialize(found.groupBy("root").agg(F.count("*").alias("size")), "sizes")
    within = found.join(classes, "node")  # both once for each node
    named = join_hot(within, sizes, "root", "size", n)
    named = materialize(named, "named")
    small = _count_small(named.where(F.col("size") <= SMALL_ROWS), d, threshold)
    large = named.where(F.col("size") > SMALL_ROWS)
    links = small if large.isEmpty() else small.unionByName(_count_large(large, d, threshold))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    linked = join_hot(named.select("node", "root"), first, "root", "size", n).select("node", "component_id").join(links, "node")
    facts = classes.join(linked, "node", "left").select(
        "v", "rows", (F.coalesce("links", "rows") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")
    )
    facts = materialize(facts, "facts")
    counted = join_hot(usable, facts, "v", "rows", usable.count())
    counted = counted.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    rest = rows.where(~F.coalesce(good, F.lit(False)))
    return counted.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))
