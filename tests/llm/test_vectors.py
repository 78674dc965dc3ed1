"""Clustering, hard negatives and near copies of vectors, against brute force in plain Python and numpy."""

import hashlib
import math
import os
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from urlrisk.llm import embedding_copies, hard_negatives, registry
from urlrisk.llm.centroids import Centroids, cluster, search, squared, step
from urlrisk.llm.embedding_copies import WINDOW, _borders, near_vectors, passes_needed, roots
from urlrisk.llm.hard_negatives import mine, packed_scores

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label int"
given_tables = pytest.mark.skipif(not os.path.exists(SF), reason="needs the generated tables")


def table(folder=SF):
    return [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{folder}/embeddings.parquet").to_pylist()]


# -- clustering ---------------------------------------------------------------------------


def lloyd(rows, k=8, rounds=10, scale=1024, d=64):
    """The contract in plain Python integers, without bounds."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), i, x) for i, x in kept if i is not None)
    c = [x for _, _, x in named[:k]]
    dist = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y, strict=True))
    assign = lambda: [min(range(len(c)), key=lambda j: (dist(x, c[j]), j)) for _, x in kept]
    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            own = [x for (_, x), a in zip(kept, at, strict=True) if a == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    at = assign()
    far = [dist(x, c[a]) for (_, x), a in zip(kept, at, strict=True)]
    total = Counter()
    for a, f in zip(at, far, strict=True):
        total[a] += f
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, a, f, total[a], sum(far), sha[a]) for (i, _), a, f in zip(kept, at, far, strict=True)), key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


@given_tables
def test_op11(spark):
    assert found(registry.op11_centroids(spark, SF)) == lloyd(table())


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 3), st.sampled_from([2, 5, 300]))
def test_bounds_change_nothing(seed, k, d, spread):
    """Moves of centroids, ties among them, and centroids on one spot: as a full search."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, (80, d))
    c = rng.integers(-spread, spread + 1, (k, d))
    a, b = np.zeros(80, np.int64), np.full(80, min(1, k - 1))
    upper, lower, before = np.full(80, np.inf), np.full(80, -np.inf), None
    for _ in range(6):
        near = Centroids(c, before)
        a, b, upper, lower = step(x, a, b, upper, lower, near)
        d_all = np.array([squared(x, np.broadcast_to(row, x.shape)) for row in c])
        assert (a == d_all.argmin(axis=0)).all()
        if k > 1:
            best, second, d_a, d_b = search(x, a, b, near)
            order = np.argsort(d_all, axis=0, kind="stable")
            assert (best == order[0]).all() and (second == order[1]).all() and (d_a == d_all.min(axis=0)).all() and (d_b == np.sort(d_all, axis=0)[1]).all()
        before, c = c, c + rng.integers(-2, 3, c.shape) * (rng.random((k, 1)) < 0.6)


def test_clustering_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(60, 4)), 1).tolist()
    nan, inf = float("nan"), float("inf")
    rows = [(i, v) for i, v in enumerate(x)] + [(5, x[5]), (5, x[5]), (5, [9.0] * 4), (None, x[0]), (None, [0.25] * 4)]
    odd = [(100, None), (101, []), (102, [1.0] * 3), (103, [nan] * 4), (104, [inf] * 4), (105, [None, 1.0, 1.0, 1.0]), (106, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, cluster int, x string")
    for k, rounds in ((3, 10), (8, 2), (1, 4), (200, 3), (5, 0)):
        assert found(cluster(df, k=k, rounds=rounds, d=4)) == lloyd(rows, k, rounds, d=4)
    huge = spark.createDataFrame([(1, [1e300] * 4), (2, [1.0] * 4)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in cluster(huge, d=4).collect()] == [2]
    assert cluster(df.limit(0)).count() == 0 and cluster(df.where("vec_id > 99"), d=4).count() == 0
    same = spark.createDataFrame([(i, [1.0] * 4) for i in range(20)], "vec_id long, embedding array<double>")
    assert found(cluster(same, k=3, d=4)) == lloyd([(i, [1.0] * 4) for i in range(20)], 3, d=4)


# -- hard negatives -----------------------------------------------------------------------


def mined(rows, every=100, n_pos=5, n_neg=5, low=80, high=100, scale=256):
    use = sorted({(i, y, tuple(math.floor(scale * x) for x in v)) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)})
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    out = []
    for i, y, v in (r for r in use if r[0] % every == 0):
        scored = sorted((-dot(v, w), j, z) for j, z, w in use if j != i)
        for s, j, _ in [r for r in scored if r[2] == y][:n_pos]:
            fit = [(-t, n) for t, n, z in scored if z != y and low * -s <= 100 * -t <= high * -s][:n_neg]
            out += [(i, j, k, n, -s, t) for k, (t, n) in enumerate(fit, 1)]
    return sorted(out)


def relabelled(rows):
    return [(i, v, y if y is None or i is None or i % 7 else (y + 1) % 10) for i, v, y in rows]


@given_tables
def test_op12(spark):
    want = mined(relabelled(table()))
    got = registry.op12_hard_negatives(spark, SF).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 9), st.integers(0, 9), st.integers(1, 70), st.sampled_from([0, 1, 3, 300, 70_000, 2**27]))
def test_packed_scores_are_exact(seed, n, m, d, most):
    rng = np.random.default_rng(seed)
    a, c = (rng.integers(-most, most + 1, (k, d)) for k in (n, m))
    assert (packed_scores(a, c) == a @ c.T).all()


def test_mining_in_many_cells(spark, monkeypatch):
    """Ties, negative scores, crowds of equal vectors, odd rows; the same whatever the cells."""
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(300, 3)), 1)
    v[40:90] = v[40]
    rows = [(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(v, rng.integers(0, 3, 300), strict=True))]
    rows += [(7, rows[7][1], rows[7][2]), (-10, [1.0, 1.0, 0.0], 1), (500, [0.0] * 3, 2)]
    nan, inf = float("nan"), float("inf")
    odd = [(1000, None, 1), (1010, [], 1), (1020, [nan] * 3, 1), (1030, [inf] * 3, 1), (1040, [1.0] * 3, None), (None, [1.0] * 3, 1), (1050, [None, 1.0, 1.0], 1)]
    df = spark.createDataFrame([(*r, 9) for r in rows + odd + [(1060, [1.0] * 4, 1), (1070, [1e30] * 3, 1)]], SCHEMA + ", rank int")
    want = mined(rows, every=10)
    assert len(want) > 200
    for anchors, candidates, scores in ((4096, 8192, 1 << 21), (5, 20, 30)):
        monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", anchors)
        monkeypatch.setattr(hard_negatives, "CANDIDATE_ROWS", candidates)
        monkeypatch.setattr(hard_negatives, "BLOCK_SCORES", scores)
        assert sorted(map(tuple, mine(df, "id % 10 = 0").collect())) == want
    assert mine(df.limit(0), "true").count() == mine(df, "false").count() == mine(df.where("vec_id >= 1000"), "true").where("anchor_id < 1060").count() == 0


# -- near copies --------------------------------------------------------------------------


def linked(rows, threshold=0.95):
    """``vec_id, n_links, component_id, kept`` by all pairs."""
    use = [k for k, (i, v, *_) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.array([rows[k][1] for k in use], float).reshape(len(use), -1 if use else 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    low = {k: rows[k][0] for k in range(len(rows))}
    while True:
        new = {k: min(low[use[j]] for j in np.flatnonzero(near[p])) for p, k in enumerate(use)}
        if all(new[k] == low[k] for k in use):
            break
        low |= new
    links = {k: int(near[p].sum()) - 1 for p, k in enumerate(use)}
    return sorted(((r[0], links.get(k, 0), low[k], r[0] is None or r[0] == low[k]) for k, r in enumerate(rows)), key=str)


def planted(rng, n, d, groups, noise):
    x = rng.normal(size=(n, d))
    at = 0
    for size in groups:
        x[at : at + size] = x[at] / np.linalg.norm(x[at]) + noise * rng.normal(size=(size, d)) / math.sqrt(d)
        at += size
    return x[rng.permutation(n)]


@given_tables
def test_op13(spark):
    assert found(registry.op13_near_vectors(spark, SF)) == linked(table())


def test_copies_equal_all_pairs(spark, monkeypatch):
    """Groups below and above the sizes of windows and cells, equal, scaled and odd vectors."""
    rng = np.random.default_rng(5)
    x = planted(rng, 1200, 16, [150, 60, 30, 10, 5, 2, 2, 2, 2], 0.15).tolist()
    nan, inf = float("nan"), float("inf")
    rows = [(i, v) for i, v in enumerate(x)] + [(2000 + k, x[7]) for k in range(80)] + [(7, x[7]), (7, [2 * e for e in x[7]]), (3000, [-e for e in x[7]]), (-4, [1e300 * e for e in x[9]])]
    odd = [(4000, None), (4001, []), (4002, [nan] * 16), (4003, [inf] * 16), (4004, [None] * 16), (4005, [0.0] * 16), (None, x[3])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, node int")
    scaled = [(i, [e / 1e300 for e in v] if i == -4 else v) for i, v in rows]
    want = linked(scaled + odd)
    assert max(w[1] for w in want) > 80 and len({w[2] for w in want if w[1]}) > 8
    assert found(near_vectors(df)) == want
    for name in ("SMALL_ROWS", "CELL_ROWS"):
        monkeypatch.setattr(embedding_copies, name, 20)
    assert found(near_vectors(df)) == want
    assert near_vectors(df.limit(0)).count() == 0
    assert found(near_vectors(df.where("vec_id BETWEEN 4000 AND 4005"))) == linked(odd[:6])


def test_core_and_fringe_of_large_components(spark, monkeypatch):
    """A chain, whose ends don't link, and a tight group with a few members far out."""
    for name in ("SMALL_ROWS", "CELL_ROWS"):
        monkeypatch.setattr(embedding_copies, name, 16)
    rng = np.random.default_rng(6)
    chain = [[math.cos(a), math.sin(a), 0.0, 0.0] for a in np.linspace(0, 1.5, 90)]
    tight = np.array([0, 0, 1.0, 0]) + 0.04 * rng.normal(size=(120, 4))
    tight[:9] += 0.25 * rng.normal(size=(9, 4))
    rows = [(k, list(v)) for k, v in enumerate([*chain, *tight.tolist()])]
    assert found(near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == linked(rows)


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine just above the threshold, each alone, among many other vectors."""
    rng = np.random.default_rng(7)
    n, d = 3000, 32
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(400, d))
    y -= (y * x[:400]).sum(axis=1, keepdims=True) * x[:400]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    pairs = 0.9501 * x[:400] + math.sqrt(1 - 0.9501**2) * y
    rows = [(i, v) for i, v in enumerate([*x.tolist(), *pairs.tolist()])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("n_links > 0").collect()
    assert {r.component_id for r in got} <= set(range(400)) and all(r.n_links == 1 for r in got)
    assert len(got) >= 0.97 * 800


def test_windows_over_borders():
    assert _borders([(0, 5), (2, 1), (3, 9)], 4) == [(0, 0, True), (2, 2, True), (0, 2, False), (3, 3, True), (2, 3, False), (0, 3, False)]
    assert roots(6, np.array([4, 3, 1]), np.array([3, 5, 0])).tolist() == [0, 0, 2, 3, 3, 3]
    assert passes_needed(WINDOW, 0.95, 0.99) == 1 and passes_needed(10**9, 0.95, 0.99) > passes_needed(10**5, 0.95, 0.99) > 5


def test_few_rows_in_many_ranges(spark):
    """Ranges of fewer rows than a window, so that windows reach over several borders."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        rng = np.random.default_rng(8)
        rows = [(k, v) for k, v in enumerate(planted(rng, 30, 5, [7, 4, 3], 0.2).tolist())]
        assert found(near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == linked(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
