import random

import numpy as np
import pytest
import xxhash

from urlrisk.llm.simhash import block_masks, finer_masks, fingerprints, keep_first, links, near_duplicates


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, pairs):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in nodes}


def test_masks_leave_no_pair_out():
    rng = random.Random(1)
    masks = block_masks()
    assert len(masks) == 10
    for _ in range(300):
        bits = sum(1 << b for b in rng.sample(range(64), 3))
        shared = [m for m in masks if not bits & m]
        assert shared
        while 64 - shared[0].bit_count() > 9:
            shared = [x for x in finer_masks(shared[0]) if not bits & x]
            assert shared


def test_documents(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(7, base), (9, base), (4, base.replace("word150", "other")), (5, "Alone AND short"), (6, "alone and SHORT"), (1, None), (2, ""), (3, " \n\t"), (None, base), (8, "ÉCOLE é x y"), (10, "école é x y")]
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, fp int, component_id int")
    got = near_duplicates(docs).collect()
    fps = {t: brute_fingerprint(t) for _, t in rows}
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by_id[i].fp % (1 << 64) == fps[t] for i, t in rows)
    comp = roots(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[rows[i][1]] ^ fps[rows[j][1]]).bit_count() <= 3])
    for i, (doc, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        assert by_id[doc].component_id == min(members)
    kept = {r.doc_id for r in keep_first(docs).collect()}
    assert kept == {r.component_id for r in got} | {None}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).count() == 0 and keep_first(docs).count() == 0
    assert fingerprints(docs).columns == ["doc_id", "fp"]


@pytest.mark.parametrize("limit", [2048, 8])
def test_links_of_dense_groups(spark, limit):
    """Hot buckets are split again, and the components stay those of all pairs."""
    rng = random.Random(limit)
    centres = [rng.getrandbits(64) for _ in range(5)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(60)}
    values |= {rng.getrandbits(64) for _ in range(50)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = [(r.a, r.b) for r in links(spark.createDataFrame([(v,) for v in signed], "fp long"), max_bucket=limit).collect()]
    arr = np.array(signed, np.int64).view(np.uint64)
    true = [(signed[i], signed[j]) for i in range(len(arr)) for j in np.flatnonzero(np.bitwise_count(arr[:i] ^ arr[i]) <= 3)]
    true_set = {frozenset(p) for p in true}
    # forest edges join the first of a tree to all of it, so they need not be links themselves
    assert roots(signed, found) == roots(signed, true)
    assert len(found) <= 10 * (limit if limit < 100 else 1) * len(signed) and true_set
