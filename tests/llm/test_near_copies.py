import os
import random
from collections import Counter, defaultdict

import pytest

from urlrisk.llm import near_copies as nc
from urlrisk.llm import simhash
from urlrisk.llm.near_copies import MAX_WEIGHT, keep_first, near_copies

SF = "/root/testdata/sf0.1"


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 5 else {tuple(words)} if words else set()


def first_of_components(rows):
    """Smallest ids of the components of all pairs with J >= 0.8, by brute force."""
    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    return {min(d for k, (d, _) in enumerate(rows) if find(k) == r) for r in {find(k) for k in range(len(rows))}}


def texts(seed, groups, size):
    """Groups of edited texts, with similarities on both sides of the limit."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(rng.choice([40, 120, 400]))]
        for _ in range(size):
            words = list(base)
            for at in rng.sample(range(len(words)), rng.randint(0, max(1, len(words) // 40))):
                words[at] = f"x{rng.randrange(10**9)}"
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return rows


def linked_pairs(sets, tenths=8):
    """All pairs of ``sets`` with a Jaccard similarity of ``tenths`` / 10 or more: two such sets share one of
    the rarest members of each, as many as can be missing and one more."""
    holders = Counter(g for s in sets for g in s)
    index, out = defaultdict(list), []
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        s = sorted(sets[i], key=lambda g: (holders[g], g))
        prefix = s[: len(s) - -(-tenths * len(s) // 10) + 1]
        for j in {j for g in prefix for j in index[g]}:
            both = len(sets[i] & sets[j])
            if 10 * both >= tenths * (len(sets[i]) + len(sets[j]) - both):
                out.append((i, j))
        for g in prefix:
            index[g].append(i)
    return out


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the generated tables")
def test_recall_on_a_larger_table(spark):
    """The texts of sf0.1, many with an edited copy of a similarity around the limit: of all linked pairs, by an
    exact join, nearly all are in one component, and nothing else is."""
    rng = random.Random(10)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for t in texts[:4000]:
        words = (t or "").split()
        if 60 <= len(words) <= 600:
            share = rng.choice([0.005, 0.015, 0.02, 0.022, 0.025, 0.04])
            texts.append(" ".join(f"w{rng.randrange(10**9)}" if rng.random() < share else w for w in words))
    ids = {}
    for i, t in enumerate(texts):
        ids.setdefault(frozenset(grams(t)), i)
    sets, nodes = list(ids), [nc._node(nc.shingles(texts[i])) for i in ids.values()]
    pairs = linked_pairs(sets)
    found = {r.node: r.component_id for r in near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert set(found) == set(nodes) and len(pairs) > 1000
    assert sum(found[nodes[i]] == found[nodes[j]] for i, j in pairs) >= 0.999 * len(pairs)
    together = defaultdict(set)
    for i, j in pairs:
        together[found[nodes[i]]].update((i, j))
    assert all(n == 1 or len(together[c]) == n for c, n in Counter(found.values()).items())


@pytest.mark.parametrize("limit", [MAX_WEIGHT, 20_000])
def test_components_equal_brute_force(spark, limit):
    rows = [(i * 3 + 1, t) for i, t in enumerate([*texts(1, 8, 30), "Alone AND short", "alone and SHORT", "", " \n", None, "ÉCOLE é x y", "école é x y"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in near_copies(docs, max_weight=limit).collect()} == first_of_components(rows)


def test_stage_drops_near_copies(spark):
    """Copies with several words changed, which lie more than 3 bits of SimHash apart."""
    import corpus_pipeline

    rows = list(enumerate(texts(2, 12, 6)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert {r.doc_id for r in kept} == first_of_components(rows) and len(kept) == len({r.doc_id for r in kept})


def test_fingerprints_find_what_no_band_holds(spark):
    """The pipeline's stage goes through SimHash: texts of a similarity of 0.8 that share no band, 6 bits apart at most."""
    import corpus_pipeline

    words = [f"n148848w{k}" for k in range(24)]
    rows = [(3, " ".join(words)), (8, " ".join(words[:20]))]
    a, b = (nc.shingles(t) for _, t in rows)
    assert (simhash.majority(a) ^ simhash.majority(b)).bit_count() <= 6
    assert not (nc._minhashes(a).reshape(nc.BANDS, nc.ROWS) == nc._minhashes(b).reshape(nc.BANDS, nc.ROWS)).all(axis=1).any()
    assert first_of_components(rows) == {3}
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert [r.doc_id for r in kept] == [3]


def test_null_ids_and_empty(spark):
    base = " ".join(f"word{i}" for i in range(300))
    near = base.replace("word150", "other")
    docs = spark.createDataFrame([(None, base), (None, near), (4, near.replace("word9 ", "w ")), (4, base)], "doc_id long, text string")
    assert [r.doc_id for r in keep_first(docs).orderBy("doc_id").collect()] == [None, None, 4]
    assert keep_first(docs.limit(0)).count() == 0


@pytest.mark.parametrize("keep", [keep_first, simhash.keep_first])
def test_one_id_with_several_texts(spark, keep):
    """Different texts under one id are in different components, so both stay; a row that is there twice stays once."""
    one, two = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    docs = spark.createDataFrame([(5, one, 1), (5, two, 2), (5, two, 2), (7, one, 3), (8, two, 4)], "doc_id long, text string, _n int")
    assert sorted((r.doc_id, r.text) for r in keep(docs).collect()) == [(5, one), (5, two)]


def test_heavy_buckets_without_a_large_component(spark):
    """Templates that are all in one bucket, in many small components: groups stay bounded, no link is lost."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = random.Random(9)
    sets = {}
    for group in range(60):  # of 40 shingles 24 are of the template, and up to one of a copy is its own
        own = [1000 + group * 100 + k for k in range(16)]
        for copy in range(rng.choice([1, 2, 3, 5])):
            sets[group * 10 + copy] = sorted([*range(24), *own[: 15 + (copy == 0)], *([50_000 + group * 10 + copy] if copy else [])])
    rows = [(n, len(s), [7]) for n, s in sets.items()]
    once = spark.createDataFrame(rows, "node long, size long, keys array<long>")
    table = spark.createDataFrame([(n, s) for n, s in sets.items()], "node long, grams array<long>")
    found = {r.node: r.root for r in nc._components(once, lambda wanted: table.join(wanted, "node", "left_semi"), 8, 8 * nc.LEAST_WEIGHT).collect()}
    near = lambda a, b: 10 * len(set(sets[a]) & set(sets[b])) >= 8 * len(set(sets[a]) | set(sets[b]))
    assert all(near(a, b) == (a // 10 == b // 10) for a in sets for b in sets)
    for a in sets:
        assert found.get(a, a) == a // 10 * 10
    limit = 8 * nc.LEAST_WEIGHT
    split = once.select(F.lit(7).cast("long").alias("key"), "node", "size", F.lit(len(sets) // 8 + 1).cast("long").alias("parts"))
    groups = nc.pairs_of_parts(split, split, limit).groupBy("key").agg(F.count("*").alias("n"), F.collect_set("node").alias("nodes")).collect()
    assert max(g.n for g in groups) <= 2 * 2 * 8 + 8 and len(groups) > 100
    met = {(a, b) for g in groups for a in g.nodes for b in g.nodes}
    assert met == {(a, b) for a in sets for b in sets}
    assert np.mean([g.n for g in groups]) < 2 * 8 + 4
