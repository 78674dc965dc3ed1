import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from urlrisk.llm.packing import assign_slots, build_sequences, encode_pieces, pack, plan_best_fit
from urlrisk.llm.registry import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, length int"


@pytest.fixture(scope="module")
def docs(spark):
    words = ["one two three"] * 30 + ["a " * 300] * 4 + ["x y z " * 900, "", None, "tail.", "one <|endoftext|> two"]
    rows = [(i, t, "en", 1) for i, t in enumerate(words)] + [(None, "no id", "en", 1), (3, "one two three", "en", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_slots_are_gapless_and_pieces_right(spark, docs):
    out = pack(docs, tokenizer_path(), capacity=256).collect()
    library = Tokenizer.from_file(tokenizer_path())
    want = []
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r.doc_id, k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes())) for k in range(0, len(ids), 256)]
    key = lambda t: tuple((x is not None, x) for x in t)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=key) == sorted(want, key=key)
    taken = defaultdict(list)
    for r in out:
        taken[r.sequence_id].append((r.offset, r.length))
    for slots in taken.values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= 256


def test_empty_table(spark, docs):
    assert pack(docs.limit(0), tokenizer_path()).count() == 0


def test_build_sequences(spark, docs):
    unique = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    pieces = encode_pieces(unique, tokenizer_path(), capacity=256)
    slots = pack(unique, tokenizer_path(), capacity=256)
    got = build_sequences(pieces, slots).select(F.length("ids").alias("n"), F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("m")).collect()
    assert all(r.n == 4 * r.m <= 1024 for r in got)


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= x]
        if fits:
            k = min(fits, key=lambda k: rooms[k])
            rooms[k] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_plan_equals_best_fit_over_documents(lengths):
    histogram = {x: lengths.count(x) for x in set(lengths)}
    plan = plan_best_fit(histogram, 40)
    load, ranks = defaultdict(list), defaultdict(list)
    for length, first, last, sequence, each, base in plan:
        for rank in range(first, last + 1):
            n = rank - first
            load[sequence + n // each].append((base + n % each * length, length))
            ranks[length].append(rank)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    for slots in load.values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= 40
    assert len(load) == best_fit_decreasing(lengths, 40)


def test_one_length_for_most_rows(spark):
    pieces = spark.range(5000).select("id", F.lit(7).cast("long").alias("length"))
    out = assign_slots(pieces, capacity=20).groupBy("sequence_id").agg(F.sort_array(F.collect_list("offset")).alias("o")).collect()
    assert len(out) == 2500 and all(r.o == [0, 7] for r in out)
