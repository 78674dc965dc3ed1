import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from urlrisk.llm.registry import tokenizer_path
from urlrisk.llm.token_files import Shard, dump, pack_bits, read_token_files, unpack_bits, width, write_token_files
from urlrisk.llm.tokens import Encoder, encoder


@pytest.fixture(scope="module")
def enc():
    return Encoder(tokenizer_path())


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokenizer_path())


PARTS = ["word", "Word.", "don't", "'re", "a", "É", "ß", "Σ", "İ", "ı", " ", "\n", "\t", "\x85", " ", "é", "́", "你", "1", "２", "***", "|", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "</w>", "\x0b", "\x1c", "\x00", "e\u0301", "ﬁ", "word,", "ΑΣ", "ᄀ", "가"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=20).map("".join), max_size=5))
def test_encoder_equals_the_library(plain, texts):
    """Also where texts spell special tokens out: they are what the library makes of them."""
    for by_word in (True, False):
        ids, starts = encoder(tokenizer_path(), by_word).encode(pa.array(texts, pa.string()))
        assert [ids[a:z].tolist() for a, z in zip(starts[:-1], starts[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_many_words_and_every_letter(enc, plain):
    """Words of every letter of the basic plane, some of which break a joint text apart."""
    words = [chr(c) + "a" for c in range(0x41, 0xD800) if chr(c).isalpha()]
    ids, starts = enc.encode(pa.array(words + [" ".join(words)]))
    got = [ids[a:z].tolist() for a, z in zip(starts[:-1], starts[1:], strict=True)]
    want = [e.ids for e in plain.encode_batch(words, add_special_tokens=False)]
    assert got[:-1] == want and got[-1] == [i for x in want for i in x]


def test_null_empty_and_end(enc):
    ids, starts = enc.encode(pa.array([None, "", " ", "a"]), end=2)
    assert ids.tolist() == [2, 2, 2, 320, 2] and starts.tolist() == [0, 1, 2, 3, 5]
    assert enc.encode(pa.array([], pa.string()), end=2)[1].tolist() == [0]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_bits_round_trip(bits, values):
    ids = np.array([v % (1 << bits) for v in values], "<u4")
    data = pack_bits(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert unpack_bits(data, len(ids), bits).tolist() == ids.tolist()


def test_width():
    assert [width(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_random_access():
    ids = np.arange(1000, dtype="<u4") % 300
    data = dump([5, None], ids, np.array([0, 300, 1000]), bits=9, block=64)
    read = []
    shard = Shard(lambda at, n: read.append(n) or data[at : at + n])
    assert shard.docs == [5, None] and shard.document(1).tolist() == ids[300:].tolist()
    read.clear()
    assert shard.ids(500, 510).tolist() == ids[500:510].tolist()
    assert sum(read) == 72  # one block


def test_files_round_trip(spark, tmp_path, plain):
    rows = [(3, "some Words here", 1), (1, None, 2), (2, "x" * 5000, 3), (None, "no id", 4), (1, "again", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    folder = f"file://{tmp_path}/tokens"
    write_token_files(docs, folder, tokenizer_path(), shard_ids=4)
    got = sorted(read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 3]
    total = 0
    for r in got:
        assert (r.start, r.n_tokens) == (total, len(r.ids) // 4)
        total += r.n_tokens
    want = [np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t, _ in rows]
    assert sorted(bytes(r.ids) for r in got) == sorted(want)
    short = sorted(read_token_files(spark, folder, digest=True).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in short] == [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got]


def test_one_id_for_all_rows_is_split(spark, tmp_path):
    """Equal rows, and rows of a null id, are cut into several ranges."""
    docs = spark.range(4000).selectExpr("CASE WHEN id < 2000 THEN 7L END AS doc_id", "'some words here' AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shards = write_token_files(docs, f"file://{tmp_path}/same", tokenizer_path(), shard_ids=1000).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.part for r in shards}) > 2 and sum(r.n_docs for r in shards) == 4000
    got = sorted(read_token_files(spark, f"file://{tmp_path}/same", digest=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 2000 + [7] * 2000 and [r.start for r in got] == [4 * k for k in range(4000)]


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), folder, tokenizer_path())
    assert read_token_files(spark, folder).count() == 0
