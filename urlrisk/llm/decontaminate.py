"""Benchmark decontamination: short test items that long documents contain.

Containment is the share of an item's distinct word shingles that a document holds. The
distinct items are partitioned by size, the number of their shingles, in powers of two. A
document that reaches the containment ``t`` of an item of q shingles lacks at most
``q - ceil(t q)`` of them, so it holds one of any ``q - ceil(t q) + 1``. The MinHash
signature of a partition has that many values for the largest size in it (bottom-k: the
first shingles in one order that is the same everywhere, those that fewest items hold
before others and then by hash). Documents meet the signatures by an equi join on the
shingle, and a partition only if they are long enough for its items; the candidates are
verified by counting the item's shingles that the document holds. No item is missed.

Documents don't send all their shingles into that join. A bitmap of at most
``MAX_BITS`` bits has the hashes of the signatures' shingles, a second one those of all
items' shingles, and a document sends those that the bitmaps let through. Chance
hits find no partner in the join; the bitmaps fill up as items grow, but never get larger.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import map_batches, materialize, unused

_words = re.compile(r"\w+").findall
#: The bounds of a bitmap: 8 MiB at most.
MIN_BITS, MAX_BITS = 1 << 12, 1 << 26


def words_of(text: str | None) -> list[str]:
    """Words: runs of letters, digits and underscores, in lower case."""
    return _words(text.lower()) if text else []


def word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """``(numbers, starts, vocabulary)``: the words of all texts, each as its place in
    ``vocabulary``, and where each text's begin, with the total as the last. What stands
    between ASCII white space is taken apart once for all its occurrences."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    tokens = lists.values.dictionary_encode()
    vocabulary: dict[str, int] = {}
    flat: list[int] = []
    sizes: list[int] = []
    for token in tokens.dictionary.to_numpy(zero_copy_only=False).tolist():
        own = _words(token.lower())
        sizes.append(len(own))
        flat += [vocabulary.setdefault(w, len(vocabulary)) for w in own]
    size = np.array(sizes, np.int64)
    which = tokens.indices.to_numpy()
    n = size[which]
    at = np.append(0, np.cumsum(n))
    first = np.cumsum(size) - size
    numbers = np.array(flat, np.int64)[np.repeat(first[which] - at[:-1], n) + np.arange(at[-1])]
    return numbers, at[lists.offsets.to_numpy()], list(vocabulary)


def _word_hashes(vocabulary: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in vocabulary), np.uint64, len(vocabulary))


def _mix(words: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each shingle, whose k-th word has the hash ``words[k]``."""
    h = np.full(len(words[0]), 0x9E3779B97F4A7C15, np.uint64)
    for row in words:
        h ^= row
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def _item_shingles(items: DataFrame, width: int) -> DataFrame:
    """``key, n int, gram, h long``: the distinct shingles of ``items(key, words)``, their
    number of words and their hash."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keys, sizes, grams, hashes = [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = text.split(" ")
            n = min(width, len(words))
            found = sorted({" ".join(words[k : k + n]) for k in range(len(words) - n + 1)})
            own = [_word_hashes(g.split(" ")) for g in found]
            keys += [key] * len(found)
            sizes += [n] * len(found)
            grams += found
            hashes.append(_mix(list(np.array(own).T)))
        if not keys:
            return None
        cols = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(grams, pa.string()), pa.array(np.concatenate(hashes).view(np.int64))]
        return pa.RecordBatch.from_arrays(cols, names=["key", "n", "gram", "h"])

    return map_batches(items.select("key", "words"), run, "key long, n int, gram string, h long")


def _signatures(grams: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(sizes, signatures): ``key, size, need`` of each item, and ``key, n, gram, h, least``
    of the shingles in the signature of the item's partition, ``least`` being the fewest
    shingles with which a document can hold an item of the partition."""
    need = lambda q: F.greatest(F.lit(1), F.ceil(F.lit(threshold) * q - 1e-9)).cast("long")
    sizes = grams.groupBy("key").agg(F.count("*").alias("size")).withColumn("need", need(F.col("size")))
    sizes = materialize(sizes, "sizes")
    shared = grams.groupBy("gram").agg(F.count("*").alias("holders"))
    low = F.expr("shiftleft(1L, length(bin(size)) - 1)")  # sizes low .. 2 low - 1 are a partition
    ranked = grams.join(sizes, "key").join(shared, "gram").withColumn("low", low)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("holders", "h", "gram")))
    most = F.expr("2 * low - 1")
    return sizes, ranked.where(F.col("rank") <= most - need(most) + 1).select("key", "n", "gram", "h", need(F.col("low")).alias("least"))


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """``bits`` bits, those of the hashes set: Spark gathers words of 64, at most
    ``MAX_BITS / 64`` of them, and the driver gets those that are not zero."""
    h = F.col("h").bitwiseAND(bits - 1)
    words = hashes.select(F.shiftright(h, 6).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    out = np.zeros(bits // 64, np.uint64)
    for batch in words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return out


def _bits(n: int) -> int:
    return int(min(MAX_BITS, max(MIN_BITS, 1 << (256 * n).bit_length())))


def _is_set(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1


def _hits(docs: DataFrame, widths: list[int], signed: np.ndarray, every: np.ndarray) -> DataFrame:
    """``doc_id, h, n, grams array<string>`` of ``docs(doc_id, text, h)``: the distinct
    shingles of each document that ``every`` lets through, and how many it has in all, if
    ``signed`` lets through one of them."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((signed, every))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        first, all_ = held.value
        numbers, starts, vocabulary = word_numbers(batch.column(1))
        owner = np.repeat(np.arange(batch.num_rows), np.diff(starts))
        hashed = _word_hashes(vocabulary)[numbers]
        places, wide, near = [], [], []
        for w in widths:
            m = len(numbers) - w + 1
            if m <= 0:
                continue
            h = _mix([hashed[k : k + m] for k in range(w)])
            at = np.flatnonzero(_is_set(all_, h) & (owner[:m] == owner[w - 1 :]))
            places.append(at)
            wide.append(np.full(len(at), w))
            near.append(_is_set(first, h[at]))
        if not places or not (near := np.concatenate(near)).any():
            return None
        places, wide = np.concatenate(places), np.concatenate(wide)
        found: dict[int, set[str]] = {d: set() for d in np.unique(owner[places[near]]).tolist()}
        for at, w, d in zip(places.tolist(), wide.tolist(), owner[places].tolist(), strict=True):
            if d in found:
                found[d].add(" ".join([vocabulary[k] for k in numbers[at : at + w].tolist()]))
        rows = pa.array(list(found))
        sizes = pa.array(np.diff(starts)[list(found)], pa.int64())
        grams = pa.array([sorted(g) for g in found.values()], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), sizes, grams], names=["doc_id", "h", "n", "grams"])

    return map_batches(docs.select("doc_id", "text", "h"), run, "doc_id long, h long, n long, grams array<string>")


def _matches(docs: DataFrame, items: DataFrame, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(found, named): ``doc_id, h, key, n_shared, n_shingles`` for each document of
    ``docs(doc_id, text, h)`` and distinct item, and ``key, item_id`` of all items."""

    def normal(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [" ".join(words_of(t)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.string())], names=["item_id", "words"])

    own = materialize(map_batches(items, normal, "item_id long, words string").where("words <> ''"), "items")
    distinct = materialize(own.select("words").distinct().withColumn("key", F.monotonically_increasing_id()), "distinct_items")
    named = own.join(distinct, "words").select("key", "item_id")
    grams = materialize(_item_shingles(distinct, width), "item_shingles")
    sizes, signed = _signatures(grams, threshold)
    signed = materialize(signed, "signatures")
    widths = sorted(r.n for r in grams.select("n").distinct().collect())  # at most ``width``
    bits = _bits(grams.count())
    hits = _hits(docs, widths, _bitmap(signed, bits), _bitmap(grams, bits))
    hits = materialize(hits.withColumn("row", F.monotonically_increasing_id()), "hits")
    sent = hits.select("row", "n", F.explode("grams").alias("gram"))
    candidates = sent.join(signed.select("gram", "key", "least"), "gram").where("n >= least").select("row", "key").distinct()
    counted = candidates.join(grams.select("key", "gram"), "key").join(sent.select("row", "gram"), ["row", "gram"])
    counted = counted.groupBy("row", "key").agg(F.count("*").alias("n_shared")).join(sizes, "key").where("n_shared >= need")
    found = counted.join(hits.select("row", "doc_id", "h"), "row")
    return found.select("doc_id", "h", "key", "n_shared", F.col("size").alias("n_shingles")), named


def _texts(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias(name), F.col(text_col).cast("string").alias("text"))


def find_contaminated(
    docs: DataFrame,
    items: DataFrame,
    width: int = 5,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, item_id, n_shared long, n_shingles long, containment double``: one row for
    each document and item with at least ``threshold`` of the item's distinct shingles.

    Case and punctuation don't count. An item of fewer than ``width`` words is one shingle
    of all its words; items and documents that are null or have no word are in no row.
    Repeated documents give repeated rows; repeated items too. Null ids are carried. Very
    long texts are searched whole; no items or no documents give no rows. Other columns
    are ignored.
    """
    found, named = _matches(_texts(docs, id_col, text_col, "doc_id").withColumn("h", F.xxhash64("text")), _texts(items, item_id_col, item_text_col, "item_id"), width, threshold)
    return found.join(named, "key").select("doc_id", "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    width: int = 5,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` whose own text contains no item, as ``find_contaminated`` finds
    them; rows of a null or repeated id are told apart by their texts."""
    rows = _texts(docs, id_col, text_col, "doc_id").withColumn("h", F.xxhash64("text"))
    found, _ = _matches(rows, _texts(items, item_id_col, item_text_col, "item_id"), width, threshold)
    i, h = unused(docs, "bad_id"), unused(docs, "bad_h")
    bad = materialize(found.select(F.col("doc_id").alias(i), F.col("h").alias(h)).distinct(), "contaminated")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(h))
    return docs.join(bad, same, "left_anti").select(*docs.columns)
