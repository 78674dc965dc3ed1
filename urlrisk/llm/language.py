"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_batches

#: n-grams are hashed to so many buckets; the matrix has one row for each.
BUCKETS = 1 << 14
SIZES = (1, 2, 3)
_MIX = np.uint32(0x9E3779B1)
UNKNOWN = "und"


def _codes(text: str) -> np.ndarray:
    """Lower-case code points between blanks, with digits and white space as blanks."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").copy()
    c[(c < 65) | ((c > 90) & (c < 97)) | ((c > 122) & (c < 128))] = 32
    return c


def buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of all texts, and how many each text has. n-grams of
    blanks alone are left out, and none reaches over two texts."""
    parts = [_codes(t or "") for t in texts]
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    found, owners = [], []
    for n in SIZES:
        if len(flat) < n:
            continue
        m = len(flat) - n + 1
        h = np.full(m, n, np.uint32)
        same, letters = owner[:m] == owner[n - 1 :], np.zeros(m, bool)
        for k in range(n):
            x = flat[k : k + m]
            h = (h ^ x) * _MIX
            h ^= h >> np.uint32(15)
            letters |= x != 32
        keep = same & letters
        found.append((h[keep] & np.uint32(BUCKETS - 1)).astype(np.int32))
        owners.append(owner[:m][keep])
    found, owners = np.concatenate(found or [np.zeros(0, np.int32)]), np.concatenate(owners or [np.zeros(0, np.int32)])
    return found, owners


def _pieces(texts: list[str | None], chars: int = 2_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about ``chars`` characters, with the place of the first."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield at, texts[at : k + 1]
            at, size = k + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def count_grams(labelled: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over all rows of ``labelled(lang string, text string)``.

    A task adds up its batches before it gives its counts, so the shuffle has at most
    ``BUCKETS`` rows for each language and task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for a, t in zip(langs, texts, strict=True) if a == lang]
                for _, part in _pieces(own):
                    counts = np.bincount(buckets(part)[0], minlength=BUCKETS)
                    total[lang] = total[lang] + counts if lang in total else counts
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=["lang", "bucket", "n"]
            )

    rows = labelled.where("lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def predict_language(docs: DataFrame, folds: int = 4, fold: int = 2, smoothing: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out boolean, lang_pred string, score double`` for every row.

    Learns from rows with a language whose id's crc32, as text, is not ``fold`` modulo
    ``folds``; priors are equal. ``score`` is the posterior of the prediction (a text of many n-grams
    is nearly sure). Null texts and texts without a letter are ``und`` with score 0, as is
    every text if nothing was learned. A null id is not held out. Ties go to the language
    that sorts first. The counts are one number per language and bucket, so what is
    collected and broadcast is bounded by the number of languages.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = count_grams(rows.where(~held).select("lang", "text")).collect()
    langs = sorted({r.lang for r in counts})
    table = np.full((BUCKETS, max(1, len(langs))), smoothing)
    place = {a: k for k, a in enumerate(langs)}
    for r in counts:
        table[r.bucket, place[r.lang]] += r.n
    model = docs.sparkSession.sparkContext.broadcast((langs, np.log(table / table.sum(axis=0)).astype(np.float32)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, logs = model.value
        texts = batch.column(1).to_pylist()
        pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for at, part in _pieces(texts) if names else ():
            found, owner = buckets(part)
            total = np.stack([np.bincount(owner, weights=logs[:, k][found], minlength=len(part)) for k in range(len(names))], axis=1)
            best = total.argmax(axis=1)
            sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            for k, t in enumerate(part):
                if t and any(map(str.isalpha, t)):
                    pred[at + k], score[at + k] = names[best[k]], sure[k]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    scored = map_batches(rows.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", held.alias("held_out"), "lang_pred", "score")
