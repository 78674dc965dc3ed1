"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.functions.joins import filter_of, let_through

from ._common import map_batches, materialize, unused

#: What each position of a feature vector says of a text.
FEATURES = (
    "log_chars", "log_words", "mean_word", "sd_word", "upper_share", "digit_share", "mark_share", "odd_mark_share", "bang_per_word",
    "bar_per_word", "distinct_words", "same_as_previous", "distinct_lines", "distinct_pairs", "capital_words", "letter_entropy",
)
_COMMON_MARKS = ".,;:'\"()-?\n"


def features(text: str | None) -> list[float]:
    """Statistics of a whole text, on scales on which they are nearly normal. Shares lie
    in 0..1 and enter as log(share + 1/100); null is the empty text."""
    t = text or ""
    n = len(t)
    words = t.split()
    m = len(words)
    codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
    ascii_counts = np.bincount(np.minimum(codes, 128), minlength=129)
    lengths = np.fromiter(map(len, words), np.int32, m)
    upper = int(ascii_counts[65:91].sum())
    lower = int(ascii_counts[97:123].sum())
    digits = int(ascii_counts[48:58].sum())
    marks = int(ascii_counts[33:48].sum() + ascii_counts[58:65].sum() + ascii_counts[91:97].sum() + ascii_counts[123:127].sum())
    odd = marks - sum(int(ascii_counts[ord(c)]) for c in _COMMON_MARKS if c != "\n")
    lines = t.split("\n")
    pairs = list(zip(words, words[1:], strict=False))
    letters = ascii_counts[97:123] + ascii_counts[65:91]
    p = letters[letters > 0] / max(1, letters.sum())

    def share(x: float, of: float) -> float:
        return float(np.log(x / max(1, of) + 0.01))

    return [
        float(np.log1p(n)),
        float(np.log1p(m)),
        float(np.log1p(lengths.mean())) if m else 0.0,
        float(np.log1p(lengths.std())) if m else 0.0,
        share(upper, upper + lower),
        share(digits, n),
        share(marks, n),
        share(odd, n),
        share(int(ascii_counts[33]), m),
        share(int(ascii_counts[124]), m),
        share(len(set(words)), m),
        share(sum(a == b for a, b in pairs), m),
        share(len(set(lines)), len(lines)),
        share(len(set(pairs)), len(pairs)),
        share(sum(map(str.isupper, words)), m),
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
    ]


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id long, x array<double>`` with one value for each of ``FEATURES``.

    Null ids and repeated rows are kept; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [features(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """One Gaussian per class (0 and 1) with a shrunk covariance."""

    means: np.ndarray  # class by feature
    inverses: np.ndarray  # inverse Cholesky factor of each class
    constants: np.ndarray  # log prior - log det / 2

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for the rows of ``x``."""
        logs = [c - 0.5 * (((x - m) @ inv.T) ** 2).sum(axis=1) for m, inv, c in zip(self.means, self.inverses, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit_discriminant(labelled: DataFrame, shrinkage: float = 0.1, to_pooled: float = 0.2) -> Discriminant | None:
    """Fit on all rows of ``labelled(x array<double>, y int)``, or None if a class is empty.

    Spark sums counts and values, then products of centred values, per class (a fixed number
    of sums, whatever the number of rows); the driver gets those sums. A class covariance is drawn towards the
    pooled one by ``to_pooled`` and then towards its own mean variance by ``shrinkage``.
    Rows with a null in either column are left out.
    """
    d = len(FEATURES)
    rows = labelled.where("x IS NOT NULL AND y IS NOT NULL").select("x", F.col("y").cast("int").alias("y"))

    def sums(of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum of ``of(rows of a class)`` for each class."""

        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            x = np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, d)
            y = np.array(batch.column(1).to_pylist(), np.int64)
            parts = [(c, of(x[y == c]).tolist()) for c in (0, 1) if (y == c).any()]
            if not parts:
                return None
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in parts], pa.int32()), pa.array([v for _, v in parts], pa.list_(pa.float64()))], names=["y", "v"])

        found = map_batches(rows, run, "y int, v array<double>").select("y", F.posexplode("v").alias("k", "v")).groupBy("y", "k").agg(F.sum("v").alias("v"))
        table = np.zeros((2, size))
        for r in found.collect():
            table[r.y, r.k] = r.v
        return table

    table = sums(lambda x: np.append(len(x), x.sum(axis=0)), 1 + d)
    n = table[:, 0]
    if (n < 2).any():
        return None
    means = table[:, 1:] / n[:, None]
    middle = table[:, 1:].sum(axis=0) / n.sum()
    # products of what is left of the common mean: those of the values themselves would cancel
    table = sums(lambda x: ((x - middle).T @ (x - middle)).ravel(), d * d)
    own = [table[c].reshape(d, d) / n[c] - np.outer(means[c] - middle, means[c] - middle) for c in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    scale = np.maximum(np.diag(pooled), 1e-6)
    inverses, constants = [], []
    for c in (0, 1):
        cov = (1 - to_pooled) * own[c] + to_pooled * pooled
        cov = (1 - shrinkage) * cov + shrinkage * np.diag(scale)
        factor = np.linalg.cholesky(cov + 1e-9 * np.eye(d))
        inverses.append(np.linalg.inv(factor))
        constants.append(np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(inverses), np.array(constants))


def held_out(column: str, folds: int = 5):
    """Whether a row is held out: the crc32 of the id as text leaves no rest."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit_quality(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", folds: int = 5) -> Discriminant | None:
    """Fit on the labelled rows of ``table(doc_id, x)`` that are not held out."""
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1)")
    return fit_discriminant(table.where(~held_out("doc_id", folds)).join(marked, "doc_id").select("x", "y"))


def score_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5
) -> DataFrame:
    """``doc_id, held_out boolean, score double, predicted int`` for every row of ``docs``.

    Learns from the labelled rows that are not held out (``held_out``); labels of 0 and 1
    count, others and nulls don't; a document that is labelled twice counts twice. If a
    class has under two rows every score is 0.5. Null and empty texts are scored as empty
    texts; a null id is not held out and never labelled. Other columns are ignored.
    """
    table = materialize(document_features(docs, id_col, text_col), "features")
    model = fit_quality(table, labels, id_col, label_col, folds)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, len(FEATURES))
        score = model.score(x) if model else np.full(len(x), 0.5)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    scored = map_batches(table, run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id", folds).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose text's score (``score_quality``) reaches ``threshold``; rows of
    a null id stay. Each row is judged by its own text, so rows of one id are told apart.

    Once the classifier is fitted, rows are scored and kept or dropped where they are read:
    documents are not shuffled, at the price of taking the statistics of labelled ones twice,
    which a filter of their ids finds.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    some = let_through(rows, "doc_id", filter_of(labels.select(F.col(id_col).cast("long").alias("doc_id")), "doc_id"))
    model = fit_quality(materialize(document_features(some), "features"), labels, id_col, **how)

    cast, null = unused(docs, "scored_text"), unused(docs, "has_no_id")
    names, n = docs.columns, len(docs.columns)
    is_text = dict(docs.dtypes)[text_col] == "string"
    rows = docs.select("*", F.col(id_col).cast("long").isNull().alias(null), *([] if is_text else [F.col(text_col).cast("string").alias(cast)]))
    at = names.index(text_col) if is_text else n + 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in batch.column(at).to_pylist()], np.float64).reshape(-1, len(FEATURES))
        good = (model.score(x) if model else np.full(len(x), 0.5)) >= threshold
        kept = pa.array(good | batch.column(n).to_numpy(zero_copy_only=False))
        return pa.RecordBatch.from_arrays(batch.columns[:n], names=names).filter(kept)

    return map_batches(rows, run, docs.schema, rows=250)
