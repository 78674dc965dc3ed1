"""Encoding of whole texts with a public tokenizer, inside Arrow batches."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the work

#: Letters, then marks that no pattern of the tokenizer joins to letters.
_WORD = r"^(?P<letters>\p{L}+)(?P<marks>[.,;:!?()*#$%&|-]*)$"
#: Only within these characters is lower case the same here and in the tokenizer.
_UNUSUAL = "[^\x00-įı-ɏ]"
#: Rows of an Arrow batch that are encoded at a time.
ENCODE_ROWS = 4000
#: About how many bytes of a batch ``packing`` encodes at a time: words, lists and ids take some thirty times that.
ENCODE_BYTES = 4 << 20
#: Words of letters that go to the library as one text.
JOINED = 50_000


def _gather(table: np.ndarray, first: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``table``, run k being its ``size[k]`` values from ``first[k]``
    on, one after the other; and where each begins, with the total as the last."""
    n = size[which]
    at = np.append(0, np.cumsum(n))
    return table[np.repeat(first[which] - at[:-1], n) + np.arange(at[-1])], at


class Encoder:
    """Token ids of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    For a tokenizer that drops white space before its merges (``by_word``), the pieces
    between ASCII white space are encoded independently, so each distinct piece of a slice
    goes to the library once. Pieces of letters, and letters before marks, go there
    together, and the end-of-word mark of the vocabulary tells their ids apart; all others,
    those with special tokens among them, go there as typed. The rest is array work.
    """

    def __init__(self, path: str, by_word: bool = True):
        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), "<u4", int(sizes.sum())), sizes

    def _letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_each``, for words of letters, many in one text."""
        found = []
        for at in range(0, len(words), JOINED):
            part = words.slice(at, JOINED)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), " ")[0].as_py()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            found.append((ids, np.diff(stops, prepend=0)) if len(stops) == len(part) else self._each(part.to_pylist()))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else self._each([])

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_each``, for distinct words without blanks."""
        parts = pc.extract_regex(words, _WORD)
        parted = pc.and_(pc.is_valid(parts), pc.invert(pc.match_substring(words, "İ")))
        other = words.filter(pc.invert(parted))
        letters, marks = parts.filter(parted).flatten()
        letters = pc.if_else(pc.match_substring_regex(letters, _UNUSUAL), letters, pc.utf8_lower(letters)).dictionary_encode()
        marks = marks.dictionary_encode()
        found = [self._letters(letters.dictionary), self._each(marks.dictionary.to_pylist()), self._each(other.to_pylist())]
        table, size = (np.concatenate(x) for x in zip(*found, strict=True))
        n_letters, n_marks = len(letters.dictionary), len(marks.dictionary)
        # two runs for each word, the second being empty for other words
        size = np.append(size, 0)
        runs = np.full((len(words), 2), len(size) - 1)
        mask = parted.to_numpy(zero_copy_only=False)
        runs[mask, 0], runs[mask, 1] = letters.indices.to_numpy(), marks.indices.to_numpy() + n_letters
        runs[~mask, 0] = np.arange(len(other)) + n_letters + n_marks
        ids, at = _gather(table, np.cumsum(size) - size, size, runs.ravel())
        return ids, np.diff(at[::2])

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, starts)``: the ids of all texts, one after the other and each followed by
        ``end`` if that is given, and the place of each text's first id, with the total
        as the last. Null is the empty text."""
        texts = texts.fill_null("")
        if self.by_word:
            lists = pc.ascii_split_whitespace(texts)
            words = lists.values.dictionary_encode()
            table, size = self._words(words.dictionary)
            ids, at = _gather(table, np.cumsum(size) - size, size, words.indices.to_numpy())
            starts = at[lists.offsets.to_numpy()]
        else:
            ids, size = self._each(texts.to_pylist())
            starts = np.append(0, np.cumsum(size))
        if end is None:
            return ids, starts
        return np.insert(ids, starts[1:], np.uint32(end)), starts + np.arange(len(starts))


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, by_word: bool = True) -> Encoder:
    """The worker's encoder for a file, kept between batches and tasks."""
    if (path, by_word) not in _encoders:
        _encoders[path, by_word] = Encoder(path, by_word)
    return _encoders[path, by_word]
