"""Column functions on text, all built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.config import HOMOGLYPH_FROM, HOMOGLYPH_TO, LEET_FROM, LEET_TO


def entropy(c: str) -> Column:
    """Shannon entropy of the characters of a column, in bits, to three places; 0 if empty."""
    chars = f"split({c}, '')"
    bits = (
        f"aggregate(transform(array_distinct({chars}), x -> size(filter({chars}, y -> y = x)) / cast(length({c}) as double)), "
        "cast(0 as double), (acc, p) -> acc - p * log2(p))"
    )
    return F.expr(f"CASE WHEN coalesce(length({c}), 0) = 0 THEN cast(0 as double) ELSE round({bits}, 3) END")


def restricted_distance(a: str, b: str) -> Column:
    """Edit distance of two columns with insertions, deletions, substitutions and swaps of
    neighbours, no part being edited twice."""
    cell = (
        f"least(acc.p[j] + 1, row[j - 1] + 1, acc.p[j - 1] + if(substr({a}, i, 1) = substr({b}, j, 1), 0, 1), "
        f"if(i > 1 AND j > 1 AND substr({a}, i, 1) = substr({b}, j - 1, 1) AND substr({a}, i - 1, 1) = substr({b}, j, 1), get(acc.q, j - 2) + 1, 9999))"
    )
    row = f"aggregate(sequence(1, length({b})), array(i), (row, j) -> concat(row, array({cell})))"
    table = (
        f"aggregate(sequence(1, length({a})), named_struct('q', cast(array() as array<int>), 'p', sequence(0, length({b}))), "
        f"(acc, i) -> named_struct('q', acc.p, 'p', {row}), acc -> acc.p[length({b})])"
    )
    return F.expr(f"CASE WHEN length({a}) = 0 THEN length({b}) WHEN length({b}) = 0 THEN length({a}) ELSE {table} END")


def unleet(c: Column) -> Column:
    """Lower case, with digits and signs that are written for letters turned back."""
    return F.translate(F.lower(c), LEET_FROM, LEET_TO)


def fold_homoglyphs(c: Column) -> Column:
    """Characters that look like Latin letters turned into those."""
    return F.translate(c, HOMOGLYPH_FROM, HOMOGLYPH_TO)


def sld(c: Column) -> Column:
    """The first label of a domain, in lower case."""
    return F.split_part(F.lower(c), F.lit("."), F.lit(1))


def literal_array(values, kind: str = "string") -> Column:
    """An array of literals, also if there are none."""
    return F.array(*(F.lit(v).cast(kind) for v in values)) if values else F.expr(f"cast(array() as array<{kind}>)")


def first_match(values, test) -> Column:
    """The first of ``values`` for which ``test(value)`` holds, or null. Columns in the test
    are evaluated for every value, so they should be settled."""
    return F.get(F.filter(literal_array(values), test), 0)


def first_common(values, among: Column) -> Column:
    """The first of ``values`` that is an element of an array, or null."""
    return F.get(F.array_intersect(literal_array(values), among), 0)


#: Length of the parts by which the words of long lists are found.
GRAM = 3


def _grams(c: str, n: int) -> str:
    return f"if(length({c}) >= {n}, transform(sequence(1, length({c}) - {n} + 1), i -> substr({c}, i, {n})), cast(array() as array<string>))"


def rarest_grams(words: DataFrame, word: str) -> DataFrame:
    """``gram, word``: for each distinct word the part of ``GRAM`` characters that fewest words have
    (ties: the smaller); shorter words stand for themselves."""
    words = words.select(word).distinct().where(f"{word} <> ''")
    parts = words.where(F.length(word) >= GRAM).select(word, F.explode(F.expr(f"array_distinct({_grams(word, GRAM)})")).alias("gram"))
    counts = parts.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = parts.join(counts, "gram").groupBy(word).agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    short = words.where(F.length(word) < GRAM).select(F.col(word).alias("gram"), word)
    return rarest.select("gram", word).unionByName(short)


def words_within(texts: DataFrame, key: str, text: str, words: DataFrame, word: str) -> DataFrame:
    """``key, word``: the distinct ``words`` that are part of the ``text`` of each key of ``texts``.

    One equi join, on the rarest part of a word: a text sends a row for each of its parts of
    ``GRAM`` characters, and as many for each shorter length that a word has.
    """
    index = rarest_grams(words, word)
    shorter = [r.n for r in words.select(F.length(word).alias("n")).distinct().where(f"n > 0 AND n < {GRAM}").collect()]
    every = ", ".join(_grams(text, n) for n in (*shorter, GRAM))
    sent = texts.select(key, text, F.explode(F.expr(f"array_distinct(concat({every}))")).alias("gram"))
    return sent.join(index, "gram").where(F.contains(text, word)).select(key, word).distinct()


def settle(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` with ``cols`` (all, if none are named) computed once, here: a later filter or projection
    on them refers to their values. Without it the optimizer writes the whole expression
    of a column wherever a filter uses it, and again in each column that is built on it."""
    cols = cols or tuple(df.columns)
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, F.inline(F.array(F.struct(*cols)))).select(*df.columns)
