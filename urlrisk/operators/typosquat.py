"""Look-alikes of trusted domains, once for each distinct registered domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk import config as C
from urlrisk.config import RiskConfig
from urlrisk.functions.text import restricted_distance, settle, sld, unleet

_REACH = 2


def flag_trusted(domains: DataFrame, trusted: DataFrame) -> DataFrame:
    """``domains(registered_domain, ...)`` with ``is_listed``: the domain is a trusted one."""
    listed = trusted.select(F.col("domain").alias("registered_domain"), F.lit(True).alias("is_listed")).distinct()
    return domains.join(listed, "registered_domain", "left").withColumn("is_listed", F.coalesce("is_listed", F.lit(False)))


def _variants(c: str) -> Column:
    """A text and all texts that lack one or two of its characters."""
    one = "transform(sequence(1, length(t)), i -> concat(substr(t, 1, i - 1), substr(t, i + 1)))"
    first = f"CASE WHEN length({c}) > 0 THEN {one.replace('length(t)', f'length({c})').replace('substr(t,', f'substr({c},')} ELSE cast(array() as array<string>) END"
    second = f"flatten(transform({first}, t -> CASE WHEN length(t) > 0 THEN {one} ELSE cast(array() as array<string>) END))"
    return F.expr(f"array_distinct(concat(array({c}), {first}, {second}))")


#: Names of this length and more are found by segments. Two edits touch four of five segments at
#: most, as a swap may touch two, so one of them stands in the text as it is.
_LONG, _SEGMENTS = 10, 5
#: By how much a text is longer than a name, and by how much a segment that two edits left
#: alone may be moved in it.
_MOVES = [(more, by) for more in range(-_REACH, _REACH + 1) for by in range(-_REACH, _REACH + 1) if abs(by) + abs(more - by) <= _REACH]


def _cut(text: str, size: str, by: str) -> str:
    """SQL for the segments of ``text`` at their places in a name of length ``size``, moved ``by``."""
    start = f"(k * {size} div {_SEGMENTS})"
    length = f"((k + 1) * {size} div {_SEGMENTS} - k * {size} div {_SEGMENTS})"
    piece = f"struct(cast({size} AS int) AS size, cast(k AS int) AS k, if({start} + {by} >= 0, substr({text}, cast({start} + {by} + 1 AS int), cast({length} AS int)), '') AS piece)"
    return f"filter(transform(sequence(0, {_SEGMENTS - 1}), k -> {piece}), s -> length(s.piece) = (s.k + 1) * {size} div {_SEGMENTS} - s.k * {size} div {_SEGMENTS})"


def segments_of_name(c: str) -> Column:
    """The five segments of a name, with its length and their numbers."""
    return F.expr(_cut(c, f"length({c})", "0"))


def segments_of_text(c: str) -> Column:
    """What a text may share with a name of ``_LONG`` characters or more within two edits: at most
    five segments for each of ``_MOVES``, whatever its length."""
    moves = ", ".join(f"named_struct('more', {more}, 'by', {by})" for more, by in _MOVES)
    cut = _cut(c, f"(length({c}) - m.more)", "m.by")
    return F.expr(f"array_distinct(flatten(transform(filter(array({moves}), m -> length({c}) - m.more >= {_LONG}), m -> {cut})))")


def _near(left: DataFrame, trusted: DataFrame) -> DataFrame:
    """Pairs of ``left(text)`` and trusted names that may lie within two edits, and all
    that do. Equi joins, whatever the size of either side: long names share a segment with
    the text, short ones a variant with up to two characters deleted."""
    is_long = F.length("sld") >= _LONG
    short = left.where(F.length("text") < _LONG + _REACH)
    a = short.select("text", F.explode(_variants("text")).alias("variant"))
    b = trusted.where(~is_long).select("pos", "domain", F.col("sld").alias("name"), F.explode(_variants("sld")).alias("variant"))
    by_variant = a.join(b, "variant").select("text", "pos", "domain", "name")
    a = left.where(F.length("text") >= _LONG - _REACH).select("text", F.inline(segments_of_text("text")))
    b = trusted.where(is_long).select("pos", "domain", F.col("sld").alias("name"), F.inline(segments_of_name("sld")))
    by_segment = a.join(b, ["size", "k", "piece"]).select("text", "pos", "domain", "name")
    return by_variant.unionByName(by_segment.where(F.levenshtein(F.col("text"), F.col("name"), 2 * _REACH) >= 0)).distinct()


def _near_literal(left: DataFrame, names: list[tuple]) -> DataFrame:
    """The same pairs, and those of texts that read as the name, from a small list within
    expressions: a restricted distance of k is
    one of k in length at most and a plain one of at most 2k, which Spark measures up to a bound."""
    kind = "array<struct<pos:int,domain:string,name:string,size:int>>"
    rows = F.array(*(F.struct(F.lit(p), F.lit(d), F.lit(s), F.lit(len(s))) for p, d, s in names)).cast(kind) if names else F.expr(f"cast(array() as {kind})")
    left = settle(left.select("text", unleet(F.col("text")).alias("read")), "read")
    close = lambda t: (F.abs(F.length("text") - t["size"]) <= _REACH) & ((F.levenshtein(F.col("text"), t["name"], 2 * _REACH) >= 0) | (F.col("read") == t["name"]))
    return left.select("text", F.explode(F.filter(rows, close)).alias("t")).select("text", "t.pos", "t.domain", "t.name")


def _distance() -> Column:
    """The restricted distance of ``text`` and ``name`` from the plain one, ``plain``, where
    that settles it; swaps count twice in ``plain``, so the full table is needed only for
    pairs whose characters allow for swaps. Right up to ``_REACH``; larger beyond."""
    same = "array_sort(split(text, '')) = array_sort(split(name, ''))"
    odd = "size(array_except(split({}, ''), split({}, ''))) <= 1"
    close = f"abs(length(text) - length(name)) <= 1 AND {odd.format('text', 'name')} AND {odd.format('name', 'text')}"
    settled = F.expr(f"plain <= 1 OR plain > 4 OR (plain IN (2, 4) AND NOT {same}) OR (plain = 3 AND NOT ({close}))")
    return F.when(settled, F.col("plain")).otherwise(restricted_distance("text", "name"))


def similar_domains(domains: DataFrame, trusted: DataFrame, cfg: RiskConfig | None = None, path: str = "auto") -> DataFrame:
    """``registered_domain, pos, rule, domain``: every trusted domain that each distinct
    ``registered_domain`` resembles, trusted ones left out.

    Rule 1: the first labels are within one edit (two, if the longer has over six
    characters) and differ. Rule 2: they are equal once digits are read as letters. Rule
    3: a part between hyphens is within one edit (two for trusted names over six), or
    equal once read as letters. ``path``: ``literal`` writes the trusted list into
    expressions, ``join`` joins on segments and variants, ``auto`` takes the first for lists of
    up to ``MAX_LITERALS`` rows. Both give the same rows.
    """
    cfg = cfg or RiskConfig()
    trusted = trusted.where(F.length("sld") >= cfg.min_trusted_sld_len)
    names = [tuple(r) for r in trusted.select("pos", "domain", "sld").limit(C.MAX_LITERALS + 1).collect()] if path != "join" else []
    literal = path == "literal" or path == "auto" and len(names) <= C.MAX_LITERALS
    own = domains.select("registered_domain").distinct().withColumn("sld", sld(F.col("registered_domain")))
    own = settle(own, "sld").join(trusted.select(F.col("domain").alias("registered_domain")), "registered_domain", "left_anti")
    chunks = F.filter(F.transform(F.split("sld", "-"), lambda x: F.trim(x)), lambda x: x != "")
    parts = own.where(F.contains("sld", F.lit("-"))).select("registered_domain", F.lit(True).alias("is_chunk"), F.explode(chunks).alias("text"))
    texts = own.select("registered_domain", F.lit(False).alias("is_chunk"), F.col("sld").alias("text")).unionByName(parts)
    distinct = texts.select("text").distinct()
    if literal:
        pairs = _near_literal(distinct, names)
    else:
        read = distinct.withColumn("name", unleet(F.col("text"))).join(trusted.select("pos", "domain", F.col("sld").alias("name")), "name")
        pairs = _near(distinct, trusted).unionByName(read.select("text", "pos", "domain", "name")).distinct()
    pairs = settle(pairs.withColumn("plain", F.levenshtein("text", "name")), "plain")
    pairs = settle(pairs.withColumn("d", _distance()).withColumn("read", unleet(F.col("text")) == F.col("name")), "d", "read")
    hits = texts.join(pairs.where((F.col("d") <= _REACH) | F.col("read")), "text")
    rules = (
        "NOT is_chunk AND d > 0 AND d <= if(greatest(length(text), length(name)) <= 6, 1, 2)",
        "NOT is_chunk AND read AND text <> name",
        "is_chunk AND (read OR d <= if(length(name) <= 6, 1, 2))",
    )
    found = F.expr("filter(array(" + ", ".join(f"if({test}, {k}, 0)" for k, test in enumerate(rules, 1)) + "), r -> r > 0)")
    return hits.select("registered_domain", "pos", F.explode(found).alias("rule"), "domain").distinct()


def first_resemblance(similar: DataFrame) -> DataFrame:
    """``registered_domain, domain, rule``: the first trusted domain, and its first rule."""
    best = F.min_by(F.struct("domain", "rule"), F.struct("pos", "rule")).alias("b")
    return similar.groupBy("registered_domain").agg(best).select("registered_domain", "b.domain", "b.rule")


def typosquat_evidence(domain: str = "domain", rule: str = "rule") -> Column:
    return F.expr(
        f"CASE {rule} WHEN 1 THEN concat('Domain is highly similar to trusted domain ', {domain}) "
        f"WHEN 2 THEN concat('Domain is highly similar to trusted domain ', {domain}, ' via character substitution') "
        f"WHEN 3 THEN concat('Domain contains typosquatted variation of trusted domain ', {domain}) END"
    )
