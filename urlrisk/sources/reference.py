"""Reference tables: indicators, trusted domains, brands, keywords, suffix rules."""

from __future__ import annotations

import zipfile
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk import config as C
from urlrisk.functions.text import sld
from urlrisk.schemas import IOC
from urlrisk.sources.scratch import written


@dataclass(frozen=True)
class References:
    """The reference tables of a run."""

    trusted: DataFrame  # pos int, domain string, sld string
    brands: DataFrame  # pos int, brand string, legit_domain string
    tlds: DataFrame  # pos int, tld string
    keywords: DataFrame  # kind string, pos int, keyword string
    suffix_rules: DataFrame  # rule string, kind string
    #: The words of lists that were given as sequences, and of tables once they were read.
    known: dict[str, list[str]] = field(default_factory=dict, compare=False)

    def words(self, kind: str) -> list[str] | None:
        """The words of a short list in their order; None for one of over ``MAX_LITERALS``
        rows, which is joined instead. ``kind``: of ``keywords``, or ``tld``."""
        if kind not in self.known:
            table = self.tlds.select("pos", F.col("tld").alias("keyword")) if kind == "tld" else self.keywords.where(F.col("kind") == kind)
            rows = table.orderBy("pos").select("keyword").limit(C.MAX_LITERALS + 1).collect()
            self.known[kind] = [w for (w,) in rows]
        words = self.known[kind]
        return words if len(words) <= C.MAX_LITERALS else None


def local_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A small table of numbers, texts and nulls as part of the plan, whose size the
    planner knows."""
    cols = [c.split() for c in schema.split(", ")]

    def value(v) -> str:
        if v is None:
            return "NULL"
        return str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"

    values = ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows) or "(" + ", ".join("NULL" for _ in cols) + ")"
    names = ", ".join(f"c{k}" for k in range(len(cols)))
    out = spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
    out = out.select(*(F.col(f"c{k}").cast(kind).alias(name) for k, (name, kind) in enumerate(cols)))
    return out if rows else out.limit(0)


def _numbered(spark: SparkSession, values: Sequence[str], name: str) -> DataFrame:
    return local_table(spark, list(enumerate(values)), f"pos int, {name} string")


def _list(spark: SparkSession, given: Sequence[str] | DataFrame | None, default: Sequence[str], name: str) -> DataFrame:
    """``pos, name`` of a list, or of a table with these columns; of the default, if it is empty."""
    if isinstance(given, DataFrame):
        if not given.isEmpty():
            return given.select(F.col("pos").cast("int").alias("pos"), F.col(name).cast("string").alias(name))
        given = None
    return _numbered(spark, given or default, name)


def reference_tables(
    spark: SparkSession,
    trusted: Sequence[str] | DataFrame | None = None,
    brands: Mapping[str, Sequence[str]] | DataFrame | None = None,
    tlds: Sequence[str] | DataFrame | None = None,
    credential: Sequence[str] | DataFrame | None = None,
    financial: Sequence[str] | DataFrame | None = None,
    urgency: Sequence[str] | DataFrame | None = None,
    lures: Sequence[str] | DataFrame | None = None,
    suffix_path: str | None = None,
    suffix_rules: DataFrame | None = None,
) -> References:
    """The default lists as tables, or those given; an empty one falls back to its default.

    A list may be a sequence or a table: ``pos, domain`` of trusted domains, ``pos, brand,
    legit_domain``, ``pos, tld``, ``pos, keyword`` of the keywords, ``rule`` of the suffix
    rules as a public suffix list writes them. ``pos`` orders a list. Tables may be of any
    size; long ones are joined.
    """
    kinds = {
        "credential": (credential, C.CREDENTIAL_KEYWORDS),
        "financial": (financial, C.FINANCIAL_KEYWORDS),
        "urgency": (urgency, C.URGENCY_KEYWORDS),
        "lure": (lures, C.LURE_KEYWORDS),
    }
    known = {k: list(own or default) for k, (own, default) in (kinds | {"tld": (tlds, C.SUSPICIOUS_TLDS)}).items() if not isinstance(own, DataFrame)}
    words = [(k, i, w) for k, (own, default) in kinds.items() if not isinstance(own, DataFrame) for i, w in enumerate(own or default)]
    keywords = local_table(spark, words, "kind string, pos int, keyword string")
    for k, (own, default) in kinds.items():
        if isinstance(own, DataFrame):
            keywords = keywords.unionByName(_list(spark, own, default, "keyword").select(F.lit(k).alias("kind"), "pos", "keyword"))
    if isinstance(brands, DataFrame) and not brands.isEmpty():
        owners = brands.select(F.col("pos").cast("int").alias("pos"), "brand", "legit_domain")
    else:
        pairs = enumerate(((None if isinstance(brands, DataFrame) else brands) or C.BRAND_DOMAINS).items())
        owners = local_table(spark, [(i, b, d) for i, (b, ds) in pairs for d in ds], "pos int, brand string, legit_domain string")
    domains = _list(spark, trusted, C.TRUSTED_DOMAINS, "domain").withColumn("domain", F.lower("domain"))
    return References(
        trusted=domains.withColumn("sld", sld(F.col("domain"))),
        brands=owners,
        tlds=_list(spark, tlds, C.SUSPICIOUS_TLDS, "tld"),
        keywords=keywords,
        suffix_rules=load_suffix_rules(spark, suffix_path, suffix_rules),
        known=known,
    )


#: Where the HTTP client among Spark's own jars keeps a public suffix list.
_BUNDLED = "mozilla/public-suffix-list.txt"


@lru_cache(1)
def listed_suffixes() -> tuple[str, ...] | None:
    """The rules of the ICANN part of the public suffix list that comes with Spark's jars
    (some seven thousand), or None where there is no such file."""
    for jar in sorted((Path(pyspark.__file__).parent / "jars").glob("httpclient*.jar")):
        with zipfile.ZipFile(jar) as z:
            if _BUNDLED in z.namelist():
                text = z.read(_BUNDLED).decode("utf-8").split("===END ICANN DOMAINS===")[0]
                return tuple(line.split()[0].lower() for line in text.splitlines() if line.strip() and not line.startswith("//"))
    return None


def default_suffixes() -> tuple[str, ...]:
    """The listed suffixes, or the built-in ones where that list is missing."""
    return listed_suffixes() or C.SUFFIX_RULES


def load_suffix_rules(spark: SparkSession, path: str | None = None, table: DataFrame | None = None) -> DataFrame:
    """``rule, kind`` (normal, wildcard, exception): a public suffix list in its usual text
    form, its ICANN part if it says which that is, or a table of its rules. Without either
    it is the list among Spark's jars, or the built-in rules where that is missing."""
    if table is not None and not table.isEmpty():
        rules = table.select(F.lower(F.trim("rule")).alias("rule"))
    elif path:
        lines = spark.read.text(path).select(F.trim("value").alias("rule"), F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n"))
        end = lines.where(F.col("rule").contains("===END ICANN DOMAINS===")).agg(F.min("n")).first()[0]
        lines = lines.where(F.col("n") < end) if end is not None else lines
        rules = lines.where("rule <> '' AND NOT startswith(rule, '//')").select(F.lower(F.split_part("rule", F.lit(" "), F.lit(1))).alias("rule"))
    else:
        rules = written(spark.createDataFrame([(r,) for r in default_suffixes()], "rule string"), "suffixes")
    kind = F.when(F.col("rule").startswith("!"), "exception").when(F.col("rule").startswith("*."), "wildcard").otherwise("normal")
    return rules.select(F.regexp_replace("rule", "^!", "").alias("rule"), kind.alias("kind")).distinct()


def default_iocs(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, *r) for i, r in enumerate(C.DEFAULT_IOCS)]
    table = local_table(spark, rows, "id long, indicator string, indicator_type string, source string, severity string, description string")
    return table.withColumn("created_at", F.lit(None).cast("timestamp"))


def load_iocs(spark: SparkSession, path: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A feed of indicators with the columns of ``IOC``; one without rows is replaced by
    the default indicators."""
    if path:
        feed = spark.read.format(fmt).schema(IOC).load(path)
        if not feed.isEmpty():
            return feed
    return default_iocs(spark)
