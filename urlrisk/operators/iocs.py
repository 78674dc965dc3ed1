"""Indicators of compromise: candidates, match, upsert, listing, signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk import config as C
from urlrisk.functions.joins import filter_of, join_hot, let_through
from urlrisk.operators.numbering import numbered
from urlrisk.sources.scratch import written

SEVERITIES = ("low", "medium", "high", "critical")
_MATCH = ("indicator", "indicator_type", "source", "severity", "description")


def _suffixes(host: str) -> Column:
    """All suffixes of a host, longest first, without empty ones."""
    labels = f"split(lower({host}), '\\\\.')"
    return F.expr(f"array_distinct(filter(transform(sequence(1, size({labels})), i -> array_join(slice({labels}, i, size({labels})), '.')), s -> s <> ''))")


def ioc_candidates(n: DataFrame) -> DataFrame:
    """``url_id, pos int, candidate`` for valid URLs with ``registered_domain``: the URL as
    given, the canonical URL, the suffixes of the host from the longest to the last label,
    and the registered domain, each once, in that order."""
    hosts = _suffixes("hostname")
    every = F.concat(F.array(F.lower("original_url"), F.lower("normalized_url")), hosts, F.array(F.lower("registered_domain")))
    rows = n.where("is_valid").select("url_id", F.posexplode(every).alias("pos", "candidate"))
    return rows.where("candidate <> ''").groupBy("url_id", "candidate").agg(F.min("pos").alias("pos")).select("url_id", "pos", "candidate")


def _feed(iocs: DataFrame) -> DataFrame:
    """``indicator, ioc`` once for each indicator: the row of the smallest id."""
    lowered = F.lower("severity")
    rows = iocs.select("id", *(F.when(lowered.isin(*SEVERITIES), lowered).otherwise("high").alias(c) if c == "severity" else F.col(c) for c in _MATCH))
    return rows.groupBy("indicator").agg(F.min_by(F.struct(*_MATCH), "id").alias("ioc"))


def _matched(keys: DataFrame, feed: DataFrame, large_feed: int) -> DataFrame:
    """``keys`` (with ``indicator``) that an indicator of ``feed`` equals, with its ``ioc``.

    A feed of up to ``large_feed`` rows is joined as it is, which the planner does by
    broadcast. A larger one is first made into a filter of bounded size: the keys that it
    lets through, few more than those that match, are counted, and the indicators that very
    many of them have (say ``com``) are broadcast; only the rest is shuffled.
    """
    if feed.limit(large_feed + 1).count() <= large_feed:
        return keys.join(feed, "indicator")
    some = written(let_through(keys, "indicator", filter_of(feed, "indicator")), "candidates")
    counts = some.groupBy("indicator").agg(F.count("*").alias("_n"))
    found = written(feed.join(counts, "indicator"), "indicators")
    return join_hot(some, found, "indicator", "_n", some.count()).drop("_n")


def match_hosts(hosts: DataFrame, iocs: DataFrame, large_feed: int = C.LARGE_FEED) -> DataFrame:
    """``hostname, host_ioc``: for each distinct host the indicator that equals its longest
    suffix, or else its registered domain. An equi join on the indicator (``_matched``)."""
    keys = hosts.select("hostname", F.posexplode(F.concat(_suffixes("hostname"), F.array(F.lower("registered_domain")))).alias("pos", "indicator"))
    return _matched(keys, _feed(iocs), large_feed).groupBy("hostname").agg(F.min_by("ioc", "pos").alias("host_ioc"))


def match_urls(n: DataFrame, iocs: DataFrame, large_feed: int = C.LARGE_FEED) -> DataFrame:
    """``n`` with ``url_ioc``: the indicator that equals the URL as given, or else the
    canonical one. Two equi joins, which a small feed makes without a shuffle; with a large
    one, only the URLs that its filter lets through are joined to it."""
    feed = _feed(iocs)
    if feed.limit(large_feed + 1).count() > large_feed:
        keys = n.select("url_id", F.posexplode(F.array(F.lower("original_url"), F.lower("normalized_url"))).alias("pos", "indicator"))
        hits = _matched(keys, feed, large_feed).groupBy("url_id").agg(F.min_by("ioc", "pos").alias("url_ioc"))
        return n.join(hits, "url_id", "left").select(*n.columns, "url_ioc")
    given = feed.select(F.col("indicator").alias("_given"), F.col("ioc").alias("_first"))
    canonical = feed.select(F.col("indicator").alias("_canonical"), F.col("ioc").alias("_second"))
    both = n.join(given, F.lower("original_url") == F.col("_given"), "left").join(canonical, F.lower("normalized_url") == F.col("_canonical"), "left")
    return both.select(*n.columns, F.coalesce("_first", "_second").alias("url_ioc"))


def match_iocs(n: DataFrame, hosts: DataFrame, iocs: DataFrame, large_feed: int = C.LARGE_FEED) -> DataFrame:
    """``url_id, ioc`` for each valid URL that an indicator names, ``ioc`` being the first
    by the order of its candidates (``ioc_candidates``); the indicator's type is not
    compared, an unknown severity is ``high``. ``hosts(hostname, registered_domain)`` are
    the distinct hosts, which are matched once each."""
    found = match_urls(n.where("is_valid"), iocs, large_feed).join(match_hosts(hosts, iocs, large_feed), "hostname", "left")
    return found.select("url_id", F.coalesce("url_ioc", "host_ioc").alias("ioc")).where("ioc IS NOT NULL")


def latest_reports(updates: DataFrame, start: int, order_col: str = "seq") -> DataFrame:
    """The last report of each indicator, in the columns of ``IOC``.

    Indicator, type and severity are trimmed and lower-cased; source and severity default to
    ``community`` and ``high``; reports without an indicator or a type are left out. Every report
    takes the next id after ``start`` in the order of ``order_col``, which may be of any type
    (nulls first; ties by the other columns), as inserting one by one would give it, and keeps
    it if it is the last of its indicator. So batches of reports that follow each other
    give the same ids as all of them at once.
    """
    clean = updates.select(
        F.col(order_col).alias("_order"),
        *(F.lower(F.trim(c)).alias(c) for c in ("indicator", "indicator_type")),
        F.coalesce("source", F.lit("community")).alias("source"),
        F.coalesce(F.lower(F.trim("severity")), F.lit("high")).alias("severity"),
        "description",
    ).where("indicator IS NOT NULL AND indicator_type IS NOT NULL")
    rows = numbered(clean, "_n", "_order", "indicator", *_MATCH[1:])
    rows = rows.select((F.col("_n") + F.lit(start).cast("long")).alias("id"), *_MATCH, F.current_timestamp().alias("created_at"))
    # a maximum is found in part where the reports are read, so no indicator is a hot key
    return rows.groupBy("indicator").agg(F.max_by(F.struct(*rows.columns), "id").alias("r")).select("r.*")


def replace_reported(iocs: DataFrame, latest: DataFrame) -> DataFrame:
    """``iocs`` with the rows of ``latest``, one for each indicator, in place of theirs."""
    kept = iocs.join(latest.select("indicator"), "indicator", "left_anti").select(*latest.columns)
    return kept.unionByName(latest)


def upsert_iocs(iocs: DataFrame, updates: DataFrame, order_col: str = "seq") -> DataFrame:
    """The table after the updates, in the columns of ``IOC``: the last report of an
    indicator (``latest_reports``) replaces its row under a new id, after the largest."""
    top = iocs.agg(F.max("id")).first()[0] or 0
    return replace_reported(iocs, latest_reports(updates, top, order_col))


def list_iocs(iocs: DataFrame, n: int = 100) -> DataFrame:
    """The latest ``n`` indicators by id."""
    return iocs.orderBy(F.desc("id")).limit(n)


def ioc_signal(ioc: str) -> Column:
    """The signal of a match, without ord and weight; null without a match."""
    text = (
        f"concat('Matched active threat indicator ''', {ioc}.indicator, ''' in reputation database', "
        f"if(coalesce({ioc}.source, '') <> '', concat(' (', {ioc}.source, ')'), ''), if(coalesce({ioc}.description, '') <> '', concat(': ', {ioc}.description), ''))"
    )
    return F.expr(f"CASE WHEN {ioc} IS NOT NULL THEN named_struct('name', 'Known malicious IOC', 'severity', {ioc}.severity, 'evidence', {text}) END")
