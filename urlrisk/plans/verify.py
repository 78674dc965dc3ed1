"""The full verification of a URL table."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.config import RiskConfig
from urlrisk.functions.text import settle
from urlrisk.operators.brand import brand_hits, first_brand
from urlrisk.operators.detectors import Detector, left_out, own_signals, with_own
from urlrisk.operators.entropy import host_entropy_signal, path_entropy_signal
from urlrisk.operators.heuristics import host_heuristics, url_heuristics, with_long_host_lists, with_long_url_lists
from urlrisk.operators.homoglyph import imitated, is_mixed, look_alikes
from urlrisk.operators.iocs import ioc_signal, match_hosts, match_urls
from urlrisk.operators.normalize import host_table, normalize_urls, split_malformed
from urlrisk.operators.scoring import judge, malformed_verdicts, suppress_trusted
from urlrisk.operators.signals import gather, signal
from urlrisk.operators.typosquat import first_resemblance, flag_trusted, similar_domains, typosquat_evidence
from urlrisk.schemas import RANKED_SIGNAL
from urlrisk.sources.reference import References
from urlrisk.sources.scratch import written
from urlrisk.sources.urls import spread


def domain_signals(hosts: DataFrame, refs: References, cfg: RiskConfig, with_typos: bool = True) -> DataFrame:
    """``registered_domain, is_listed, typo`` once for each registered domain of ``hosts``."""
    names = hosts.where("NOT is_ip AND registered_domain <> ''").select(F.lower("registered_domain").alias("registered_domain")).distinct()
    if not with_typos:
        return flag_trusted(names, refs.trusted).withColumn("typo", F.lit(None).cast(RANKED_SIGNAL))
    typo = first_resemblance(similar_domains(names, refs.trusted, cfg))
    found = flag_trusted(names, refs.trusted).join(typo, "registered_domain", "left")
    return found.select("registered_domain", "is_listed", F.when(F.col("rule").isNotNull(), signal("typosquat", "Typosquatting", "high", typosquat_evidence())).alias("typo"))


def host_signals(
    hosts: DataFrame, refs: References, cfg: RiskConfig, detectors: Sequence[Detector] = (), without: frozenset[str] = frozenset()
) -> DataFrame:
    """``hostname, registered_domain, subdomain, is_listed, host_signals`` for each host of
    ``host_table``; the signals are those that depend on the host alone, those of own
    ``detectors`` of hosts and domains among them, and none of the places in ``without``."""
    plain = hosts
    hosts = with_long_host_lists(hosts, refs)
    brands = first_brand(brand_hits(hosts.where("NOT is_ip"), refs))
    domains = domain_signals(hosts, refs, cfg, "typosquat" not in without).withColumnRenamed("registered_domain", "domain_key")
    h = hosts.join(domains, F.lower("registered_domain") == F.col("domain_key"), "left").join(brands, "hostname", "left")
    h = settle(h.withColumn("imitated", imitated("unicode_domain", "registered_domain")), "imitated")
    fakes = refs.trusted.select(F.col("domain").alias("imitated"), F.lit(True).alias("is_fake")).distinct()
    h = h.join(fakes, "imitated", "left").withColumn("alike", look_alikes("unicode_domain")).withColumn("mixed", is_mixed("unicode_domain"))
    h = settle(h, "alike", "mixed")
    named = ~F.col("is_ip")
    scripts = F.when(
        named & F.col("mixed"),
        signal("scripts", "Mixed-script domain spoofing", "high", F.lit("Domain contains characters from multiple scripts that may imitate a trusted domain")),
    ).when(
        named & (F.size("alike") > 0),
        signal("scripts", "Homoglyph characters detected", "medium", F.concat(F.lit("Domain contains characters visually resembling Latin characters: "), F.array_join("alike", ", "))),
    )
    punycode = signal(
        "punycode", "Punycode domain detected", "medium", F.concat(F.lit("Domain uses Punycode encoding ("), "hostname", F.lit(" -> "), "unicode_domain", F.lit(")"))
    )
    fake = signal(
        "homoglyph_brand", "Homoglyph brand impersonation", "high", F.concat(F.lit("Homoglyph-normalized domain '"), "imitated", F.lit("' imitates trusted domain '"), "imitated", F.lit("'"))
    )
    brand = signal("brand", F.col("brand_name"), "high", F.col("brand_evidence"))
    every = {
        "typosquat": F.when(named, F.col("typo")),
        "punycode": F.when(named & F.col("is_punycode"), punycode),
        "scripts": scripts,
        "homoglyph_brand": F.when(named & F.col("is_fake"), fake),
        "entropy_host": F.when(named, host_entropy_signal(cfg)),
        "brand": F.when(named & F.col("brand_name").isNotNull(), brand),
        **host_heuristics(refs, cfg),
    }
    found = gather(*(s for place, s in every.items() if place not in without))
    if any(d.grain in ("host", "domain") for d in detectors):
        names = plain.where("NOT is_ip AND registered_domain <> ''").select(F.lower("registered_domain").alias("registered_domain")).distinct()
        h = with_own(h, own_signals(plain, detectors, "host"), "host")
        h = with_own(h, own_signals(names, detectors, "domain"), "domain", "CASE WHEN NOT is_ip THEN lower(registered_domain) END")
        found = F.concat(found, "own_host", "own_domain")
    return h.select("hostname", "registered_domain", "subdomain", F.coalesce("is_listed", F.lit(False)).alias("is_listed"), found.alias("host_signals"))


def signal_table(
    n: DataFrame, iocs: DataFrame, refs: References, cfg: RiskConfig | None = None, detectors: Sequence[Detector] = (), without: Collection[str] = ()
) -> DataFrame:
    """``url_id, ioc, is_trusted, signals`` for each valid URL of ``normalize_urls``: all its
    signals in order, before trusted domains suppress any. ``detectors`` add their own,
    and those named in ``without`` (``signals.ORDER``) give none.

    What depends on the host is found once per distinct host and joined to the URLs by one
    equi join, in which a host that very many URLs share is split by adaptive execution.
    """
    cfg = cfg or RiskConfig()
    gone = left_out(without, detectors)
    valid, _ = split_malformed(n)
    hosts = written(host_table(n, refs.suffix_rules), "hosts")
    known = host_signals(hosts, refs, cfg, detectors, gone).join(match_hosts(hosts, iocs), "hostname", "left")
    rows = match_urls(with_long_url_lists(valid, refs), iocs).join(written(known, "host_signals"), "hostname").withColumn("ioc", F.coalesce("url_ioc", "host_ioc"))
    ioc = F.when(F.col("ioc").isNotNull(), F.struct(F.lit(0).alias("ord"), *(F.col("s")[c].alias(c) for c in ("name", "severity", "evidence")), F.lit(0).alias("weight")))
    rows = rows.withColumn("s", ioc_signal("ioc"))
    every = {"entropy_path": F.when(~F.col("is_ip"), path_entropy_signal(cfg)), **url_heuristics(refs, cfg)}
    own = gather(ioc, *(s for place, s in every.items() if place not in gone))
    if any(d.grain == "url" for d in detectors):
        rows = with_own(rows, own_signals(valid, detectors, "url"), "url")
        own = F.concat(own, "own_url")
    return rows.select(
        "url_id",
        "hostname",
        "registered_domain",
        "ioc",
        (F.col("is_listed") & F.col("ioc").isNull()).alias("is_trusted"),
        F.array_sort(F.concat(own, "host_signals")).alias("signals"),
    )


def verify_urls(
    urls: DataFrame,
    iocs: DataFrame,
    refs: References,
    cfg: RiskConfig | None = None,
    with_domain: bool = False,
    detectors: Sequence[Detector] = (),
    without: Collection[str] = (),
) -> DataFrame:
    """One verdict for each row of ``urls(url_id, url)``, whose ids must be unique; null and
    empty URLs have to be split off before (``split_accepted``). The normalized URLs are
    written once: the distinct hosts, the valid and the malformed URLs are read from that
    table by their columns. ``with_domain`` adds ``registered_domain``, null for malformed
    URLs. ``detectors`` of one's own add signals or take the place of a built-in one, and
    built-in ones named in ``without`` are left out; any table of indicators is a provider."""
    n = written(normalize_urls(spread(urls)), "normalized")
    rows = signal_table(n, iocs, refs, cfg, detectors, without).withColumn("signals", suppress_trusted("signals", "is_trusted"))
    also = ("registered_domain",) if with_domain else ()
    return judge(rows, *also).unionByName(malformed_verdicts(split_malformed(n)[1]), allowMissingColumns=True)


def message_risk(verdicts: DataFrame, urls: DataFrame) -> DataFrame:
    """``msg_id, n_urls, n_signals, worst_score, worst_level, worst_url_id`` over the URLs of
    each message; ``urls(url_id, msg_id)``. Ties go to the smallest ``url_id``."""
    v = verdicts.join(urls.select("url_id", "msg_id"), "url_id")
    worst = F.max_by(F.struct("risk_level", "url_id"), F.struct("risk_score", -F.col("url_id"))).alias("w")
    v = v.groupBy("msg_id").agg(F.count("*").alias("n_urls"), F.sum(F.size("signals")).alias("n_signals"), F.max("risk_score").alias("worst_score"), worst)
    return v.select("msg_id", "n_urls", "n_signals", "worst_score", F.col("w.risk_level").alias("worst_level"), F.col("w.url_id").alias("worst_url_id"))


def campaign_rollup(verdicts: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """Counts and mean scores by registered domain and risk level, with subtotals (null is
    all), of verdicts with their ``registered_domain``, or of those that have one in
    ``domains(url_id, registered_domain)``. URLs without one are left out."""
    rows = verdicts if domains is None else verdicts.join(domains, "url_id")
    out = rows.where("registered_domain IS NOT NULL").rollup("registered_domain", "risk_level").agg(
        F.count("*").alias("n_urls"), F.count_if("known_ioc").alias("n_iocs"), F.round(F.avg("risk_score"), 4).alias("mean_score"), F.max("risk_score").alias("max_score")
    )
    return out
