"""The registered queries over a folder of tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.config import RiskConfig
from urlrisk.functions.text import entropy
from urlrisk.operators.brand import brand_hits
from urlrisk.operators.detectors import Detector
from urlrisk.operators.entropy import host_entropy_signal, path_entropy_signal
from urlrisk.operators.heuristics import host_heuristics, url_heuristics
from urlrisk.operators.homoglyph import imitated, is_mixed, look_alikes
from urlrisk.operators.iocs import ioc_candidates, ioc_signal, list_iocs, match_iocs, upsert_iocs
from urlrisk.operators.normalize import decode_idn, distinct_hosts, host_table, normalize_urls, registered_domains, split_malformed
from urlrisk.operators.scoring import LURES, classify, confidence, judge, malformed_verdicts, recommend, risk_level, risk_score, severity_counts, suppress_trusted
from urlrisk.operators.typosquat import first_resemblance, flag_trusted, similar_domains
from urlrisk.plans import fixtures, oracles
from urlrisk.plans.verify import campaign_rollup, message_risk, signal_table, verify_urls
from urlrisk.sources.ioc_table import IocTable
from urlrisk.sources.reference import References, default_iocs, load_iocs, reference_tables
from urlrisk.sources.scratch import folder, written
from urlrisk.sources.urls import extract_urls, read_urls, split_accepted, verdict_json, write_verdicts
from urlrisk.streaming.streams import current_iocs, ioc_report_stream, stream_of, verify_stream

Query = Callable[[SparkSession, str], DataFrame]
CFG = RiskConfig()


class Run:
    """What the queries over one folder have in common, built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def refs(self) -> References:
        return reference_tables(self.spark)

    @property
    def iocs(self) -> DataFrame:
        return load_iocs(self.spark)

    @property
    def urls(self) -> DataFrame:
        return split_accepted(fixtures.url_corpus(self.spark, self.sf_dir))[0]

    @property
    def norm(self) -> DataFrame:
        return normalize_urls(self.urls)

    @property
    def hosts(self) -> DataFrame:
        return written(host_table(self.norm, self.refs.suffix_rules), "hosts")

    @property
    def valid(self) -> DataFrame:
        """Valid URLs with the columns of their hosts."""
        return self.norm.where("is_valid").join(self.hosts.drop("is_ip", "ip_address"), "hostname")

    @property
    def names(self) -> DataFrame:
        hosts = self.hosts.where("NOT is_ip").select(F.lower("registered_domain").alias("registered_domain")).distinct()
        return written(hosts, "domains")

    @property
    def signals(self) -> DataFrame:
        return signal_table(self.norm, self.iocs, self.refs, CFG)

    @property
    def judged(self) -> DataFrame:
        return judge(self.signals.withColumn("signals", suppress_trusted("signals", "is_trusted")))

    @property
    def verdicts(self) -> DataFrame:
        return verify_urls(self.urls, self.iocs, self.refs, CFG)

    @property
    def updates(self) -> DataFrame:
        return fixtures.ioc_feed(self.spark, self.sf_dir)


def _flat(verdicts: DataFrame) -> DataFrame:
    """Verdicts with the signals as one text."""
    return verdicts.withColumn("signals", F.expr("array_join(transform(signals, s -> concat_ws('|', s.name, s.severity, s.evidence)), ';')"))


def _long(rows: DataFrame, signal) -> DataFrame:
    out = rows.select("url_id", signal.alias("s")).where("s IS NOT NULL")
    return out.select("url_id", "s.name", "s.severity", "s.evidence", "s.weight")


def read_tables(r: Run) -> DataFrame:
    """The corpus from three formats, with what is rejected of each."""
    out = None
    for fmt in ("parquet", "csv", "json"):
        at = folder(r.spark, fmt)
        if fmt == "parquet":
            fixtures.url_corpus(r.spark, r.sf_dir).write.parquet(at)
        else:
            fixtures.url_lines(r.spark, r.sf_dir, fmt).write.text(at)
        for accepted, rows in zip((True, False), read_urls(r.spark, at, fmt), strict=True):
            rows = rows.select(F.lit(fmt).alias("fmt"), F.lit(accepted).alias("accepted"), "url_id", "url")
            out = rows if out is None else out.unionByName(rows)
    return out


def ioc_seed(r: Run) -> DataFrame:
    hits = match_iocs(r.norm, r.hosts, r.iocs).select(F.col("ioc.indicator").alias("indicator"), "url_id")
    return r.iocs.join(hits, "indicator", "left").groupBy("id", "indicator", "severity").agg(F.count("url_id").alias("n_urls"))


def brand_domains(r: Run) -> DataFrame:
    used = r.valid.select("url_id", F.lower("registered_domain").alias("legit_domain"))
    return r.refs.brands.join(used, "legit_domain", "left").groupBy("pos", "brand", "legit_domain").agg(F.count("url_id").alias("n_urls"))


def registered_domain(r: Run) -> DataFrame:
    return registered_domains(written(distinct_hosts(r.norm), "hosts"), r.refs.suffix_rules)


def public_suffixes(r: Run) -> DataFrame:
    hosts = fixtures.suffix_hosts(r.spark, r.sf_dir).selectExpr("hostname", "false AS is_ip", "CAST(NULL AS string) AS ip_address")
    return registered_domains(hosts, r.refs.suffix_rules)


def ioc_match(r: Run) -> DataFrame:
    return match_iocs(r.norm, r.hosts, r.iocs).select("url_id", "ioc.*")


def ioc_signals(r: Run) -> DataFrame:
    return match_iocs(r.norm, r.hosts, r.iocs).select("url_id", ioc_signal("ioc").alias("s")).select("url_id", "s.*")


def ioc_upsert(r: Run) -> DataFrame:
    return upsert_iocs(r.iocs, r.updates).drop("created_at")


def ioc_top(r: Run) -> DataFrame:
    return list_iocs(upsert_iocs(r.iocs, r.updates), 5).select("id", "indicator", "source", "severity")


def trusted_flag(r: Run) -> DataFrame:
    hosts, n = r.hosts, r.norm
    flags = flag_trusted(hosts.select("hostname", F.lower("registered_domain").alias("registered_domain")), r.refs.trusted)
    known = match_iocs(n, hosts, r.iocs).select("url_id", F.lit(True).alias("known"))
    rows = n.where("is_valid").join(flags, "hostname").join(known, "url_id", "left")
    return rows.select("url_id", (F.col("is_listed") & F.col("known").isNull()).alias("is_trusted"))


def _similar(rule: int) -> Callable[[Run], DataFrame]:
    # direct look-alikes by the join on variants, the others by the literal list
    return lambda r: similar_domains(r.names, r.refs.trusted, CFG, path="join" if rule == 1 else "auto").where(F.col("rule") == rule).select("registered_domain", "pos", "domain")


def homoglyph_chars(r: Run) -> DataFrame:
    found = r.hosts.where("NOT is_ip").where(~is_mixed("unicode_domain"))
    return found.select("hostname", F.array_join(look_alikes("unicode_domain"), ", ").alias("characters")).where("characters <> ''")


def homoglyph_brand(r: Run) -> DataFrame:
    fakes = r.hosts.where("NOT is_ip").select("hostname", imitated("unicode_domain", "registered_domain").alias("imitated"))
    return fakes.join(r.refs.trusted.select(F.col("domain").alias("imitated")), "imitated").select("hostname", "imitated")


def _brands(rule: int, *cols: str) -> Callable[[Run], DataFrame]:
    return lambda r: brand_hits(r.hosts.where("NOT is_ip"), r.refs).where(F.col("rule") == rule).select("hostname", "brand", "rd", *cols)


def _exploded(rows: DataFrame) -> DataFrame:
    return rows.select("url_id", F.explode("signals").alias("s")).select("url_id", F.col("s.ord").alias("signal_ord"), "s.name", "s.severity", "s.evidence", "s.weight")


def suppressed(r: Run) -> DataFrame:
    rows = r.signals
    gone = rows.where("is_trusted").select("url_id", F.explode(F.array(*map(F.lit, LURES))).alias("name"))
    return _exploded(rows).join(gone, ["url_id", "name"], "left_anti").select("url_id", "signal_ord", "name")


def _scored(r: Run) -> DataFrame:
    rows = r.signals.withColumn("signals", suppress_trusted("signals", "is_trusted"))
    return rows.withColumns(severity_counts("signals")).withColumn("risk_score", risk_score("signals", "ioc"))


def message_risks(r: Run) -> DataFrame:
    found = extract_urls(fixtures.messages(r.spark, r.sf_dir), suffix_rules=r.refs.suffix_rules)
    corpus = r.urls.select("url_id", F.trim("url").alias("url"))
    pairs = found.join(corpus, "url").select("msg_id", "url_id").distinct()
    return message_risk(r.verdicts, pairs)


def campaigns(r: Run) -> DataFrame:
    return campaign_rollup(verify_urls(r.urls, r.iocs, r.refs, CFG, with_domain=True))


def verdict_table(r: Run) -> DataFrame:
    """What a reader of the written table sees, after one of two runs was written again."""
    at = folder(r.spark, "verdicts")
    verdicts = verify_urls(r.urls, r.iocs, r.refs, CFG, with_domain=True)
    for run, part in (("even", "url_id % 2 = 0"), ("odd", "url_id % 2 = 1"), ("even", "url_id % 2 = 0")):
        write_verdicts(verdicts.where(part), at, run=run)
    table = r.spark.read.parquet(at).where("risk_level IN ('HIGH', 'CRITICAL')")
    return table.groupBy("run", "risk_level", "registered_domain").agg(F.count("*").alias("n_urls"), F.max("risk_score").alias("max_score"))


#: Detectors of one's own, one of each grain.
OWN_DETECTORS = (
    Detector("url", lambda n: n.where("scheme = 'http' AND contains(lower(path), 'login')").selectExpr(
        "url_id", "'Login over plain HTTP' AS name", "'medium' AS severity", "concat('Path ', path, ' is not encrypted on its way') AS evidence", "7 AS weight")),
    Detector("host", lambda h: h.where("NOT is_ip AND regexp_count(hostname, '[0-9]') >= 4").selectExpr(
        "hostname", "'Excessive digits in hostname' AS name", "'low' AS severity", "concat('Hostname contains ', regexp_count(hostname, '[0-9]'), ' digits') AS evidence")),
    Detector("domain", lambda d: d.where("length(registered_domain) > 25").selectExpr(
        "registered_domain", "'Long domain' AS name", "'low' AS severity", "concat('Domain has ', length(registered_domain), ' characters') AS evidence", "3 AS weight")),
)


def own_detectors(r: Run) -> DataFrame:
    return _flat(verify_urls(r.urls, r.iocs, r.refs, CFG, detectors=OWN_DETECTORS, without=["subdomains"]))


def streamed_verdicts(r: Run) -> DataFrame:
    at = folder(r.spark, "stream")
    stream = stream_of(r.spark, r.urls, f"{at}/urls")
    verify_stream(stream, r.iocs, r.refs, f"{at}/verdicts", f"{at}/state", CFG).awaitTermination()
    return _flat(r.spark.read.parquet(f"{at}/verdicts").drop("batch"))


def _third(df: DataFrame, k: int, path: str) -> DataFrame:
    """One third of ``df`` arrives in ``path``, which is read as a stream."""
    rows = df.where(F.col("third") == k).drop("third")
    rows.write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(rows.schema).parquet(path)


def streamed_iocs(r: Run) -> DataFrame:
    """Three batches of reports, merged after the second."""
    at, seeds = folder(r.spark, "reports"), default_iocs(r.spark)
    reports = fixtures.thirds(r.spark, r.sf_dir)[1]
    for k in range(3):
        ioc_report_stream(_third(reports, k, f"{at}/reports"), f"{at}/iocs", seeds, f"{at}/state", compact_every=2).awaitTermination()
    return current_iocs(r.spark, f"{at}/iocs", seeds).drop("created_at")


def live_verdicts(r: Run) -> DataFrame:
    """Each third of the URLs is verified with the reports that came before it."""
    at, seeds = folder(r.spark, "live"), default_iocs(r.spark)
    urls, reports = fixtures.thirds(r.spark, r.sf_dir)
    table = IocTable(r.spark, f"{at}/iocs", seeds)
    for k in range(3):
        verify_stream(_third(urls, k, f"{at}/urls"), table, r.refs, f"{at}/verdicts", f"{at}/state", CFG).awaitTermination()
        ioc_report_stream(_third(reports, k, f"{at}/reports"), f"{at}/iocs", seeds, f"{at}/reports_state", compact_every=2).awaitTermination()
    return _flat(r.spark.read.parquet(f"{at}/verdicts").drop("batch"))


BUILDERS: dict[str, Callable[[Run], DataFrame]] = {
    "read_urls": lambda r: r.urls,
    "read_tables": read_tables,
    "extract_urls": lambda r: extract_urls(fixtures.messages(r.spark, r.sf_dir), suffix_rules=r.refs.suffix_rules),
    "ioc_seed": ioc_seed,
    "brand_domains": brand_domains,
    "verdict_json": lambda r: verdict_json(r.verdicts),
    "normalize_components": lambda r: r.norm.select("url_id", "original_url", "scheme", "hostname", "path", "query", "port", "is_valid"),
    "host_ip": lambda r: distinct_hosts(r.norm),
    "registered_domain": registered_domain,
    "public_suffixes": public_suffixes,
    "idn_hosts": lambda r: decode_idn(distinct_hosts(r.norm)),
    "canonical_url": lambda r: r.norm.select("url_id", "normalized_url"),
    "malformed": lambda r: split_malformed(r.norm)[1].select("url_id", "original_url", "error"),
    "ioc_candidates": lambda r: ioc_candidates(r.valid),
    "ioc_match": ioc_match,
    "ioc_upsert": ioc_upsert,
    "ioc_top": ioc_top,
    "ioc_signals": ioc_signals,
    "trusted_flag": trusted_flag,
    "typosquat_direct": _similar(1),
    "typosquat_leet": _similar(2),
    "typosquat_combo": _similar(3),
    "typosquat": lambda r: first_resemblance(similar_domains(r.names, r.refs.trusted, CFG)),
    "punycode": lambda r: r.hosts.where("NOT is_ip AND is_punycode").select("hostname", "unicode_domain"),
    "mixed_script": lambda r: r.hosts.where("NOT is_ip").where(is_mixed("unicode_domain")).select("hostname"),
    "homoglyph_chars": homoglyph_chars,
    "homoglyph_brand": homoglyph_brand,
    "brand_subdomain": _brands(1),
    "brand_sld": _brands(2, "lure"),
    "brand": lambda r: _exploded(r.signals).where("signal_ord = 21").select("url_id", "name", "severity", "evidence"),
    "entropy": lambda r: r.hosts.select("hostname", entropy("split_part(registered_domain, '.', 1)").alias("h")),
    "entropy_host": lambda r: _long(r.valid.where("NOT is_ip"), host_entropy_signal(CFG)),
    "entropy_path": lambda r: _long(r.norm.where("is_valid AND NOT is_ip"), path_entropy_signal(CFG)),
    **{f"sig_{k}": (lambda r, k=k: _long(r.valid, host_heuristics(r.refs, CFG)[k])) for k in ("raw_ip", "tld", "subdomains", "hyphens", "long_host")},
    **{
        f"sig_{k}": (lambda r, k=k: _long(r.norm.where("is_valid"), url_heuristics(r.refs, CFG)[k]))
        for k in ("long_url", "at", "nested", "percent", "params", "port", "credential", "financial", "urgency")
    },
    "signals_long": lambda r: _exploded(r.signals),
    "suppressed": suppressed,
    "risk_score": lambda r: _scored(r).select("url_id", "risk_score"),
    "risk_level": lambda r: _scored(r).select("url_id", risk_level("risk_score").alias("risk_level")),
    "classification": lambda r: _scored(r).select("url_id", classify().alias("classification")),
    "confidence": lambda r: _scored(r).select("url_id", confidence().alias("confidence")),
    "recommendation": lambda r: _scored(r).withColumn("classification", classify()).select("url_id", recommend().alias("recommendation")),
    "malformed_verdict": lambda r: _flat(malformed_verdicts(split_malformed(r.norm)[1])),
    "verify_urls": lambda r: _flat(r.verdicts),
    "message_risk": message_risks,
    "campaign_rollup": campaigns,
    "verify_stream": streamed_verdicts,
    "verify_stream_live": live_verdicts,
    "ioc_report_stream": streamed_iocs,
    "own_detectors": own_detectors,
    "verdict_table": verdict_table,
}


def queries() -> dict[str, Query]:
    return {name: (lambda spark, sf_dir, build=build: build(Run(spark, sf_dir))) for name, build in BUILDERS.items()}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
