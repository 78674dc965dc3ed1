"""URL normalization: components of each URL, and facts of each distinct host."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlrisk.functions.idna import to_ascii, to_unicode
from urlrisk.functions.text import settle
from urlrisk.sources.scratch import written

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+\-.]*://"
#: Schemes whose last path segment may carry parameters after a semicolon.
_PARAM_SCHEMES = ("ftp", "hdl", "prospero", "http", "https", "imap", "itms-services", "shttp", "rtsp", "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel")
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


@F.pandas_udf(T.StringType())
def _ipv6(hosts: pd.Series) -> pd.Series:
    """The canonical text of an IPv6 address, or null."""

    def one(h):
        try:
            return str(ipaddress.IPv6Address(h))
        except ValueError:
            return None

    return hosts.map(one, na_action="ignore")


def normalize_urls(urls: DataFrame) -> DataFrame:
    """``urls(url_id, url)`` to one row each: ``url_id, original_url, normalized_url, scheme,
    hostname, path, query, port int, is_ip, ip_address, is_valid, error``.

    Built-in functions only, but for IPv6 hosts. Blank URLs, unbalanced or non-IPv6
    brackets and URLs without a host are not valid and say so in ``error``.
    """
    raw = urls.select("url_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"(?U)^\s+|\s+$", "").alias("original_url"))
    # tabs and line ends inside a URL don't count, but for its length and its signs
    n = raw.withColumn("w", F.regexp_replace(F.when(F.col("original_url").rlike(_SCHEME), F.col("original_url")).otherwise(F.concat(F.lit("http://"), "original_url")), r"[\t\r\n]", ""))
    n = n.withColumn("scheme", F.lower(F.split_part("w", F.lit("://"), F.lit(1)))).withColumn("rest", F.expr("substr(w, length(scheme) + 4)"))
    n = n.withColumn("netloc", F.regexp_extract("rest", r"^[^/?#]*", 0))
    n = n.withColumn("tail", F.expr("split_part(substr(rest, length(netloc) + 1), '#', 1)"))
    n = n.withColumn("p", F.split_part("tail", F.lit("?"), F.lit(1))).withColumn("query", F.expr("substr(tail, length(p) + 2)"))
    n = n.withColumn("p", F.when(F.col("scheme").isin(*_PARAM_SCHEMES), F.regexp_replace("p", r";[^/]*$", "")).otherwise(F.col("p")))
    n = settle(n.select("url_id", "original_url", "scheme", "netloc", "p", "query"))
    n = n.withColumn("hostinfo", F.regexp_extract("netloc", r"[^@]*$", 0))
    n = n.withColumn("bracketed", F.col("hostinfo").contains("["))
    n = n.withColumn("inner", F.expr("CASE WHEN bracketed THEN regexp_extract(hostinfo, '\\\\[([^\\\\]]*)', 1) END"))
    n = settle(n, "hostinfo", "bracketed", "inner")
    n = n.withColumn("v6", F.when(F.col("inner").isNotNull(), _ipv6("inner")))
    n = n.withColumn(
        "broken",
        F.expr(
            "contains(netloc, '[') <> contains(netloc, ']') OR (bracketed AND (NOT startswith(hostinfo, '[') "
            "OR NOT regexp_replace(hostinfo, '^[^\\\\]]*\\\\]', '') RLIKE '^(:.*)?$' OR (v6 IS NULL AND NOT inner RLIKE '^[vV][0-9a-fA-F]+\\\\..+$')))"
        ),
    )
    n = n.withColumn("parsed_host", F.lower(F.expr("CASE WHEN bracketed THEN inner ELSE split_part(hostinfo, ':', 1) END")))
    n = n.withColumn("port_text", F.expr("CASE WHEN bracketed THEN regexp_extract(hostinfo, '\\\\]:(.*)$', 1) ELSE regexp_extract(hostinfo, '^[^:]*:(.*)$', 1) END"))
    n = n.withColumn("number", F.expr("CASE WHEN port_text RLIKE '^[0-9]+$' THEN try_cast(port_text AS decimal(38,0)) END"))
    n = settle(n, "v6", "broken", "parsed_host", "port_text", "number")
    n = n.withColumn("bad_port", F.expr("port_text <> '' AND (number IS NULL OR number > 65535)"))
    n = n.withColumn("cut", F.lower(F.split_part("netloc", F.lit(":"), F.lit(1))))
    n = n.withColumn("hostname", F.expr("CASE WHEN original_url = '' OR broken THEN '' WHEN bad_port OR parsed_host = '' THEN cut ELSE parsed_host END"))
    n = settle(n, "bad_port", "cut", "hostname")
    n = n.withColumn("port", F.expr("CASE WHEN hostname <> '' AND NOT bad_port THEN cast(number AS int) END"))
    n = n.withColumn("ip_address", F.expr(f"CASE WHEN hostname RLIKE '{IPV4.replace(chr(92), chr(92) * 2)}' THEN hostname WHEN bracketed AND hostname = parsed_host THEN v6 END"))
    n = settle(n, "port", "ip_address")
    blank = F.col("hostname") == ""
    n = n.withColumn("path", F.expr("CASE WHEN hostname = '' AND (original_url = '' OR broken) THEN '' WHEN p = '' THEN '/' ELSE p END"))
    shown = F.expr(
        "concat(hostname, CASE WHEN port > 0 AND ((scheme = 'http' AND port <> 80) OR (scheme = 'https' AND port <> 443)) THEN concat(':', port) ELSE '' END)"
    )
    plain = F.expr("original_url = '' OR broken")
    return settle(n.select(
        "url_id",
        "original_url",
        F.when(plain, F.col("original_url")).otherwise(F.concat("scheme", F.lit("://"), shown, "path", F.expr("if(query = '', '', concat('?', query))"))).alias("normalized_url"),
        F.when(plain, "").otherwise(F.col("scheme")).alias("scheme"),
        "hostname",
        "path",
        F.when(plain, "").otherwise(F.col("query")).alias("query"),
        "port",
        F.col("ip_address").isNotNull().alias("is_ip"),
        "ip_address",
        (~blank).alias("is_valid"),
        F.expr(
            "CASE WHEN original_url = '' THEN 'Empty URL provided' WHEN broken THEN 'Malformed URL: Invalid IPv6 URL' "
            "WHEN hostname = '' THEN 'Could not determine hostname from URL' END"
        ).alias("error"),
    ))


def split_malformed(n: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, malformed) rows of ``normalize_urls``."""
    return n.where("is_valid"), n.where("NOT is_valid")


def distinct_hosts(n: DataFrame) -> DataFrame:
    """``hostname, is_ip, ip_address`` once for each host of the valid URLs."""
    return n.where("is_valid").select("hostname", "is_ip", "ip_address").distinct()


def suffix_sizes(hosts: DataFrame, suffix_rules: DataFrame) -> DataFrame:
    """``hostname, n_suffix``: how many labels the public suffix of each of ``hosts(hostname)``,
    distinct, has; hosts without a rule are left out.

    The longest suffix of the host that equals a rule counts (a wildcard stands for one
    label); an exception rule beats all and names a suffix one label shorter. An equi join
    on the suffixes of each host.
    """
    h = hosts.select("hostname", F.split("hostname", r"\.").alias("labels"))
    tails = h.select("hostname", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("k"))
    tails = tails.withColumn("tail", F.expr("array_join(slice(labels, size(labels) - k + 1, k), '.')"))
    star = F.expr("array_join(concat(array('*'), slice(labels, size(labels) - k + 2, k - 1)), '.')")
    keys = tails.select("hostname", "k", F.explode(F.array(F.struct(F.col("tail").alias("rule")), F.struct(star.alias("rule")))).alias("s")).select("hostname", "k", "s.rule")
    hits = keys.join(suffix_rules, "rule")
    return hits.groupBy("hostname").agg(F.max_by(F.expr("if(kind = 'exception', k - 1, k)"), F.expr("struct(kind = 'exception', k)")).alias("n_suffix"))


def with_domains(hosts: DataFrame, suffix_rules: DataFrame) -> DataFrame:
    """``hosts``, distinct, with ``registered_domain`` and ``subdomain`` (``registered_domains``)."""
    best = suffix_sizes(hosts.where("NOT is_ip"), suffix_rules)
    h = settle(hosts.withColumn("labels", F.split("hostname", r"\.")), "labels")
    j = h.join(best, "hostname", "left").withColumn("keep", F.expr("CASE WHEN n_suffix IS NULL THEN 2 ELSE n_suffix + 1 END"))
    whole = F.expr("size(labels) <= coalesce(n_suffix, 1)")
    j = j.select(
        *hosts.columns,
        F.when(F.col("is_ip"), F.col("ip_address")).when(whole, F.col("hostname")).otherwise(F.expr("array_join(slice(labels, greatest(size(labels) - keep + 1, 1), keep), '.')")).alias("registered_domain"),
        F.when(F.col("is_ip") | whole, "").otherwise(F.expr("array_join(slice(labels, 1, greatest(size(labels) - keep, 0)), '.')")).alias("subdomain"),
    )
    return settle(j, "registered_domain", "subdomain")


def registered_domains(hosts: DataFrame, suffix_rules: DataFrame) -> DataFrame:
    """``hosts(hostname, is_ip, ip_address)``, distinct, to ``hostname, registered_domain, subdomain``.

    The public suffix of the host (``suffix_sizes``) plus one label. Hosts without
    a rule: the last two labels; a single label, or a suffix alone, is itself; so is an
    IP address.
    """
    return with_domains(hosts, suffix_rules).select("hostname", "registered_domain", "subdomain")


@F.pandas_udf(T.StructType([T.StructField("is_punycode", T.BooleanType()), T.StructField("unicode_domain", T.StringType())]))
def _idn(hosts: pd.Series) -> pd.DataFrame:
    """By the IDNA rules of 2008."""

    def one(h: str) -> tuple[bool, str]:
        if "xn--" in h:
            return True, to_unicode(h) or h
        return "xn--" in (to_ascii(h) or ""), h

    return pd.DataFrame([one(h) for h in hosts], columns=["is_punycode", "unicode_domain"])


def with_idn(hosts: DataFrame) -> DataFrame:
    """``hosts`` with ``is_punycode`` and ``unicode_domain`` (``decode_idn``)."""
    odd = F.col("hostname").contains("xn--") | F.col("hostname").rlike(r"[^\x00-\x7F]")
    rare = hosts.where(odd).withColumn("i", _idn("hostname")).select(*hosts.columns, "i.*")
    plain = hosts.where(~odd).select("*", F.lit(False).alias("is_punycode"), F.col("hostname").alias("unicode_domain"))
    return plain.unionByName(rare)


def decode_idn(hosts: DataFrame) -> DataFrame:
    """``hosts(hostname, ...)`` to ``hostname, is_punycode, unicode_domain``. A host with
    ``xn--`` is decoded (kept if that fails); one with other than ASCII that encodes to
    ``xn--`` is punycode too. Only such hosts go through Python."""
    return with_idn(hosts.select("hostname"))


def host_table(n: DataFrame, suffix_rules: DataFrame) -> DataFrame:
    """Every distinct host of ``n`` with its registered domain, subdomain and IDN columns.
    The distinct hosts are written first: several branches read them, and each would
    otherwise normalize all URLs again. One join, with the suffixes that were found."""
    hosts = written(distinct_hosts(n), "distinct_hosts")
    return with_domains(with_idn(hosts), suffix_rules)
