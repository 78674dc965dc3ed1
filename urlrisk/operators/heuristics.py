"""Structural signals of a URL, as expressions over its components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.config import RiskConfig
from urlrisk.functions.text import first_common, first_match, words_within
from urlrisk.operators.signals import signal
from urlrisk.sources.reference import References


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _first(df: DataFrame, key: str, words: Column, table: DataFrame, name: str) -> DataFrame:
    """``df`` with the first word of ``table(pos, keyword)`` that is among ``words`` as ``name``:
    an equi join on the word, and one row for each key joined back."""
    return _with_first(df, key, df.select(key, F.explode(words).alias("keyword")), table, name)


def _with_first(df: DataFrame, key: str, words: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """The same, of ``words(key, keyword)``."""
    rows = words.join(table.select("pos", "keyword"), "keyword")
    return df.join(rows.groupBy(key).agg(F.min_by("keyword", "pos").alias(name)), key, "left")


def with_long_host_lists(hosts: DataFrame, refs: References) -> DataFrame:
    """``hosts``, and ``hit_tld`` if the list of TLDs is too long for an expression."""
    if refs.words("tld") is not None:
        return hosts
    rd = "lower(registered_domain)"
    ends = F.expr(f"array_distinct(transform(sequence(1, length({rd})), i -> substr({rd}, i)))")
    return _first(hosts.where("registered_domain <> ''"), "hostname", ends, refs.tlds.select("pos", F.col("tld").alias("keyword")), "hit_tld").unionByName(
        hosts.where("registered_domain = ''").withColumn("hit_tld", F.lit(None).cast("string"))
    )


def with_long_url_lists(n: DataFrame, refs: References) -> DataFrame:
    """``n``, and ``hit_<kind>`` for each kind of keywords that is too long for an expression."""
    for kind in ("credential", "financial", "urgency"):
        if refs.words(kind) is None:
            table = refs.keywords.where(F.col("kind") == kind)
            if kind == "urgency":
                rest = n.select("*", F.lower(F.concat("path", F.lit("?"), "query")).alias("rest"))
                n = _with_first(n, "url_id", words_within(rest, "url_id", "rest", table, "keyword"), table, f"hit_{kind}")
            else:
                n = _first(n, "url_id", F.array_distinct(F.split(F.lower("path"), r"[/_.\-]")), table, f"hit_{kind}")
    return n


def host_heuristics(refs: References, cfg: RiskConfig) -> dict[str, Column]:
    """Signals that need ``hostname, is_ip, registered_domain, subdomain``, and what
    ``with_long_host_lists`` adds."""
    tlds = refs.words("tld")
    tld = F.col("hit_tld") if tlds is None else first_match(tlds, lambda t: F.lower("registered_domain").endswith(t))
    levels = F.expr("size(filter(split(subdomain, '\\\\.'), x -> x <> ''))")
    hyphens = F.expr("length(replace(hostname, 'xn--', '')) - length(replace(replace(hostname, 'xn--', ''), '-', ''))")
    return {
        "raw_ip": F.when(F.col("is_ip"), signal("raw_ip", "Raw IP address hostname", "medium", _text("URL uses a raw IP address (", F.col("hostname"), ") instead of a domain name"))),
        "tld": F.when(tld.isNotNull(), signal("tld", "Suspicious TLD", "medium", _text("Domain uses TLD '", tld, "' frequently abused in phishing campaigns"))),
        "subdomains": F.when(levels >= cfg.max_subdomains, signal("subdomains", "Excessive subdomains", "low", _text("URL contains excessive subdomain levels (", levels, " levels)"))),
        "hyphens": F.when(hyphens > cfg.max_hyphens, signal("hyphens", "Excessive hyphens in hostname", "low", _text("Hostname contains ", hyphens, " hyphens, often used to bypass filters"))),
        "long_host": F.when(F.length("hostname") > cfg.max_hostname_length, signal("long_host", "Unusually long hostname", "low", _text("Hostname is unusually long (", F.length("hostname"), " characters)"))),
    }


def url_heuristics(refs: References, cfg: RiskConfig) -> dict[str, Column]:
    """Signals that need ``original_url, path, query, port``, and what
    ``with_long_url_lists`` adds."""
    rest = F.concat("path", F.lit("?"), "query")
    nested = F.regexp_extract(rest, r"(?i)(https?://|www\.)", 1)
    percents = F.regexp_count("original_url", F.lit("%[0-9a-fA-F]{2}"))
    names = F.expr(
        "size(array_distinct(transform(filter(split(query, '&'), kv -> instr(kv, '=') > 0 AND length(kv) > instr(kv, '=')), "
        "kv -> coalesce(try_url_decode(split_part(kv, '=', 1)), split_part(kv, '=', 1)))))"
    )
    tokens = F.split(F.lower("path"), r"[/_.\-]")
    credential, financial, urgency = (
        F.col(f"hit_{kind}") if (words := refs.words(kind)) is None else first_common(words, tokens) if kind != "urgency" else F.coalesce(*(F.when(F.contains(F.lower(rest), F.lit(w)), w) for w in words))
        for kind in ("credential", "financial", "urgency")
    )
    return {
        "long_url": F.when(F.length("original_url") > cfg.max_url_length, signal("long_url", "Unusually long URL", "low", _text("URL is unusually long (", F.length("original_url"), " characters)"))),
        "at": F.when(
            F.regexp_extract("original_url", r"^[^?#]*", 0).contains("@"),
            signal("at", "Obfuscated URL with authority delimiter", "high", _text("URL contains '@' in authority section, commonly used to disguise destination domain")),
        ),
        "nested": F.when(nested != "", signal("nested", "Nested or open redirect URL pattern", "medium", _text("URL path or query parameters contain embedded URL indicator: ", nested))),
        "percent": F.when(percents >= cfg.min_percent, signal("percent", "Excessive percent-encoding", "low", _text("URL contains ", percents, " percent-encoded sequences"))),
        "params": F.when(names > cfg.max_query_params, signal("params", "Excessive query parameters", "low", _text("URL contains ", names, " query parameters"))),
        "port": F.when(
            (F.col("port") > 0) & ~F.col("port").isin(*cfg.common_ports), signal("port", "Non-standard port", "medium", _text("URL directs to uncommon non-standard port ", F.col("port")))
        ),
        "credential": F.when(
            credential.isNotNull(), signal("credential", "Credential-related path", "medium", _text("URL path contains credential/authentication intent keyword: '", credential, "'"))
        ),
        "financial": F.when(
            financial.isNotNull(), signal("financial", "Financial/payment intent", "medium", _text("URL path contains financial or payment intent keyword: '", financial, "'"))
        ),
        "urgency": F.when(urgency.isNotNull(), signal("urgency", "Urgency-inducing keyword", "low", _text("URL contains urgency-inducing keyword: '", urgency, "'"))),
    }
