"""Brand names on domains that are not the brand's, once for each distinct host."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk import config as C
from urlrisk.functions.text import first_match, literal_array, settle, words_within
from urlrisk.sources.reference import References


def brand_hits(hosts: DataFrame, refs: References) -> DataFrame:
    """``hostname, pos, rule, brand, lure``: every brand that a host uses without being its.

    ``hosts(hostname, registered_domain, subdomain)``, distinct, without IP addresses. Rule
    1: the brand is a part of the subdomain, between dots and hyphens. Rule 2: it is in the
    first label of the registered domain, and so is a lure, a hyphen or underscore, or
    more than two further characters. The subdomain's parts are joined with the brands. A
    short list of brands is sought in the label as it is; the words of a longer one are joined
    on their rarest part (``words_within``), and lures likewise.
    """
    legit = refs.brands.select("pos", F.lower("legit_domain").alias("legit"))
    names = refs.brands.select("pos", "brand", F.lower("brand").alias("key")).distinct()
    h = hosts.select("hostname", F.lower("registered_domain").alias("rd"), F.lower("subdomain").alias("sub"))
    h = settle(h.withColumn("label", F.split_part("rd", F.lit("."), F.lit(1))))
    parts = h.select("hostname", "rd", "label", F.lit(1).alias("rule"), F.explode(F.array_distinct(F.split("sub", "[-.]"))).alias("key"))
    few = [k for (k,) in names.select("key").distinct().limit(C.MAX_LITERALS + 1).collect()]
    if len(few) <= C.MAX_LITERALS:
        found = h.select("hostname", "rd", "label", F.lit(2).alias("rule"), F.explode(F.filter(literal_array(few), lambda k: F.contains("label", k))).alias("key"))
    else:
        held = words_within(h.select("label").distinct(), "label", "label", names, "key")
        found = h.join(held, "label").select("hostname", "rd", "label", F.lit(2).alias("rule"), "key")
    hits = parts.unionByName(found).where("key <> ''").join(names, "key")
    # domains that end with a brand's own: its suffixes, joined to the brands' domains
    tails = "transform(sequence(1, size(split(rd, '\\\\.'))), i -> array_join(slice(split(rd, '\\\\.'), i, size(split(rd, '\\\\.'))), '.'))"
    owned = h.select("rd").distinct().select("rd", F.explode(F.expr(tails)).alias("legit")).join(legit, "legit").select("rd", "pos").distinct()
    hits = hits.join(owned, ["rd", "pos"], "left_anti")
    lures = refs.words("lure")
    if lures is None:
        texts = hits.select("label").distinct()
        table = refs.keywords.where("kind = 'lure'").select(F.col("keyword").alias("piece"), F.col("pos").alias("nth"))
        lured = words_within(texts, "label", "label", table, "piece").join(table, "piece").groupBy("label").agg(F.min_by("piece", "nth").alias("lure"))
        hits = hits.join(lured, "label", "left")
    else:
        hits = settle(hits.withColumn("lure", first_match(lures, lambda w: F.contains("label", w))), "lure")
    compound = F.col("lure").isNotNull() | F.col("label").rlike("[-_]") | (F.length("label") > F.length("key") + 2)
    return hits.where((F.col("rule") == 1) | compound).select("hostname", "pos", "rule", "brand", "rd", F.coalesce("lure", F.lit("suspicious compound")).alias("lure"))


def first_brand(hits: DataFrame) -> DataFrame:
    """``hostname, brand_name, brand_evidence``: the first brand, and its first rule."""
    best = F.min_by(F.struct("rule", "brand", "rd", "lure"), F.struct("pos", "rule")).alias("b")
    return hits.groupBy("hostname").agg(best).select(
        "hostname",
        F.expr("if(b.rule = 1, 'Brand impersonation in subdomain', 'Brand impersonation')").alias("brand_name"),
        F.expr(
            "if(b.rule = 1, concat('Brand ''', b.brand, ''' appears in subdomain on unrelated registered domain ''', b.rd, ''''), "
            "concat('Domain ''', b.rd, ''' embeds brand ''', b.brand, ''' alongside ', b.lure, ' pattern'))"
        ).alias("brand_evidence"),
    )
