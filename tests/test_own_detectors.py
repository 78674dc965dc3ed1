"""Detectors that a user adds, puts in another's place or leaves out."""

import pytest
from pyspark.sql import functions as F

from urlrisk.operators.detectors import Detector
from urlrisk.plans.verify import verify_urls
from urlrisk.sources.reference import default_iocs, reference_tables

URLS = ["http://paypa1.com/login", "https://a.b.c.d.example.com", "http://1.2.3.4/login", "https://github.com/login", "   "]


@pytest.fixture(scope="module")
def verify(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "url_id long, url string")

    def run(**how):
        rows = verify_urls(df, default_iocs(spark), reference_tables(spark), **how).collect()
        return {URLS[r.url_id]: ([(s.name, s.severity) for s in r.signals], r.risk_score) for r in rows}

    return run


def says(key, name, severity="low", more=()):
    return lambda df: df.select(key, F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.lit("so").alias("evidence"), *more)


def test_each_grain_adds(verify):
    plain = verify()
    found = verify(
        detectors=[
            Detector("url", says("url_id", "Of a URL", "high", [F.lit(9).alias("weight")])),
            Detector("host", says("hostname", "Excessive host")),
            Detector("domain", says("registered_domain", "Of a domain", "medium", [F.lit(None).cast("int").alias("weight")])),
        ]
    )
    for url in URLS[:4]:
        own = [("Of a URL", "high"), ("Excessive host", "low"), ("Of a domain", "medium")]
        own = own[:2] if "1.2.3.4" in url else own
        assert found[url][0] == plain[url][0] + own and found[url][1] == plain[url][1] + 9 + 5
    assert found["   "] == plain["   "]


def test_many_signals_for_a_key_and_none(verify):
    def twice(n):
        return n.where("scheme = 'http'").select("url_id", F.explode(F.array(F.lit("b"), F.lit("a"))).alias("name"), F.lit("low").alias("severity"), F.lit("").alias("evidence"))

    plain, found = verify(), verify(detectors=[Detector("url", twice), Detector("host", lambda h: says("hostname", "x")(h.where("false")))])
    assert found[URLS[0]][0] == plain[URLS[0]][0] + [("a", "low"), ("b", "low")] and found[URLS[1]] == plain[URLS[1]]


def test_instead_of_and_without(verify):
    plain = verify()
    gone = verify(without=["typosquat", "subdomains", "brand", "punycode"])
    assert [n for n, _ in plain[URLS[0]][0]] == ["Typosquatting", "Credential-related path"] and [n for n, _ in gone[URLS[0]][0]] == ["Credential-related path"]
    assert plain[URLS[1]][0] and not gone[URLS[1]][0]
    own = Detector("url", says("url_id", "Credential-related path", "medium"), instead_of="credential")
    other = verify(detectors=[own], without=["raw_ip"])
    assert other[URLS[0]] == plain[URLS[0]] and other[URLS[1]][0] == [*plain[URLS[1]][0], ("Credential-related path", "medium")]
    assert other[URLS[2]][0] == [("Credential-related path", "medium")]
    assert other[URLS[3]] == plain[URLS[3]]  # a trusted domain suppresses it by its name


@pytest.mark.parametrize("wrong", [lambda v: v(without=["nothing"]), lambda v: v(without=["ioc"]), lambda v: Detector("row", None), lambda v: Detector("url", None, instead_of="ioc")])
def test_wrong_names(verify, wrong):
    with pytest.raises(ValueError):
        wrong(verify)
