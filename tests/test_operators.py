"""Detectors, indicators, messages, streams and plans."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from urlrisk import config as C
from urlrisk.config import RiskConfig
from urlrisk.functions.text import entropy, fold_homoglyphs, restricted_distance, unleet
from urlrisk.operators.iocs import ioc_candidates, list_iocs, match_iocs, upsert_iocs
from urlrisk.operators.normalize import host_table, normalize_urls, registered_domains
from urlrisk.operators.typosquat import first_resemblance, similar_domains
from urlrisk.plans.verify import campaign_rollup, message_risk, verify_urls
from urlrisk.sources.reference import default_iocs, listed_suffixes, load_iocs, load_suffix_rules, reference_tables
from urlrisk.sources.urls import extract_urls, split_accepted, verdict_json, write_verdicts
from urlrisk.streaming.streams import current_iocs, ioc_report_stream, stream_of, verify_stream


def names_of(spark, urls, **lists):
    df = spark.createDataFrame(list(enumerate(urls)), "url_id long, url string")
    rows = verify_urls(df, default_iocs(spark), reference_tables(spark, **lists)).collect()
    return {urls[r.url_id]: {s.name: s.evidence for s in r.signals} for r in rows}


def distance(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_text_functions(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(0, 6)))
    pairs = [(word(), word()) for _ in range(300)] + [("ca", "abc"), ("goolge", "google"), ("paypa1", "paypal")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", restricted_distance("a", "b").alias("d"), entropy("a").alias("h")).collect()
    for r in got:
        assert r.d == distance(r.a, r.b)
        n = Counter(r.a)
        assert r.h == pytest.approx(-sum(v / len(r.a) * math.log2(v / len(r.a)) for v in n.values()) if r.a else 0, abs=6e-4)
    r = spark.range(1).select(unleet(F.lit("G00gl3$@")).alias("a"), fold_homoglyphs(F.lit("аррӏе")).alias("b")).first()
    assert r.a == "googlesa" and r.b == "appӏe"


def test_both_ways_to_similar_domains(spark):
    rng = random.Random(2)
    trusted = ["google.com", "paypal.com", "x.com", "wellsfargo.com", "abc.org"]
    rows = []
    for _ in range(150):
        s = list(rng.choice(trusted).split(".")[0])
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(s) + 1)
            s[k : k + rng.randint(0, 1)] = rng.choice(["a", "0", "1", "o", "-", "x", ""])
        rows.append(("".join(s) + ".net",))
    domains = spark.createDataFrame(rows + [("google.com",), ("e-shop.com",), ("a.com",)], "registered_domain string")
    refs = reference_tables(spark, trusted=trusted)
    both = [{tuple(r) for r in similar_domains(domains, refs.trusted, path=p).collect()} for p in ("literal", "join")]
    assert both[0] == both[1] and len(both[0]) > 50
    want = set()
    for (domain,) in rows:
        own = domain.split(".")[0]
        for pos, name in enumerate(t.split(".")[0] for t in trusted):
            if 0 < distance(own, name) <= (1 if max(len(own), len(name)) <= 6 else 2):
                want.add((domain, pos, 1, trusted[pos]))
            if any(c and (distance(c, name) <= (1 if len(name) <= 6 else 2) or c.translate(str.maketrans("01", "ol")) == name) for c in own.split("-") if "-" in own):
                want.add((domain, pos, 3, trusted[pos]))
    assert {r for r in both[0] if r[2] != 2 and r[0] in {d for (d,) in rows}} == want
    first = {r.registered_domain: r.domain for r in first_resemblance(similar_domains(domains, refs.trusted)).collect()}
    assert "google.com" not in first and first["e-shop.com"] == "x.com" and first["a.com"] == "x.com"
    strict = similar_domains(domains, refs.trusted, RiskConfig(min_trusted_sld_len=2))
    assert strict.where("registered_domain = 'e-shop.com'").count() == 0


def test_detectors(spark):
    urls = [
        "https://g00gle-security.com", "https://app1e.com", "https://microsoft.com", "https://purchase.com", "https://google.net",
        "https://paypal-verify.net", "https://login.paypal.com", "https://example.com/paypal", "http://münchen.de", "http://xn--mchen-kva.de",
        "http://αβγ.com", "https://a.b.c.d.example.com", "https://my-secure-login-account-update.com", "http://example.com/?a=1&b=2&c=3&d=4&e=5&f=6",
        "http://example.com/?a=&b=2&c=3&d=4&e=5&f=6", "http://example.com/%20%41%42", "http://example.com/go?u=HTTP://x", "http://example.com/reset-password", "http://example.com/limited-time",
    ]
    got = names_of(spark, urls)
    assert "Typosquatting" in got[urls[0]] and "Typosquatting" in got[urls[1]] and not got[urls[2]]
    assert got[urls[3]]["Brand impersonation"] == "Domain 'purchase.com' embeds brand 'chase' alongside suspicious compound pattern"
    assert not got[urls[4]]
    assert got[urls[5]]["Brand impersonation"].endswith("alongside verify pattern")
    assert not got[urls[6]] and not got[urls[7]]
    assert set(got[urls[8]]) == {"Punycode domain detected"}
    assert got[urls[9]]["Typosquatting"].endswith("x.com")
    assert "Homoglyph characters detected" in got[urls[10]] and "'α' (GREEK SMALL LETTER ALPHA)" in got[urls[10]]["Homoglyph characters detected"]
    assert "(4 levels)" in got[urls[11]]["Excessive subdomains"]
    assert "contains 4 hyphens" in got[urls[12]]["Excessive hyphens in hostname"]
    assert "contains 6 query" in got[urls[13]]["Excessive query parameters"] and not got[urls[14]]
    assert "contains 3 percent" in got[urls[15]]["Excessive percent-encoding"]
    assert got[urls[16]]["Nested or open redirect URL pattern"].endswith(": HTTP://")
    assert got[urls[17]]["Credential-related path"].endswith("'password'") and "'limited-time'" in got[urls[18]]["Urgency-inducing keyword"]


def test_own_lists(spark):
    got = names_of(spark, ["http://myc0mpany.internal/", "http://e.com/gift", "http://e.zip/"], trusted=["mycompany.internal"], urgency=["gift"], tlds=[".com"])
    assert "Typosquatting" in got["http://myc0mpany.internal/"]
    assert "Urgency-inducing keyword" in got["http://e.com/gift"] and "Suspicious TLD" in got["http://e.com/gift"] and not got["http://e.zip/"]


def test_long_lists_are_joined(spark, monkeypatch):
    """Lists too long for an expression give the same signals by joins, and lists may be tables."""
    urls = [
        "http://e.com/login/refund", "http://e.com/verify-account/invoice?x=urgent", "https://e.zip/limited-time", "http://1.2.3.4/otp", "http://[::1]/wallet",
        "https://paypal-secure-login.net/a", "https://purchase.com", "https://pineapple-login.xyz", "https://google.net", "https://paypa1.com", "https://a.b.c/", "http://e.com",
    ]
    short = names_of(spark, urls)
    assert sum(map(len, short.values())) > 15
    table = lambda values, name: spark.createDataFrame(list(enumerate(values)), f"pos int, {name} string")
    brands = spark.createDataFrame([(i, b, d) for i, (b, ds) in enumerate(C.BRAND_DOMAINS.items()) for d in ds], "pos int, brand string, legit_domain string")
    tables = {
        "trusted": table(C.TRUSTED_DOMAINS, "domain"), "brands": brands, "tlds": table(C.SUSPICIOUS_TLDS, "tld"), "credential": table(C.CREDENTIAL_KEYWORDS, "keyword"),
        "financial": table(C.FINANCIAL_KEYWORDS, "keyword"), "urgency": table(C.URGENCY_KEYWORDS, "keyword"), "lures": table(C.LURE_KEYWORDS, "keyword"),
    }
    assert names_of(spark, urls, **tables) == short
    monkeypatch.setattr(C, "MAX_LITERALS", 1)
    assert names_of(spark, urls, **tables) == short
    empty = {k: t.limit(0) for k, t in tables.items()}
    monkeypatch.undo()
    assert names_of(spark, urls[:3], **empty) == {u: short[u] for u in urls[:3]}


def test_public_suffixes(spark):
    """The list among Spark's jars is the default; the built-in one serves where it is missing."""
    hosts = spark.createDataFrame([(h, False, None) for h in ("login.foo.com.ng", "x.y.co.zm", "a.b.com.bo", "a.www.ck", "a.b.city.kawasaki.jp", "deep.a.b.kawasaki.jp", "x.blogspot.com")], "hostname string, is_ip boolean, ip_address string")
    if listed_suffixes() is None:
        pytest.skip("no list among the jars")
    got = {r.hostname: r.registered_domain for r in registered_domains(hosts, load_suffix_rules(spark)).collect()}
    assert list(got.values()).count(None) == 0 and got == {
        "login.foo.com.ng": "foo.com.ng", "x.y.co.zm": "y.co.zm", "a.b.com.bo": "b.com.bo", "a.www.ck": "www.ck",
        "a.b.city.kawasaki.jp": "city.kawasaki.jp", "deep.a.b.kawasaki.jp": "a.b.kawasaki.jp", "x.blogspot.com": "blogspot.com",
    }


def test_last_report_counts(spark):
    schema = "seq long, indicator string, indicator_type string, source string, severity string, description string"
    rows = [(k, " Hot.test " if k % 2 else "hot.test", "domain", None, None, f"report {k}") for k in range(50)]
    got = {r.indicator: r for r in upsert_iocs(default_iocs(spark), spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 5 and (got["hot.test"].description, got["hot.test"].source, got["hot.test"].severity) == ("report 49", "community", "high")


def test_indicators(spark, tmp_path):
    seeds = load_iocs(spark)
    assert seeds.count() == 4
    seeds.limit(0).write.parquet(f"{tmp_path}/empty")
    assert load_iocs(spark, f"{tmp_path}/empty").count() == 4
    updates = [(1, " Phishing-Attack-Domain.test ", "Domain", None, None, "new"), (2, "evil-example.com", "domain", "Lab", "ODD", None), (3, "evil-example.com", "domain", "Lab", " LOW ", "last"), (4, "http://u.org/x?y", "url", "a", "odd", "")]
    now = upsert_iocs(seeds, spark.createDataFrame(updates, "seq long, indicator string, indicator_type string, source string, severity string, description string"))
    rows = {r.indicator: r for r in now.collect()}
    assert len(rows) == 6 and rows["evil-example.com"].id == 7 and rows["evil-example.com"].severity == "low" and rows["evil-example.com"].source == "Lab"
    new = rows["phishing-attack-domain.test"]
    assert (new.indicator_type, new.source, new.severity) == ("domain", "community", "high") and new.created_at is not None
    assert [r.id for r in list_iocs(now, 2).collect()] == [8, 7]
    urls = ["http://a.b.Phishing-attack-domain.test/x", "HTTP://U.org:80/x?y", "http://clean.org", "http://evil-example.com"]
    n = normalize_urls(spark.createDataFrame(list(enumerate(urls)), "url_id long, url string"))
    hosts = host_table(n, reference_tables(spark).suffix_rules)
    hits = {r.url_id: r.ioc for r in match_iocs(n, hosts, now).collect()}
    assert set(hits) == {0, 1, 3} and hits[1].severity == "high" and hits[3].severity == "low"
    order = [r.candidate for r in ioc_candidates(n.join(hosts.drop("is_ip", "ip_address"), "hostname")).where("url_id = 0").orderBy("pos").collect()]
    assert order == [urls[0].lower(), "a.b.phishing-attack-domain.test", "b.phishing-attack-domain.test", "phishing-attack-domain.test", "test"]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "http://example.com/login")], "id long, u string")
    good, bad = split_accepted(df, "u", "id")
    assert {r.url_id for r in good.collect()} == {3, 4} and {r.url_id for r in bad.collect()} == {1, 2}
    verdicts = verify_urls(good, default_iocs(spark), reference_tables(spark))
    write_verdicts(verdicts, f"{tmp_path}/v")
    assert spark.read.parquet(f"{tmp_path}/v").count() == 2
    texts = {r.url_id: r.verdict for r in verdict_json(verdicts).collect()}
    assert '"risk_score":15' in texts[4] and '"Malformed URL"' in texts[3]
    found = extract_urls(spark.createDataFrame([(1, "see http://a.com/x, and (https://b.org)."), (2, None), (3, "none")], "msg_id long, text string")).collect()
    assert [(r.msg_id, r.pos, r.url) for r in found] == [(1, 0, "http://a.com/x"), (1, 1, "https://b.org")]
    risk = message_risk(verdicts, spark.createDataFrame([(3, 7), (4, 7)], "url_id long, msg_id long")).first()
    assert (risk.n_urls, risk.n_signals, risk.worst_score, risk.worst_url_id) == (2, 2, 15, 4)
    rolled = campaign_rollup(verdicts, spark.createDataFrame([(4, "e.com")], "url_id long, registered_domain string")).collect()
    assert {(r.registered_domain, r.risk_level, r.n_urls) for r in rolled} == {("e.com", "LOW", 1), ("e.com", None, 1), (None, None, 1)}


def test_hosts_without_a_scheme(spark):
    """Around full URLs, e-mail addresses and what only looks like a host; in any script, with what follows."""
    texts = [
        "Go to example.com/login, or WWW.Shop.co.uk. See http://a.com/x?u=b.com, c.org!",
        "mail me@example.com or a.b+c@mail.example.co.uk; user:pw@evil.com",
        "v1.2.3 e.g. this.that 10.0.0.1/x co.uk .com a..com -a.com a_b.com x.unlisted",
        "(bücher.de) [xn--fa-hia.de]: url=pay.com:8080/?a=b.com#c.com \"d.net\"",
        "medium.com/@user x_http://e.com",
        "first.com http://second.com third.com ftp://fourth.com/fifth.com sixth.com",
        "\x01seventh.com \x01http://eighth.com",
        None,
        "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "msg_id long, text string")
    found = {}
    for r in sorted(extract_urls(df, suffix_rules=load_suffix_rules(spark)).collect(), key=lambda r: r.pos):
        found.setdefault(r.msg_id, []).append(r.url)
        assert r.pos == len(found[r.msg_id]) - 1
    assert found == {
        0: ["example.com/login", "WWW.Shop.co.uk", "http://a.com/x?u=b.com", "c.org"],
        3: ["bücher.de", "xn--fa-hia.de", "pay.com:8080/?a=b.com#c.com", "d.net"],
        4: ["medium.com/@user", "http://e.com"],
        5: ["first.com", "http://second.com", "third.com", "ftp://fourth.com/fifth.com", "sixth.com"],
        6: ["seventh.com", "http://eighth.com"],
    }
    plain = extract_urls(df).collect()
    assert {r.url for r in plain} == {u for us in found.values() for u in us if "://" in u}
    assert extract_urls(df.limit(0), suffix_rules=load_suffix_rules(spark)).count() == 0


def test_streams(spark, tmp_path):
    urls = spark.createDataFrame([(i, u) for i, u in enumerate(["http://e.com/login", "https://paypa1.com", "   ", "http://1.2.3.4"])], "url_id long, url string")
    refs, iocs = reference_tables(spark), default_iocs(spark)
    verify_stream(stream_of(spark, urls, f"{tmp_path}/in"), iocs, refs, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {r.url_id: (r.risk_score, r.classification) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r.url_id: (r.risk_score, r.classification) for r in verify_urls(urls, iocs, refs).collect()}
    schema = "seq long, indicator string, indicator_type string, source string, severity string, description string"
    reports = spark.createDataFrame([(1, "bad.test", "domain", "a", "low", ""), (2, "worse.test", "domain", "a", "low", "")], schema)
    ioc_report_stream(stream_of(spark, reports, f"{tmp_path}/reports", 2), f"{tmp_path}/iocs", iocs, f"{tmp_path}/state2").awaitTermination()
    assert {r.indicator for r in current_iocs(spark, f"{tmp_path}/iocs", iocs).collect()} >= {"bad.test", "worse.test", "evil-example.com"}
    # reports of one indicator arrive in their order, whatever the number of batches
    many = spark.createDataFrame([(k, f"h{k % 5}.test", "domain", "a", "low", f"report {k}") for k in range(60)], schema)
    ioc_report_stream(stream_of(spark, many, f"{tmp_path}/many", 4, key="indicator", order_col="seq"), f"{tmp_path}/more", iocs, f"{tmp_path}/state3").awaitTermination()
    last = {r.indicator: r.description for r in current_iocs(spark, f"{tmp_path}/more", iocs).collect()}
    assert {k: last[f"h{k}.test"] for k in range(5)} == {k: f"report {55 + k}" for k in range(5)}


def test_plan_has_no_cross_join(spark):
    urls = spark.createDataFrame([(0, "http://e.com")], "url_id long, url string")
    plan = verify_urls(urls, default_iocs(spark), reference_tables(spark))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
