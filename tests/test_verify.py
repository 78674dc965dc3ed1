"""Golden verdicts of the full verification."""

import pytest

from urlrisk.plans.verify import verify_urls
from urlrisk.sources.reference import default_iocs, reference_tables

TYPO, CRED, BRAND, BRAND_SUB = "Typosquatting", "Credential-related path", "Brand impersonation", "Brand impersonation in subdomain"
PUNY, MIXED = "Punycode domain detected", "Mixed-script domain spoofing"
GOLDEN = [
    ("https://google.com", [], 0, "LOW", "Safe", 0.95),
    ("https://paypa1.com", [TYPO], 15, "LOW", "Suspicious", 0.80),
    ("https://paypa1.com/login", [TYPO, CRED], 30, "CAUTION", "Potential Phishing", 0.88),
    ("http://192.168.1.1/login", ["Raw IP address hostname", CRED], 30, "CAUTION", "Suspicious", 0.78),
    ("https://example.com/login", [CRED], 15, "LOW", "Low Risk", 0.60),
    ("https://evil-example.com/login", ["Known malicious IOC", CRED], 80, "CRITICAL", "Known Malicious", 0.98),
    ("http://xn--pple-43d.com", [TYPO, PUNY, MIXED], 38, "CAUTION", "Potential Phishing", 0.92),
    ("http://аpple.com", [TYPO, PUNY, MIXED, "Homoglyph brand impersonation"], 53, "HIGH", "Potential Phishing", 0.92),
    ("https://paypal.security-example.com/login", [CRED, BRAND_SUB], 35, "CAUTION", "Potential Phishing", 0.88),
    ("https://apple-support-recovery.com/verify", [TYPO, CRED, BRAND], 50, "HIGH", "Potential Phishing", 0.92),
    ("https://micros0ft-login.com", [TYPO], 15, "LOW", "Suspicious", 0.80),
    ("http://google.com@evil-phishing.com/login", ["Obfuscated URL with authority delimiter", CRED], 35, "CAUTION", "Potential Phishing", 0.88),
    ("http://example.com:4444/admin", ["Non-standard port"], 10, "LOW", "Low Risk", 0.60),
    ("https://security-update.zip/download", ["Suspicious TLD"], 12, "LOW", "Low Risk", 0.60),
    ("https://xkj19f8q2pmvz09a.com/dashboard", ["High entropy hostname"], 5, "LOW", "Low Risk", 0.55),
    ("https://example.com/" + "a" * 200, ["Unusually long URL"], 0, "LOW", "Low Risk", 0.55),
    ("http://[invalid:host", ["Malformed URL"], 5, "LOW", "Low Risk", 0.50),
    ("   ", ["Malformed URL"], 5, "LOW", "Low Risk", 0.50),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    urls = spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(GOLDEN)], "url_id long, url string")
    return {r.url_id: r for r in verify_urls(urls, default_iocs(spark), reference_tables(spark)).collect()}


def test_one_verdict_for_each_url(verdicts):
    assert sorted(verdicts) == list(range(len(GOLDEN)))


@pytest.mark.parametrize("k", range(len(GOLDEN)), ids=[u[:40] for u, *_ in GOLDEN])
def test_golden(verdicts, k):
    _, names, score, level, kind, sure = GOLDEN[k]
    v = verdicts[k]
    assert [s.name for s in v.signals] == names
    assert (v.risk_score, v.risk_level, v.classification, v.confidence) == (score, level, kind, sure)
    assert v.known_ioc == (kind == "Known Malicious")
