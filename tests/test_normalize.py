"""URL components, hosts, registered domains, IDN."""

import pytest

from urlrisk.operators.normalize import decode_idn, host_table, normalize_urls, registered_domains, split_malformed
from urlrisk.sources.reference import load_suffix_rules, local_table

CASES = {
    # url: scheme, hostname, port, path, query, canonical URL
    "https://Example.COM/login?User=123": ("https", "example.com", None, "/login", "User=123", "https://example.com/login?User=123"),
    "example.com/login": ("http", "example.com", None, "/login", "", "http://example.com/login"),
    "http://192.168.1.1:8080/admin": ("http", "192.168.1.1", 8080, "/admin", "", "http://192.168.1.1:8080/admin"),
    "HTTPS://user:pw@Host.org:443": ("https", "host.org", 443, "/", "", "https://host.org/"),
    "http://h.org/a/b;x=1?q#frag": ("http", "h.org", None, "/a/b", "q", "http://h.org/a/b?q"),
    "http://h.org/a;x/b": ("http", "h.org", None, "/a;x/b", "", "http://h.org/a;x/b"),
    "foo://h.org/a;x": ("foo", "h.org", None, "/a;x", "", "foo://h.org/a;x"),
    "  http://h.org\t/x\n/y ": ("http", "h.org", None, "/x/y", "", "http://h.org/x/y"),
    "http://h.org:0/": ("http", "h.org", 0, "/", "", "http://h.org/"),
    "ftp://h.org:21/x": ("ftp", "h.org", 21, "/x", "", "ftp://h.org/x"),
    "http://[2001:DB8::1]:81/": ("http", "2001:db8::1", 81, "/", "", "http://2001:db8::1:81/"),
    "http://user:secret@h.org:bad/": ("http", "user", None, "/", "", "http://user/"),
    "http://h.org:99999/": ("http", "h.org", None, "/", "", "http://h.org/"),
    "my_host.com/a|b": ("http", "my_host.com", None, "/a|b", "", "http://my_host.com/a|b"),
}
BAD = {
    "   ": "Empty URL provided",
    "http://[::1/path": "Malformed URL: Invalid IPv6 URL",
    "http://[invalid:host": "Malformed URL: Invalid IPv6 URL",
    "http://[nonsense]/": "Malformed URL: Invalid IPv6 URL",
    "://missing-scheme": "Could not determine hostname from URL",
    "ftp://": "Could not determine hostname from URL",
}


def frame(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "url_id long, url string")


def test_components(spark):
    got = {r.url_id: r for r in normalize_urls(frame(spark, CASES)).collect()}
    for k, (url, want) in enumerate(CASES.items()):
        r = got[k]
        assert (r.scheme, r.hostname, r.port, r.path, r.query, r.normalized_url) == want, url
        assert r.is_valid and r.error is None


def test_malformed(spark):
    good, bad = split_malformed(normalize_urls(frame(spark, BAD)))
    assert good.count() == 0
    assert {r.url_id: r.error for r in bad.collect()} == dict(enumerate(BAD.values()))


@pytest.mark.parametrize(
    "host, ip",
    [("1.2.3.4", "1.2.3.4"), ("256.1.1.1", None), ("01.2.3.4", None), ("1.2.3", None), ("[::1]", "::1"), ("[2001:0db8:0:0::1]", "2001:db8::1"), ("a.b", None)],
)
def test_ip(spark, host, ip):
    r = normalize_urls(frame(spark, [f"http://{host}/"])).first()
    assert (r.is_ip, r.ip_address) == (ip is not None, ip)


def test_registered_domains(spark):
    want = {
        "portal.secure.banking.paypal.com": ("paypal.com", "portal.secure.banking"),
        "shop.example.co.uk": ("example.co.uk", "shop"),
        "co.uk": ("co.uk", ""),
        "localhost": ("localhost", ""),
        "a.b.internal": ("b.internal", "a"),
        "x.y.foo.ck": ("y.foo.ck", "x"),
        "a.www.ck": ("www.ck", "a"),
        "com": ("com", ""),
    }
    hosts = spark.createDataFrame([(h, False, None) for h in want] + [("1.2.3.4", True, "1.2.3.4")], "hostname string, is_ip boolean, ip_address string")
    got = {r.hostname: (r.registered_domain, r.subdomain) for r in registered_domains(hosts, load_suffix_rules(spark)).collect()}
    assert got == want | {"1.2.3.4": ("1.2.3.4", "")}


def test_suffix_file(spark, tmp_path):
    (tmp_path / "list.dat").write_text("// comment\n// ===BEGIN ICANN DOMAINS===\ncom\nco.zz\n*.yy\n!city.yy\n// ===END ICANN DOMAINS===\nprivate.com\n")
    rules = {(r.rule, r.kind) for r in load_suffix_rules(spark, f"{tmp_path}/list.dat").collect()}
    assert rules == {("com", "normal"), ("co.zz", "normal"), ("*.yy", "wildcard"), ("city.yy", "exception")}


def test_idn(spark):
    hosts = spark.createDataFrame([("xn--mchen-kva.de",), ("аpple.com",), ("plain.com",), ("xn--é.com",)], "hostname string")
    got = {r.hostname: (r.is_punycode, r.unicode_domain) for r in decode_idn(hosts).collect()}
    assert got["xn--mchen-kva.de"] == (True, "müchen.de") and got["plain.com"] == (False, "plain.com")
    assert got["аpple.com"] == (True, "аpple.com") and got["xn--é.com"][0]


def test_host_table_has_each_host_once(spark):
    n = normalize_urls(frame(spark, ["http://a.com/1", "http://A.com/2", "http://b.co.uk", "  "]))
    rows = host_table(n, load_suffix_rules(spark)).collect()
    assert sorted(r.hostname for r in rows) == ["a.com", "b.co.uk"]


def test_local_table_quotes(spark):
    rows = [("it's", 1, None), ("back\\slash", 2, "x"), ("é\n", 3, "")]
    assert [tuple(r) for r in local_table(spark, rows, "a string, b int, c string").collect()] == rows
    assert local_table(spark, [], "a string, b int").collect() == []
