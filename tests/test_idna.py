"""Host names by the rules of 2008: known cases, and the rules against the public library where it is there."""

import random
import unicodedata

import pytest

from urlrisk.functions import idna as own
from urlrisk.operators.normalize import decode_idn

CASES = [  # host, its ASCII form, its readable form
    ("faß.de", "xn--fa-hia.de", "faß.de"),
    ("straße.de.", "xn--strae-oqa.de.", "straße.de."),
    ("xn--strae-oqa.de", "xn--strae-oqa.de", "straße.de"),
    ("i❤.ws", None, None),
    ("xn--i-7iq.ws", None, None),
    ("MÜNCHEN.de", None, None),
    ("l·l.cat", "xn--ll-0ea.cat", "l·l.cat"),
    ("a·b.cat", None, None),
    ("か・き.jp", "xn--u8je53c.jp", "か・き.jp"),
    ("a・b.jp", None, None),
    ("׳א.com", None, None),
    ("א׳.com", "xn--4db4e.com", "א׳.com"),
    ("1א.com", None, None),
    ("٠۱.com", None, None),
    ("क्‍ष.com", "xn--11b2ezcw70k.com", "क्‍ष.com"),
    ("ab‍c.com", None, None),
    ("é.com", None, None),
    ("ab--cd.com", None, None),
    ("xn--zzzzzz.de", None, None),
    ("xn--", None, None),
    ("a..b", None, None),
    ("", None, None),
    ("ex。ample.com", "ex.ample.com", "ex.ample.com"),
    ("ü" * 80 + ".com", None, "ü" * 80 + ".com"),
]


def tried(f, host):
    try:
        return f(host)
    except ValueError:
        return None


@pytest.mark.parametrize(("host", "code", "plain"), CASES)
def test_cases(host, code, plain):
    assert tried(own.encode_by_rules, host) == own.to_ascii(host) == code
    if len(host) < 80:
        assert tried(own.decode_by_rules, host) == own.to_unicode(host) == plain


def test_rules_equal_the_library():
    library = pytest.importorskip("idna")
    both = ((library.encode, own.encode_by_rules), (library.decode, own.decode_by_rules))
    said = lambda f, h: (x.decode() if isinstance(x := tried(f, h), bytes) else x)
    for cp in [*range(0x80, 0x3100), *range(0xA000, 0xD7FF, 3), *range(0xF900, 0x20000)]:
        if unicodedata.category(chr(cp)) not in ("Cn", "Cs"):
            assert said(*both[0][:1], chr(cp)) == said(both[0][1], chr(cp)), hex(cp)
    rng = random.Random(1)
    pool = "abl19-.ßé·͵αβςאב׳״اب٠١۰۱्कष‍・かカ一。❤Àас_．"
    valid = 0
    for _ in range(20_000):
        host = "".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))
        host = "xn--" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789-") for _ in range(rng.randint(1, 7))) if rng.random() < 0.3 else host
        for a, b in both:
            want = said(a, host)
            valid += want is not None
            assert want == said(b, host), host
    assert valid > 3000


def test_hosts(spark, monkeypatch):
    hosts = ["faß.de", "xn--fa-hia.de", "i❤.ws", "xn--i-7iq.ws", "plain.com", "axn--b.com", "münchen.de"]
    df = spark.createDataFrame([(h,) for h in hosts], "hostname string")
    got = {r.hostname: (r.is_punycode, r.unicode_domain) for r in decode_idn(df).collect()}
    assert got == {
        "faß.de": (True, "faß.de"), "xn--fa-hia.de": (True, "faß.de"), "i❤.ws": (False, "i❤.ws"), "xn--i-7iq.ws": (True, "xn--i-7iq.ws"),
        "plain.com": (False, "plain.com"), "axn--b.com": (True, "axn--b.com"), "münchen.de": (True, "münchen.de"),
    }
    monkeypatch.setattr(own, "_library", None)
    assert [own.to_ascii(h) for h in hosts[:3]] == ["xn--fa-hia.de", "xn--fa-hia.de", None]
