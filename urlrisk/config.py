"""Thresholds and reference lists. The lists are fixed values: results depend on them
and on their order."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values -----------------------------------------------------------------

SUSPICIOUS_TLDS = (
    ".zip", ".top", ".xyz", ".country", ".kim", ".work", ".click", ".gq", ".ml", ".cf",
    ".ga", ".tk", ".surf", ".buzz", ".cam", ".fit", ".casa", ".rest", ".monster",
)

CREDENTIAL_KEYWORDS = (
    "login", "signin", "verify", "verification", "account", "secure", "update", "kyc", "password", "otp",
    "auth", "authenticate", "credential", "passcode", "reset-password", "recover", "unlock",
)

FINANCIAL_KEYWORDS = (
    "payment", "refund", "billing", "invoice", "wallet", "checkout", "banking", "transfer", "crypto", "bitcoin", "usdt",
)

URGENCY_KEYWORDS = (
    "suspended", "urgent", "action-required", "immediate", "warning", "alert", "notice", "expire", "expiring", "limited-time",
)

LURE_KEYWORDS = (
    "login", "signin", "security", "verify", "verification", "account", "update", "support", "helpdesk", "auth",
    "portal", "billing", "payment", "secure", "recovery", "service", "alert",
)

TRUSTED_DOMAINS = (
    "google.com", "microsoft.com", "apple.com", "paypal.com", "amazon.com", "facebook.com", "netflix.com", "github.com",
    "instagram.com", "twitter.com", "x.com", "linkedin.com", "chase.com", "wellsfargo.com", "bankofamerica.com",
    "citibank.com", "stripe.com", "dropbox.com", "whatsapp.com", "telegram.org", "adobe.com", "yahoo.com",
)

BRAND_DOMAINS = {
    "paypal": ("paypal.com",),
    "google": ("google.com",),
    "microsoft": ("microsoft.com", "live.com", "office.com"),
    "apple": ("apple.com", "icloud.com"),
    "amazon": ("amazon.com", "aws.amazon.com"),
    "netflix": ("netflix.com",),
    "github": ("github.com",),
    "chase": ("chase.com",),
    "wellsfargo": ("wellsfargo.com",),
    "bankofamerica": ("bankofamerica.com",),
    "citibank": ("citibank.com",),
    "stripe": ("stripe.com",),
    "dropbox": ("dropbox.com",),
    "whatsapp": ("whatsapp.com",),
    "telegram": ("telegram.org",),
    "facebook": ("facebook.com", "meta.com"),
    "instagram": ("instagram.com",),
    "linkedin": ("linkedin.com",),
}

#: Characters written for letters, and those letters.
LEET_FROM, LEET_TO = "013458@$", "oleasbas"

#: Characters that look like Latin letters, and those letters: Cyrillic small, Cyrillic
#: capital, Greek.
HOMOGLYPH_FROM = "асеорѕіјухһѝ" "АВСЕНІЈКМОРТХ" "αονρΑΒΕΟΡΤ"
HOMOGLYPH_TO = "aceopsijyxhi" "ABCEHIJKMOPTX" "aovpABEOPT"

#: Indicators that a feed without rows is replaced by.
DEFAULT_IOCS = (
    ("evil-example.com", "domain", "community", "critical", "Known credential harvester domain"),
    ("phishing-bank-update.test", "domain", "internal", "high", "Financial phishing campaign targeting banking customers"),
    ("http://known-malware-drop.test/payload.exe", "url", "abuse_ch", "critical", "Known malware payload download link"),
    ("crypto-airdrop-scam.test", "domain", "community", "high", "Fraudulent crypto drainer campaign"),
)

#: Weight of a signal by a part of its name: the first that occurs counts.
WEIGHTS = (
    ("Brand impersonation", 20),
    ("Typosquatting", 15),
    ("Homoglyph", None),
    ("Mixed-script", None),
    ("Punycode", None),
    ("Credential-related", 15),
    ("Financial", 10),
    ("Urgency", 8),
    ("Raw IP address", 15),
    ("Obfuscated URL", 20),
    ("Suspicious TLD", 12),
    ("Non-standard port", 10),
    ("High entropy", 5),
    ("Excessive", 5),
    ("Nested or open redirect", 10),
)
#: Weight of the three names above without one: by severity.
SCRIPT_WEIGHT_HIGH, SCRIPT_WEIGHT_OTHER = 15, 8

RECOMMENDATIONS = {
    "Safe": "No significant suspicious indicators were detected.",
    "Low Risk": "Proceed with normal caution and verify the destination.",
    "Suspicious": "Verify the domain before entering credentials or personal information.",
    "Potential Phishing": "Avoid entering credentials, OTPs, or payment information.",
    "Known Malicious": "Do not open this link or provide any personal, financial, or authentication information.",
}
MALFORMED_RECOMMENDATION = "URL appears malformed or incomplete. Verify before accessing."

# --- own values -------------------------------------------------------------------

#: Public suffixes of more than one label. Suffixes of one label need no rule: the last
#: two labels are the registered domain with or without one.
SUFFIX_RULES = (
    *(f"{a}.uk" for a in ("co", "org", "ac", "gov", "ltd", "plc", "me", "net", "sch", "nhs", "police")),
    *(f"{a}.au" for a in ("com", "net", "org", "edu", "gov", "asn", "id")),
    *(f"{a}.nz" for a in ("co", "net", "org", "ac", "govt", "geek", "school")),
    *(f"{a}.za" for a in ("co", "org", "net", "ac", "gov", "web")),
    *(f"{a}.jp" for a in ("co", "or", "ne", "ac", "go", "ad", "ed", "gr", "lg")),
    *(f"{a}.kr" for a in ("co", "or", "ne", "ac", "go", "re")),
    *(f"{a}.in" for a in ("co", "net", "org", "gen", "firm", "ac", "gov", "edu", "res")),
    *(f"{a}.{c}" for c in ("br", "cn", "tw", "hk", "sg", "my", "mx", "ar", "tr", "ph", "pk", "ua", "vn", "sa", "eg", "pe", "co") for a in ("com", "net", "org", "edu", "gov")),
    *(f"{a}.{c}" for c in ("id", "th", "il", "ke") for a in ("co", "ac", "go", "or")),
    "*.ck", "!www.ck", "*.bd", "*.kh", "*.np", "*.er", "*.fk",
)

#: The largest reference list that is written into expressions; larger ones are joined.
MAX_LITERALS = 1000

#: A feed of more indicators is put before its join as a filter of bounded size.
LARGE_FEED = 100_000


@dataclass(frozen=True)
class RiskConfig:
    """Thresholds of the detectors."""

    entropy_threshold: float = 3.8
    entropy_min_length: int = 8
    path_entropy_threshold: float = 4.3
    path_entropy_length: int = 25
    max_url_length: int = 150
    max_hostname_length: int = 40
    max_subdomains: int = 3
    max_hyphens: int = 2
    max_query_params: int = 5
    min_percent: int = 3
    common_ports: tuple[int, ...] = field(default=(80, 443, 8080, 8443))
    #: Trusted names shorter than this are not compared for similarity.
    min_trusted_sld_len: int = 1
