"""The registered queries again, as SQL for DuckDB over the same tables."""

from __future__ import annotations

import re
import unicodedata

from urlrisk import config as C
from urlrisk.plans.fixtures import IOC_FEED, MESSAGES, REPORT_THIRDS, SUFFIX_HOSTS, URL_CORPUS, URL_LINES, URL_THIRDS
from urlrisk.sources.reference import default_suffixes


def _rows(rows) -> str:
    def value(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return "VALUES " + ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows)


_KEYWORDS = [
    (kind, i, w)
    for kind, ws in (("credential", C.CREDENTIAL_KEYWORDS), ("financial", C.FINANCIAL_KEYWORDS), ("urgency", C.URGENCY_KEYWORDS), ("lure", C.LURE_KEYWORDS))
    for i, w in enumerate(ws)
]
_TRUSTED = [(i, d, d.split(".")[0]) for i, d in enumerate(C.TRUSTED_DOMAINS)]
_BRANDS = [(i, b, d) for i, (b, ds) in enumerate(C.BRAND_DOMAINS.items()) for d in ds]
_SEEDS = [(i + 1, *r) for i, r in enumerate(C.DEFAULT_IOCS)]
_LOOKS = [(i, c, f"'{c}' ({unicodedata.name(c)})") for i, c in enumerate(C.HOMOGLYPH_FROM)]
#: The encoded labels of the corpus, decoded.
_DECODED = [("xn--mchen-kva", "müchen"), ("xn--pple-43d", "аpple"), ("xn--fa-hia", "faß"), ("xn--strae-oqa", "straße")]
#: A full URL in a text, and what may be a host without a scheme or an e-mail address.
_URL = r"""[a-zA-Z][a-zA-Z0-9+.-]*://[^\s<>"'']+"""
_BARE = r"""[^\s<>"''()\[\]{},;:!?/\\|*=#`~“”„«»\x01]+(?::[0-9]{1,5})?(?:[/?#][^\s<>"''\x01]*)?"""
#: What no host of the corpus may hold, or not in this place, if it is to be encoded.
_NOT_ENCODED = "❤|a·b"

#: Each later part may use the earlier ones.
PARTS = {
    "url_corpus": URL_CORPUS,
    "trusted(pos, domain, sld)": _rows(_TRUSTED),
    "brands(pos, brand, legit_domain)": _rows(_BRANDS),
    "keywords(kind, pos, keyword)": _rows(_KEYWORDS),
    "tlds(pos, tld)": _rows(list(enumerate(C.SUSPICIOUS_TLDS))),
    "seeds(id, indicator, indicator_type, source, severity, description)": _rows(_SEEDS),
    "rules": f"""SELECT ltrim(r, '!') AS rule, CASE r[1] WHEN '!' THEN 'exception' WHEN '*' THEN 'wildcard' ELSE 'normal' END AS kind
        FROM (SELECT unnest(string_split('{" ".join(sorted(set(default_suffixes())))}', ' ')) AS r)""",
    "decoded(code, plain)": _rows(_DECODED),
    "advice(classification, recommendation)": _rows(list(C.RECOMMENDATIONS.items())),
    "raw": r"""SELECT url_id, regexp_replace(url, '^\s+|\s+$', '', 'g') AS original_url FROM url_corpus""",
    "c1": r"""SELECT *, CASE WHEN regexp_matches(original_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN original_url ELSE 'http://' || original_url END AS w FROM raw""",
    "c2": r"""SELECT *, lower(regexp_extract(w, '^([^:]+)://', 1)) AS scheme, regexp_extract(w, '^[^:]+://([^/?#]*)', 1) AS netloc,
        regexp_extract(w, '^[^:]+://[^/?#]*([^#]*)', 1) AS tail FROM c1""",
    "c3": r"""SELECT *, regexp_replace(regexp_extract(tail, '^[^?]*'), ';[^/]*$', '') AS p,
        CASE WHEN position('?' IN tail) > 0 THEN substr(tail, position('?' IN tail) + 1) ELSE '' END AS q, regexp_extract(netloc, '[^@]*$') AS hostinfo,
        (netloc LIKE '%[%') <> (netloc LIKE '%]%') AS broken, netloc LIKE '%[%]%' AS v6 FROM c2""",
    "c4": r"""SELECT *, CASE WHEN v6 THEN regexp_extract(hostinfo, '\]:(.*)$', 1) WHEN hostinfo LIKE '%:%' THEN regexp_extract(hostinfo, '^[^:]*:(.*)$', 1) ELSE '' END AS port_text, original_url = '' OR broken AS dead FROM c3""",
    "c5": r"""SELECT *, port_text <> '' AND (NOT regexp_matches(port_text, '^[0-9]+$') OR TRY_CAST(port_text AS BIGINT) > 65535) AS bad_port FROM c4""",
    "c6": r"""SELECT *, CASE WHEN dead THEN '' WHEN v6 THEN lower(regexp_extract(hostinfo, '\[([^\]]*)', 1)) WHEN bad_port OR split_part(hostinfo, ':', 1) = '' THEN lower(split_part(netloc, ':', 1)) ELSE lower(split_part(hostinfo, ':', 1)) END AS hostname FROM c5""",
    "norm": r"""SELECT url_id, original_url, CASE WHEN dead THEN '' ELSE scheme END AS scheme, hostname,
        CASE WHEN dead THEN '' WHEN p = '' THEN '/' ELSE p END AS path, CASE WHEN dead THEN '' ELSE q END AS query,
        CASE WHEN hostname <> '' AND NOT bad_port THEN TRY_CAST(port_text AS INT) END AS port,
        v6 OR regexp_matches(hostname, '^[0-9]{1,3}(\.[0-9]{1,3}){3}$') AND len(list_filter(string_split(hostname, '.'), lambda x: TRY_CAST(x AS INT) > 255)) = 0 AS is_ip,
        hostname <> '' AS is_valid,
        CASE WHEN original_url = '' THEN 'Empty URL provided' WHEN broken THEN 'Malformed URL: Invalid IPv6 URL' WHEN hostname = '' THEN 'Could not determine hostname from URL' END AS error,
        dead FROM c6""",
    "canon": r"""SELECT url_id, CASE WHEN dead THEN original_url ELSE scheme || '://' || hostname
        || CASE WHEN port > 0 AND ((scheme = 'http' AND port <> 80) OR (scheme = 'https' AND port <> 443)) THEN ':' || port ELSE '' END
        || path || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS normalized_url FROM norm""",
    "hosts": r"""SELECT DISTINCT hostname, is_ip, CASE WHEN is_ip THEN regexp_replace(hostname, ':0+([0-9a-f])', ':\1', 'g') END AS ip_address, string_split(hostname, '.') AS labels FROM norm WHERE is_valid""",
    "idn": rf"""SELECT hostname, (regexp_matches(hostname, '[^\x00-\x7F]') AND NOT regexp_matches(hostname, '{_NOT_ENCODED}')) OR contains(hostname, 'xn--') AS is_punycode, coalesce(max(replace(hostname, code, plain)), hostname) AS unicode_domain
        FROM hosts LEFT JOIN decoded ON contains(hostname, code) GROUP BY hostname""",
    "tails": r"""SELECT hostname, k, array_to_string(labels[len(labels) - k + 1 : len(labels)], '.') AS tail FROM (SELECT hostname, labels, unnest(range(1, len(labels) + 1)) AS k FROM hosts WHERE NOT is_ip)""",
    "keyed": r"""SELECT hostname, k, tail AS rule FROM tails UNION ALL SELECT hostname, k + 1, '*.' || tail FROM tails""",
    "best": r"""SELECT hostname, coalesce(max(k) FILTER (WHERE kind = 'exception') - 1, max(k)) AS n_suffix FROM keyed JOIN rules USING (rule) JOIN hosts USING (hostname) WHERE k <= len(labels) GROUP BY hostname""",
    "dom": r"""SELECT hostname, is_ip, CASE WHEN is_ip THEN ip_address WHEN whole THEN hostname ELSE array_to_string(labels[greatest(len(labels) - keep + 1, 1) : len(labels)], '.') END AS registered_domain,
        CASE WHEN is_ip OR whole OR len(labels) <= keep THEN '' ELSE array_to_string(labels[1 : len(labels) - keep], '.') END AS subdomain
        FROM (SELECT h.*, len(labels) <= coalesce(n_suffix, 1) AS whole, CASE WHEN n_suffix IS NULL THEN 2 ELSE n_suffix + 1 END AS keep FROM hosts h LEFT JOIN best USING (hostname))""",
    "full_rows": r"""SELECT n.*, d.registered_domain, d.subdomain, c.normalized_url, split_part(d.registered_domain, '.', 1) AS label FROM norm n JOIN dom d USING (hostname) JOIN canon c USING (url_id) WHERE n.is_valid""",
    # indicators
    "cand_all": r"""SELECT url_id, 0 AS pos, lower(original_url) AS candidate FROM full_rows UNION ALL SELECT url_id, 1, lower(normalized_url) FROM full_rows
        UNION ALL SELECT f.url_id, 1 + len(string_split(f.hostname, '.')) - t.k + 1, t.tail FROM full_rows f
            JOIN (SELECT hostname, k, array_to_string(labels[len(labels) - k + 1 : len(labels)], '.') AS tail FROM (SELECT hostname, labels, unnest(range(1, len(labels) + 1)) AS k FROM hosts)) t USING (hostname)
        UNION ALL SELECT url_id, 2 + len(string_split(hostname, '.')), lower(registered_domain) FROM full_rows""",
    "cand": r"""SELECT url_id, min(pos) AS pos, candidate FROM cand_all WHERE candidate <> '' GROUP BY url_id, candidate""",
    "ioc": r"""SELECT url_id, arg_min(s.id, pos) AS id FROM cand JOIN seeds s ON s.indicator = candidate GROUP BY url_id""",
    "ioc_rows": r"""SELECT url_id, s.* FROM ioc JOIN seeds s USING (id)""",
    "flags": r"""SELECT f.url_id, i.id IS NOT NULL AS known_ioc, coalesce(i.source, '') AS ioc_source, t.domain IS NOT NULL AND i.id IS NULL AS is_trusted
        FROM full_rows f LEFT JOIN ioc_rows i USING (url_id) LEFT JOIN trusted t ON t.domain = lower(f.registered_domain)""",
    # look-alikes
    "own": r"""SELECT DISTINCT lower(registered_domain) AS rd, split_part(lower(registered_domain), '.', 1) AS sld FROM dom WHERE NOT is_ip AND lower(registered_domain) NOT IN (SELECT domain FROM trusted)""",
    "texts": r"""SELECT rd, false AS is_chunk, sld AS text FROM own UNION SELECT rd, true, trim(unnest(string_split(sld, '-'))) FROM own WHERE contains(sld, '-')""",
    "pr(a, b)": r"""SELECT DISTINCT text, sld FROM texts, trusted WHERE text <> '' AND abs(length(text) - length(sld)) <= 2""",
    "o(a, b, i, j, p2, p, cur)": r"""
        SELECT a, b, 1, 1, CAST([] AS INT[]), CAST(range(0, length(b) + 1) AS INT[]), [1]::INT[] FROM pr
        UNION ALL
        SELECT a, b,
            CASE WHEN j > length(b) THEN i + 1 ELSE i END,
            CASE WHEN j > length(b) THEN 1 ELSE j + 1 END,
            CASE WHEN j > length(b) THEN p ELSE p2 END,
            CASE WHEN j > length(b) THEN cur ELSE p END,
            CASE WHEN j > length(b) THEN [i + 1] ELSE list_append(cur, least(
                p[j + 1] + 1, cur[j] + 1, p[j] + (CASE WHEN a[i] = b[j] THEN 0 ELSE 1 END),
                CASE WHEN i > 1 AND j > 1 AND a[i] = b[j - 1] AND a[i - 1] = b[j] THEN p2[j - 1] + 1 ELSE 9999 END)) END
        FROM o WHERE i <= length(a)""",
    "dist": r"""SELECT a, b, p[length(b) + 1] AS d FROM o WHERE i = length(a) + 1 AND j = 1""",
    "similar_rows": r"""SELECT rd AS registered_domain, t.pos, 1 AS rule, t.domain FROM texts JOIN dist ON a = text JOIN trusted t ON t.sld = b
            WHERE NOT is_chunk AND d > 0 AND d <= CASE WHEN greatest(length(a), length(b)) <= 6 THEN 1 ELSE 2 END
        UNION SELECT rd, t.pos, 2, t.domain FROM texts JOIN trusted t ON translate(text, '013458@$', 'oleasbas') = t.sld WHERE NOT is_chunk AND text <> t.sld
        UNION SELECT rd, t.pos, 3, t.domain FROM texts JOIN dist ON a = text JOIN trusted t ON t.sld = b WHERE is_chunk AND d <= CASE WHEN length(b) <= 6 THEN 1 ELSE 2 END
        UNION SELECT rd, t.pos, 3, t.domain FROM texts JOIN trusted t ON translate(text, '013458@$', 'oleasbas') = t.sld WHERE is_chunk""",
    "typo": r"""SELECT registered_domain, arg_min(domain, pos * 10 + rule) AS domain, arg_min(rule, pos * 10 + rule) AS rule FROM similar_rows GROUP BY 1""",
    "looks(pos, ch, called)": _rows(_LOOKS),
    "mixed": r"""SELECT DISTINCT hostname FROM (SELECT hostname, unnest(string_split(unicode_domain, '.')) AS label FROM hosts JOIN idn USING (hostname) WHERE NOT is_ip)
        WHERE regexp_matches(label, '[A-Za-zÀ-ÖØ-öø-ʸ]') AND regexp_matches(label, '[Ͱ-ͳͶͷͻ-ͽͿΆΈ-ϿЀ-ҁҊ-ԯ]')""",
    "folded": f"""SELECT hostname, registered_domain, translate(registered_domain, '{C.HOMOGLYPH_FROM}', '{C.HOMOGLYPH_TO}') AS imitated FROM dom WHERE NOT is_ip""",
    "alike": r"""SELECT hostname, array_to_string(list(called ORDER BY place)[1:3], ', ') AS characters FROM (SELECT hostname, called, position(ch IN unicode_domain) AS place
        FROM hosts JOIN idn USING (hostname) JOIN looks ON contains(unicode_domain, ch) WHERE NOT is_ip AND hostname NOT IN (SELECT hostname FROM mixed)) GROUP BY hostname""",
    # brands
    "not_own": r"""SELECT d.hostname, lower(d.registered_domain) AS rd, lower(d.subdomain) AS sub, split_part(lower(d.registered_domain), '.', 1) AS label, b.pos, b.brand
        FROM dom d, (SELECT DISTINCT pos, brand FROM brands) b WHERE NOT d.is_ip
        AND NOT EXISTS (SELECT 1 FROM brands l WHERE l.pos = b.pos AND (lower(d.registered_domain) = l.legit_domain OR lower(d.registered_domain) LIKE '%.' || l.legit_domain))""",
    "lured": r"""SELECT n.hostname, n.pos, arg_min(k.keyword, k.pos) AS lure FROM not_own n JOIN keywords k ON k.kind = 'lure' AND contains(n.label, k.keyword) GROUP BY 1, 2""",
    "brand_rows": r"""SELECT hostname, pos, 1 AS rule, brand, rd, 'suspicious compound' AS lure FROM not_own WHERE list_contains(regexp_split_to_array(sub, '[-.]'), brand)
        UNION ALL SELECT n.hostname, n.pos, 2, brand, rd, coalesce(lure, 'suspicious compound') FROM not_own n LEFT JOIN lured l ON l.hostname = n.hostname AND l.pos = n.pos
            WHERE contains(label, brand) AND (lure IS NOT NULL OR regexp_matches(label, '[-_]') OR length(label) > length(brand) + 2)""",
    "brand_first": r"""SELECT hostname, arg_min(rule, pos * 10 + rule) AS rule, arg_min(brand, pos * 10 + rule) AS brand, arg_min(rd, pos * 10 + rule) AS rd, arg_min(lure, pos * 10 + rule) AS lure FROM brand_rows GROUP BY 1""",
    # entropy
    "strings(s)": r"""SELECT label FROM full_rows UNION SELECT subdomain FROM full_rows UNION SELECT path FROM full_rows""",
    "ent": r"""SELECT s, round(-sum(n / l * log2(n / l)), 3) AS h FROM (SELECT s, ch, count(*)::DOUBLE AS n, any_value(length(s))::DOUBLE AS l FROM (SELECT s, unnest(string_split(s, '')) AS ch FROM strings WHERE s <> '') GROUP BY s, ch) GROUP BY s""",
    "ent_rows": r"""SELECT f.*, coalesce(a.h, 0) AS h_label, coalesce(b.h, 0) AS h_sub, coalesce(c.h, 0) AS h_path FROM full_rows f
        LEFT JOIN ent a ON a.s = f.label LEFT JOIN ent b ON b.s = f.subdomain LEFT JOIN ent c ON c.s = f.path""",
    # words of the path
    "tokens": r"""SELECT url_id, unnest(regexp_split_to_array(lower(path), '[/_.-]')) AS token FROM full_rows""",
    "words": r"""SELECT url_id, kind, arg_min(keyword, pos) AS keyword FROM tokens JOIN keywords ON keyword = token AND kind IN ('credential', 'financial') GROUP BY 1, 2
        UNION ALL SELECT url_id, kind, arg_min(keyword, pos) FROM full_rows JOIN keywords ON kind = 'urgency' AND contains(lower(path || '?' || query), keyword) GROUP BY 1, 2""",
    "params": r"""SELECT url_id, count(DISTINCT split_part(kv, '=', 1)) AS n FROM (SELECT url_id, unnest(string_split(query, '&')) AS kv FROM full_rows) WHERE regexp_matches(kv, '^[^=]*=.') GROUP BY 1""",
    "sig": r"""
        SELECT url_id, 0 AS ord, 'Known malicious IOC' AS name, severity, 'Matched active threat indicator ''' || indicator || ''' in reputation database (' || source || '): ' || description AS evidence, 0 AS weight FROM ioc_rows
        UNION ALL SELECT url_id, 1, 'Typosquatting', 'high', CASE rule WHEN 3 THEN 'Domain contains typosquatted variation of trusted domain ' || t.domain
            WHEN 2 THEN 'Domain is highly similar to trusted domain ' || t.domain || ' via character substitution' ELSE 'Domain is highly similar to trusted domain ' || t.domain END, 15
            FROM full_rows f JOIN typo t ON t.registered_domain = lower(f.registered_domain)
        UNION ALL SELECT url_id, 2, 'Punycode domain detected', 'medium', 'Domain uses Punycode encoding (' || hostname || ' -> ' || unicode_domain || ')', 8 FROM full_rows JOIN idn USING (hostname) WHERE is_punycode AND NOT is_ip
        UNION ALL SELECT url_id, 3, 'Mixed-script domain spoofing', 'high', 'Domain contains characters from multiple scripts that may imitate a trusted domain', 15 FROM full_rows JOIN mixed USING (hostname)
        UNION ALL SELECT url_id, 3, 'Homoglyph characters detected', 'medium', 'Domain contains characters visually resembling Latin characters: ' || characters, 8 FROM full_rows JOIN alike USING (hostname)
        UNION ALL SELECT url_id, 4, 'Homoglyph brand impersonation', 'high', 'Homoglyph-normalized domain ''' || imitated || ''' imitates trusted domain ''' || domain || '''', 15
            FROM full_rows JOIN folded USING (hostname) JOIN trusted ON domain = imitated WHERE imitated <> folded.registered_domain
        UNION ALL SELECT url_id, 5, CASE WHEN length(label) >= 8 AND h_label >= 3.8 THEN 'High entropy hostname' ELSE 'High entropy subdomain' END, 'low',
            CASE WHEN length(label) >= 8 AND h_label >= 3.8 THEN 'Hostname has unusually high character entropy (H=' || printf('%.2f', h_label) ELSE 'Subdomain has unusually high character entropy (H=' || printf('%.2f', h_sub) END || ', threshold=3.80)', 5
            FROM ent_rows WHERE NOT is_ip AND ((length(label) >= 8 AND h_label >= 3.8) OR (length(subdomain) >= 8 AND h_sub >= 3.8))
        UNION ALL SELECT url_id, 6, 'High entropy path component', 'low', 'URL path exhibits unusually high character entropy (H=' || printf('%.2f', h_path) || ')', 5 FROM ent_rows WHERE NOT is_ip AND length(path) > 25 AND h_path >= 4.3
        UNION ALL SELECT url_id, 7, 'Raw IP address hostname', 'medium', 'URL uses a raw IP address (' || hostname || ') instead of a domain name', 15 FROM full_rows WHERE is_ip
        UNION ALL SELECT url_id, 8, 'Suspicious TLD', 'medium', 'Domain uses TLD ''' || tld || ''' frequently abused in phishing campaigns', 12 FROM full_rows JOIN tlds ON ends_with(lower(registered_domain), tld)
        UNION ALL SELECT url_id, 9, 'Excessive subdomains', 'low', 'URL contains excessive subdomain levels (' || len(string_split(subdomain, '.')) || ' levels)', 5 FROM full_rows WHERE subdomain <> '' AND len(string_split(subdomain, '.')) >= 3
        UNION ALL SELECT url_id, 10, 'Excessive hyphens in hostname', 'low', 'Hostname contains ' || n || ' hyphens, often used to bypass filters', 5
            FROM (SELECT url_id, length(replace(hostname, 'xn--', '')) - length(replace(replace(hostname, 'xn--', ''), '-', '')) AS n FROM full_rows) WHERE n > 2
        UNION ALL SELECT url_id, 11, 'Unusually long URL', 'low', 'URL is unusually long (' || length(original_url) || ' characters)', 0 FROM full_rows WHERE length(original_url) > 150
        UNION ALL SELECT url_id, 12, 'Unusually long hostname', 'low', 'Hostname is unusually long (' || length(hostname) || ' characters)', 0 FROM full_rows WHERE length(hostname) > 40
        UNION ALL SELECT url_id, 13, 'Obfuscated URL with authority delimiter', 'high', 'URL contains ''@'' in authority section, commonly used to disguise destination domain', 20 FROM full_rows WHERE contains(regexp_extract(original_url, '^[^?#]*'), '@')
        UNION ALL SELECT url_id, 14, 'Nested or open redirect URL pattern', 'medium', 'URL path or query parameters contain embedded URL indicator: ' || hit, 10
            FROM (SELECT url_id, regexp_extract(path || '?' || query, '(?i)(https?://|www\.)', 1) AS hit FROM full_rows) WHERE hit <> ''
        UNION ALL SELECT url_id, 15, 'Excessive percent-encoding', 'low', 'URL contains ' || n || ' percent-encoded sequences', 5 FROM (SELECT url_id, len(regexp_extract_all(original_url, '%[0-9a-fA-F]{2}')) AS n FROM full_rows) WHERE n >= 3
        UNION ALL SELECT url_id, 16, 'Excessive query parameters', 'low', 'URL contains ' || n || ' query parameters', 5 FROM params WHERE n > 5
        UNION ALL SELECT url_id, 17, 'Non-standard port', 'medium', 'URL directs to uncommon non-standard port ' || port, 10 FROM full_rows WHERE port > 0 AND port NOT IN (80, 443, 8080, 8443)
        UNION ALL SELECT url_id, 18, 'Credential-related path', 'medium', 'URL path contains credential/authentication intent keyword: ''' || keyword || '''', 15 FROM words WHERE kind = 'credential'
        UNION ALL SELECT url_id, 19, 'Financial/payment intent', 'medium', 'URL path contains financial or payment intent keyword: ''' || keyword || '''', 10 FROM words WHERE kind = 'financial'
        UNION ALL SELECT url_id, 20, 'Urgency-inducing keyword', 'low', 'URL contains urgency-inducing keyword: ''' || keyword || '''', 8 FROM words WHERE kind = 'urgency'
        UNION ALL SELECT url_id, 21, CASE rule WHEN 1 THEN 'Brand impersonation in subdomain' ELSE 'Brand impersonation' END, 'high',
            CASE rule WHEN 1 THEN 'Brand ''' || brand || ''' appears in subdomain on unrelated registered domain ''' || rd || '''' ELSE 'Domain ''' || rd || ''' embeds brand ''' || brand || ''' alongside ' || lure || ' pattern' END, 20
            FROM full_rows JOIN brand_first USING (hostname)""",
    "kept": r"""SELECT s.* FROM sig s JOIN flags USING (url_id) WHERE NOT (is_trusted AND ord IN (18, 19, 20))""",
    "sums": r"""SELECT f.url_id, f.known_ioc, f.is_trusted, coalesce(sum(weight), 0) + CASE WHEN known_ioc THEN 40 + CASE WHEN contains(lower(ioc_source), 'community') THEN 15 ELSE 0 END ELSE 0 END AS total,
        count(name) AS n_signals, count(*) FILTER (WHERE severity IN ('high', 'critical')) AS n_high, count(*) FILTER (WHERE severity = 'medium') AS n_medium, count(*) FILTER (WHERE severity = 'low') AS n_low,
        coalesce(string_agg(name || '|' || severity || '|' || evidence, ';' ORDER BY ord), '') AS signals
        FROM flags f LEFT JOIN kept USING (url_id) GROUP BY f.url_id, f.known_ioc, f.is_trusted, f.ioc_source""",
    "scored": r"""SELECT *, CAST(least(100, CASE WHEN known_ioc THEN greatest(total, 80) ELSE total END) AS INT) AS risk_score FROM sums""",
    "classed": r"""SELECT *, CASE WHEN risk_score >= 75 THEN 'CRITICAL' WHEN risk_score >= 50 THEN 'HIGH' WHEN risk_score >= 25 THEN 'CAUTION' ELSE 'LOW' END AS risk_level,
        CASE WHEN known_ioc THEN 'Known Malicious' WHEN risk_score >= 50 OR n_high >= 2 OR (n_high >= 1 AND n_medium >= 1) THEN 'Potential Phishing'
             WHEN risk_score >= 25 OR n_medium >= 2 OR n_high >= 1 THEN 'Suspicious' WHEN risk_score > 0 OR n_medium = 1 OR n_low > 0 THEN 'Low Risk' ELSE 'Safe' END AS classification,
        CAST(CASE WHEN known_ioc THEN 0.98 WHEN is_trusted AND n_signals = 0 THEN 0.95 WHEN n_high >= 2 THEN 0.92 WHEN n_high = 1 AND n_medium >= 1 THEN 0.88 WHEN n_high = 1 THEN 0.80
             WHEN n_medium >= 2 THEN 0.78 WHEN n_medium = 1 THEN 0.60 WHEN n_signals > 0 THEN 0.55 ELSE 0.85 END AS DOUBLE) AS confidence FROM scored""",
    "verdicts": f"""SELECT url_id, risk_score, risk_level, classification, confidence, known_ioc, signals, recommendation, n_signals FROM classed JOIN advice USING (classification)
        UNION ALL SELECT url_id, 5, 'LOW', 'Low Risk', CAST(0.5 AS DOUBLE), false, 'Malformed URL|low|' || error, '{C.MALFORMED_RECOMMENDATION}', 1 FROM norm WHERE NOT is_valid""",
    "messages": MESSAGES,
    # URLs in messages: full ones are marked, so that hosts are found around them
    "marked": f"""SELECT msg_id, regexp_replace(replace(text, chr(1), ' '), '({_URL})', ' ' || chr(1) || '\\1 ', 'g') AS t FROM messages""",
    "tokens_of": f"""SELECT msg_id, unnest(list_transform(regexp_extract_all(t, chr(1) || '[^\\s<>"'']+|' || '{_BARE}'), lambda u, i: struct_pack(place := i, u := regexp_replace(u, '[.,;:!?)\\]}}]+$', '')))) AS e FROM marked""",
    "named": r"""SELECT msg_id, e.place AS place, CASE WHEN starts_with(e.u, chr(1)) THEN substr(e.u, 2) ELSE e.u END AS url, CASE WHEN NOT starts_with(e.u, chr(1)) THEN lower(regexp_extract(e.u, '^[^:/?#]+')) END AS hostname
        FROM tokens_of WHERE starts_with(e.u, chr(1)) OR contains(e.u, '.')""",
    "hosts_bare": r"""SELECT hostname, false AS is_ip, NULL::VARCHAR AS ip_address, string_split(hostname, '.') AS labels FROM (SELECT DISTINCT hostname FROM named WHERE hostname IS NOT NULL)
        WHERE len(string_split(hostname, '.')) > 1 AND len(list_filter(string_split(hostname, '.'), lambda x: NOT regexp_matches(x, '^[^-_@%+$&^]([^_@%+$&^]*[^-_@%+$&^])?$'))) = 0 AND NOT regexp_matches(hostname, '\.[0-9][^.]*$')""",
    "msg_urls": r"""SELECT msg_id, CAST(row_number() OVER (PARTITION BY msg_id ORDER BY place) - 1 AS INT) AS pos, url FROM named n
        WHERE n.hostname IS NULL OR n.hostname IN (SELECT b.hostname FROM best_bare b JOIN hosts_bare h USING (hostname) WHERE len(h.labels) > b.n_suffix)""",
    "hosts_listed": f"SELECT hostname, false AS is_ip, NULL::VARCHAR AS ip_address, string_split(hostname, '.') AS labels FROM ({SUFFIX_HOSTS})",
    "ioc_feed": IOC_FEED,
    "reports": f"SELECT *, row_number() OVER (ORDER BY seq) AS n FROM ({REPORT_THIRDS})",
    "ioc_last": r"""SELECT max(n) AS n, indicator, arg_max(indicator_type, n) AS indicator_type, arg_max(source, n) AS source, arg_max(severity, n) AS severity, arg_max(description, n) AS description FROM reports GROUP BY indicator""",
    "ioc_after": r"""SELECT CAST(4 + n AS BIGINT) AS id, indicator, indicator_type, source, severity, description FROM ioc_last
        UNION ALL SELECT id, indicator, indicator_type, source, severity, description FROM seeds WHERE indicator NOT IN (SELECT indicator FROM ioc_last)""",
    # what a third of the URLs sees of the reports
    "url_thirds": URL_THIRDS,
    "seen(third)": "VALUES (0), (1), (2)",
    "iocs_seen": r"""SELECT v.third, 4 + max(r.n) AS id, indicator, arg_max(indicator_type, r.n) AS indicator_type, arg_max(source, r.n) AS source, arg_max(severity, r.n) AS severity, arg_max(description, r.n) AS description
        FROM seen v JOIN reports r ON r.third < v.third GROUP BY v.third, indicator
        UNION ALL SELECT v.third, s.* FROM seen v, seeds s WHERE NOT EXISTS (SELECT 1 FROM reports r WHERE r.third < v.third AND r.indicator = s.indicator)""",
    "ioc_live": r"""SELECT url_id, u.third, arg_min(s.id, pos) AS id FROM cand JOIN url_thirds u USING (url_id) JOIN iocs_seen s ON s.indicator = candidate AND s.third = u.third GROUP BY url_id, u.third""",
    "ioc_rows_live": r"""SELECT i.url_id, s.* FROM ioc_live i JOIN iocs_seen s ON s.id = i.id AND s.third = i.third""",
    # detectors of one's own, and one of the others left out
    "sig_own": r"""SELECT * FROM sig WHERE ord <> 9
        UNION ALL SELECT url_id, 22, 'Login over plain HTTP', 'medium', 'Path ' || path || ' is not encrypted on its way', 7 FROM full_rows WHERE scheme = 'http' AND contains(lower(path), 'login')
        UNION ALL SELECT url_id, 23, 'Excessive digits in hostname', 'low', 'Hostname contains ' || length(regexp_replace(hostname, '[^0-9]', '', 'g')) || ' digits', 5 FROM full_rows
            WHERE NOT is_ip AND length(regexp_replace(hostname, '[^0-9]', '', 'g')) >= 4
        UNION ALL SELECT url_id, 24, 'Long domain', 'low', 'Domain has ' || length(registered_domain) || ' characters', 3 FROM full_rows WHERE NOT is_ip AND length(registered_domain) > 25""",
    "shown": r"""SELECT url_id, to_json(struct_pack(risk_score := risk_score, risk_level := risk_level, classification := classification, confidence := confidence, known_ioc := known_ioc,
        signals := CASE WHEN signals = '' THEN [] ELSE list_transform(string_split(signals, ';'), lambda s: struct_pack(name := split_part(s, '|', 1), severity := split_part(s, '|', 2), evidence := split_part(s, '|', 3))) END,
        recommendation := recommendation)) AS verdict FROM verdicts""",
}


#: Parts that are built on each other, to be built once more on another first one.
_FROM_HOST = ("hosts", "tails", "keyed", "best", "dom")
_FROM_MATCH = ("ioc_rows", "flags", "sig", "kept", "sums", "scored", "classed", "verdicts")


def _again(suffix: str, chain: tuple[str, ...]) -> dict[str, str]:
    """The later parts of ``chain`` once more, built on the first one's ``<first>_<suffix>``."""
    names = re.compile(rf"\b({'|'.join(chain)})\b")
    return {f"{name}_{suffix}": names.sub(rf"\1_{suffix}", PARTS[name]) for name in chain[1:]}


PARTS |= _again("live", _FROM_MATCH) | _again("own", _FROM_MATCH[2:]) | _again("bare", _FROM_HOST[:4]) | _again("listed", _FROM_HOST)
PARTS["msg_urls"] = PARTS.pop("msg_urls")  # it is built on one of these


def oracle(select: str) -> str:
    """``select`` with the parts that it is built on."""
    wanted, left = set(), [select]
    by_name = {key.split("(")[0]: key for key in PARTS}
    while left:
        for name in set(re.findall(r"\w+", left.pop())) & set(by_name) - wanted:
            wanted.add(name)
            left.append(PARTS[by_name[name]])
    order = [key for name, key in by_name.items() if name in wanted]
    return "WITH RECURSIVE " + ",\n".join(f"{key} AS ({PARTS[key]})" for key in order) + "\n" + select if order else select


_SIG = "SELECT url_id, name, severity, evidence, weight FROM sig WHERE ord = "
#: Columns of a verdict whose signals are one text.
VERDICT = "url_id, risk_score, risk_level, classification, confidence, known_ioc, signals, recommendation"

SELECTS = {
    "read_urls": "SELECT url_id, url FROM url_corpus WHERE url IS NOT NULL AND url <> ''",
    "read_tables": f"""SELECT 'parquet' AS fmt, true AS accepted, url_id, url FROM url_corpus
        UNION ALL SELECT 'csv', true, url_id, url FROM url_corpus WHERE url_id % 10 NOT IN (7, 8)
        UNION ALL SELECT 'csv', false, CASE WHEN url_id % 10 = 8 THEN url_id END, CASE WHEN url_id % 10 = 7 THEN value END FROM (SELECT url_id, ({URL_LINES["csv"].replace("FROM url_corpus", "")}) AS value FROM url_corpus) WHERE url_id % 10 IN (7, 8)
        UNION ALL SELECT 'json', true, url_id, url FROM url_corpus WHERE url_id % 10 NOT IN (7, 8, 9)
        UNION ALL SELECT 'json', false, CASE WHEN url_id % 10 <> 7 THEN url_id END, CASE url_id % 10 WHEN 7 THEN value WHEN 9 THEN '' END FROM (SELECT url_id, ({URL_LINES["json"].replace("FROM url_corpus", "")}) AS value FROM url_corpus) WHERE url_id % 10 IN (7, 8, 9)""",
    "extract_urls": "SELECT msg_id, pos, url FROM msg_urls",
    "public_suffixes": "SELECT hostname, registered_domain, subdomain FROM dom_listed",
    "ioc_seed": "SELECT s.id, s.indicator, s.severity, count(i.url_id) AS n_urls FROM seeds s LEFT JOIN ioc i USING (id) GROUP BY ALL",
    "brand_domains": "SELECT b.pos, b.brand, b.legit_domain, count(f.url_id) AS n_urls FROM brands b LEFT JOIN full_rows f ON lower(f.registered_domain) = b.legit_domain GROUP BY ALL",
    "normalize_components": "SELECT url_id, original_url, scheme, hostname, path, query, port, is_valid FROM norm",
    "host_ip": "SELECT hostname, is_ip, ip_address FROM hosts",
    "idn_hosts": "SELECT hostname, is_punycode, unicode_domain FROM idn",
    "verdict_json": "SELECT url_id, CAST(verdict AS VARCHAR) AS verdict FROM shown",
    "registered_domain": "SELECT hostname, registered_domain, subdomain FROM dom",
    "canonical_url": "SELECT url_id, normalized_url FROM canon",
    "malformed": "SELECT url_id, original_url, error FROM norm WHERE NOT is_valid",
    "ioc_candidates": "SELECT url_id, CAST(pos AS INT) AS pos, candidate FROM cand",
    "ioc_match": "SELECT url_id, indicator, indicator_type, source, severity, description FROM ioc_rows",
    "ioc_upsert": "SELECT id, indicator, indicator_type, source, severity, description FROM ioc_after",
    "ioc_report_stream": "SELECT id, indicator, indicator_type, source, severity, description FROM ioc_after",
    "ioc_top": "SELECT id, indicator, source, severity FROM ioc_after ORDER BY id DESC LIMIT 5",
    "ioc_signals": "SELECT url_id, name, severity, evidence FROM sig WHERE ord = 0",
    "trusted_flag": "SELECT url_id, is_trusted FROM flags",
    "typosquat_direct": "SELECT registered_domain, pos, domain FROM similar_rows WHERE rule = 1",
    "typosquat_leet": "SELECT registered_domain, pos, domain FROM similar_rows WHERE rule = 2",
    "typosquat_combo": "SELECT registered_domain, pos, domain FROM similar_rows WHERE rule = 3",
    "typosquat": "SELECT registered_domain, domain, rule FROM typo",
    "punycode": "SELECT hostname, unicode_domain FROM hosts JOIN idn USING (hostname) WHERE NOT is_ip AND is_punycode",
    "mixed_script": "SELECT hostname FROM mixed",
    "homoglyph_chars": "SELECT hostname, characters FROM alike",
    "homoglyph_brand": "SELECT hostname, imitated FROM folded JOIN trusted ON domain = imitated WHERE imitated <> registered_domain",
    "brand_subdomain": "SELECT hostname, brand, rd FROM brand_rows WHERE rule = 1",
    "brand_sld": "SELECT hostname, brand, rd, lure FROM brand_rows WHERE rule = 2",
    "brand": "SELECT url_id, name, severity, evidence FROM sig WHERE ord = 21",
    "entropy": "SELECT hostname, coalesce(max(h), 0) AS h FROM (SELECT d.hostname, e.h FROM dom d LEFT JOIN ent e ON e.s = split_part(d.registered_domain, '.', 1)) GROUP BY hostname",
    "entropy_host": _SIG + "5",
    "entropy_path": _SIG + "6",
    **{
        f"sig_{k}": _SIG + str(o)
        for k, o in (
            ("raw_ip", 7), ("tld", 8), ("subdomains", 9), ("hyphens", 10), ("long_url", 11), ("long_host", 12), ("at", 13),
            ("nested", 14), ("percent", 15), ("params", 16), ("port", 17), ("credential", 18), ("financial", 19), ("urgency", 20),
        )
    },
    "signals_long": "SELECT url_id, CAST(ord AS INT) AS signal_ord, name, severity, evidence, weight FROM sig",
    "suppressed": "SELECT url_id, CAST(ord AS INT) AS signal_ord, name FROM kept",
    "risk_score": "SELECT url_id, risk_score FROM scored",
    "risk_level": "SELECT url_id, risk_level FROM classed",
    "classification": "SELECT url_id, classification FROM classed",
    "confidence": "SELECT url_id, confidence FROM classed",
    "recommendation": "SELECT url_id, recommendation FROM classed JOIN advice USING (classification)",
    "malformed_verdict": f"SELECT {VERDICT} FROM verdicts WHERE starts_with(signals, 'Malformed URL|')",
    "verify_urls": f"SELECT {VERDICT} FROM verdicts",
    "verify_stream": f"SELECT {VERDICT} FROM verdicts",
    "verify_stream_live": f"SELECT {VERDICT} FROM verdicts_live",
    "verdict_table": """SELECT CASE WHEN url_id % 2 = 0 THEN 'even' ELSE 'odd' END AS run, risk_level, registered_domain, count(*) AS n_urls, max(risk_score) AS max_score
        FROM verdicts LEFT JOIN (SELECT url_id, registered_domain FROM full_rows) USING (url_id) WHERE risk_level IN ('HIGH', 'CRITICAL') GROUP BY ALL""",
    "own_detectors": f"SELECT {VERDICT} FROM verdicts_own",
    "message_risk": """SELECT msg_id, count(*) AS n_urls, CAST(sum(n_signals) AS BIGINT) AS n_signals, max(risk_score) AS worst_score, arg_max(risk_level, risk_score * 1000000 - url_id) AS worst_level,
        arg_max(url_id, risk_score * 1000000 - url_id) AS worst_url_id FROM verdicts JOIN (SELECT DISTINCT m.msg_id, p.url_id FROM msg_urls m JOIN url_corpus p ON trim(p.url) = m.url) USING (url_id) GROUP BY msg_id""",
    "campaign_rollup": """SELECT registered_domain, risk_level, count(*) AS n_urls, count(*) FILTER (WHERE known_ioc) AS n_iocs, round(avg(risk_score), 4) AS mean_score, max(risk_score) AS max_score
        FROM verdicts JOIN (SELECT url_id, registered_domain FROM full_rows) USING (url_id) GROUP BY ROLLUP (registered_domain, risk_level)""",
}


def oracle_sql() -> dict[str, str]:
    return {k: oracle(v) for k, v in SELECTS.items()}
