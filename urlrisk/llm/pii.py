"""Personal data found from anchors.

An Aho-Corasick automaton finds at-signs, schemes, digit anchors and identifier cues in
one pass; deterministic parsers then expand each anchor to the span it stands in and
check it. No parser searches the text: each reads from its anchor outwards, and what one
anchor makes it read, others do not read again more than a few times, so the time is
linear in the text whatever is in it.

Base kinds are ``email``, ``ip``, ``card`` and ``phone``, with the spans that leftmost,
non-overlapping matches of their patterns give (failing matches are dropped and not
retried). The anchors add ``url`` (a scheme, ``://`` and what follows, without closing
marks), ``account`` (a cue such as ``iban`` or ``account no`` and the identifier after it;
an IBAN must pass its check digits, years and dates are none) and ``secret`` (a cue such as
``password`` or ``token``, a ``=`` or ``:`` and the value after it, if that is no plain word, or
an access key by its first letters).
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_DIGIT = frozenset("0123456789")
_PHONE = frozenset("0123456789 ().-")
_PLAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
#: By ISO 13616 an IBAN has at most 34 characters (and no country's under 15).
IBAN_MOST = 34
_IBAN_FORM = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}").fullmatch
#: Years, pairs of years and dates.
_DATED = re.compile(r"(?:19|20)[0-9]{2}(?:-(?:[0-9]{2}|(?:19|20)[0-9]{2}|[0-9]{1,2}-[0-9]{1,2}))?|[0-9]{1,2}-[0-9]{1,2}-(?:19|20)[0-9]{2}").fullmatch
_INNER_UPPER = re.compile(r"[a-z][A-Z]").search
_LETTER = _PLAIN - _DIGIT
_VALUE = _PLAIN | frozenset("_-./+=~!@#$%^&*")
_SCHEME = _PLAIN | frozenset("+.-")
_URL_END = frozenset(".,;:!?'\")]}>")
#: Cues in lower case, and the kind that an identifier after them is.
ACCOUNT_CUES = ("iban", "account no", "account number", "account", "acct", "ssn", "passport no", "passport", "customer id", "member id", "tax id")
SECRET_CUES = ("password", "passwd", "secret", "api_key", "apikey", "api key", "token")
KEY_STARTS = ("AKIA", "ASIA")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", "@")
    a.add_word("://", ":")
    for d in "0123456789":
        a.add_word(d, "0")
    a.add_word("+", "+")
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                a.add_word(form, (kind, len(form)))
    for start in KEY_STARTS:
        a.add_word(start, ("key", len(start)))
    a.make_automaton()
    return a


_anchors = _automaton()


def _run(t: str, at: int, of: frozenset[str], stop: int | None = None) -> int:
    """The end of the run of characters ``of`` that starts at ``at``, up to ``stop``."""
    n = len(t) if stop is None else min(stop, len(t))
    while at < n and t[at] in of:
        at += 1
    return at


def _email(t: str, at: int, done: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at``, from ``done`` on."""
    start = at
    while start > done and t[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    end = _run(t, at + 1, _HOST)
    if end == at + 1:
        return None
    labels = 0
    while end < len(t) and t[end] == "." and (stop := _run(t, end + 1, _HOST)) > end + 1:
        end, labels = stop, labels + 1
    return (start, end) if labels else None


def _ip(t: str, at: int) -> tuple[int, bool]:
    """The end of four dotted numbers from the digit at ``at``, and whether all are at most
    255; if there are fewer, the end of the first number, from within which none starts."""
    good, first = True, 0
    for part in range(4):
        if part:
            if at >= len(t) or t[at] != ".":
                return first, False
            at += 1
        end = _run(t, at, _DIGIT)
        if end == at:
            return first, False
        first = first or end
        value = t[at:end].lstrip("0")
        good = good and len(value) <= 3 and int(value or "0") <= 255
        at = end
    return at, good


def _card(t: str, at: int) -> tuple[int, bool] | None:
    """The end of digits with single blanks or hyphens between, from the digit at ``at``, and
    whether they are 12 to 19 that pass the Luhn test."""
    digits, end, n = [t[at]], at + 1, len(t)
    while end < n:
        c = t[end]
        if c in _DIGIT:
            digits.append(c)
            end += 1
        elif c in " -" and end + 1 < n and t[end + 1] in _DIGIT:
            digits.append(t[end + 1])
            end += 2
        else:
            break
    if len(digits) < 2:
        return None
    if not 12 <= len(digits) <= 19:
        return end, False
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return end, total % 10 == 0


def _phone(t: str, at: int) -> tuple[int, bool] | None:
    """The end of a number from the plus sign at ``at``, and whether it has 9 to 15 digits."""
    if at + 1 >= len(t) or t[at + 1] not in _DIGIT:
        return None
    end = _run(t, at + 2, _PHONE)
    while end > at + 3 and t[end - 1] not in _DIGIT:
        end -= 1
    if end <= at + 3:
        return None
    return end, 9 <= sum(c in _DIGIT for c in t[at:end]) <= 15


def _url(t: str, at: int, done: int) -> tuple[int, int] | None:
    """The address whose ``://`` ends before ``at``."""
    start = at - 3
    while start > done and t[start - 1] in _SCHEME:
        start -= 1
    while start < at - 3 and t[start] not in _LETTER:
        start += 1
    if start == at - 3:
        return None
    end, n = at, len(t)
    while end < n and not t[end].isspace() and t[end] not in "<>\"'|":
        end += 1
    while end > at and t[end - 1] in _URL_END:
        end -= 1
    return (start, end) if end > at else None


def _iban(value: str) -> bool:
    """Whether a value without blanks and hyphens is an IBAN by its form and check digits."""
    value = value.upper()
    if not _IBAN_FORM(value):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _iban_end(t: str, start: int) -> int:
    """The end of the longest IBAN that starts at ``start``, in one piece or in groups of
    up to four characters with a blank or hyphen between, or ``start``."""
    ends = [_run(t, start, _PLAIN)]
    size = ends[0] - start
    while 0 < size < IBAN_MOST and ends[-1] < len(t) and t[ends[-1]] in " -":
        stop = _run(t, ends[-1] + 1, _PLAIN, ends[-1] + 6)
        group = stop - ends[-1] - 1
        if not 0 < group <= 4:
            break
        ends.append(stop)
        size += group
    for end in reversed(ends):
        if _iban(t[start:end].replace(" ", "").replace("-", "")):
            return end
    return start


def _account(t: str, at: int) -> tuple[int, int] | None:
    """The identifier after a cue that ends before ``at``: blanks, colons, hashes, equals
    signs and the word ``is`` may stand between; six or more characters with four or more digits,
    which are not years or dates (``_DATED``)."""
    start = _run(t, at, frozenset(" :#=."))
    if t[start : start + 3] == "is ":
        start = _run(t, start + 3, frozenset(" :#="))
    if start == at:
        return None
    if (end := _iban_end(t, start)) > start:
        return start, end
    end = _run(t, start, _PLAIN | frozenset("-"))
    while end > start and t[end - 1] == "-":
        end -= 1
    value = t[start:end]
    digits = sum(c in _DIGIT for c in value)
    if value[:2].isalpha() and value[2:4].isdigit() and digits > 10:
        return None  # it looks like an IBAN and is none
    return (start, end) if len(value) >= 6 and digits >= 4 and not _DATED(value) else None


def _secret(t: str, at: int) -> tuple[int, int] | None:
    """The value after a cue that ends before ``at``, an equals sign or colon, and quotes: six
    or more characters that are no plain word (``_is_random``)."""
    k = _run(t, at, frozenset(" "))
    if k >= len(t) or t[k] not in "=:":
        return None
    start = _run(t, k + 1, frozenset(" \"'"))
    end = _run(t, start, _VALUE)
    while end > start and t[end - 1] in ".!":
        end -= 1
    return (start, end) if end - start >= 6 and _is_random(t[start:end]) else None


def _is_random(value: str) -> bool:
    """Whether a value is no word, hyphenated words, name or number of prose: it has digits and
    letters, or a sign that words don't have, or upper case after lower case."""
    letters = sum(c in _LETTER for c in value)
    digits = sum(c in _DIGIT for c in value)
    signs = len(value) - letters - digits - sum(c in "-./" for c in value)
    return digits > 0 and letters > 0 or signs > 0 or digits >= 6 and not _DATED(value) or _INNER_UPPER(value) is not None


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans by start, then in the order of ``KINDS``; code
    points, end exclusive. Null has none."""
    if not text:
        return []
    t, found = text, []
    email = ip = card = phone = url = account = secret = 0  # ends of the last match tried
    for last, what in _anchors.iter(t):
        if what == "0":
            if last >= card and (hit := _card(t, last)):
                card = hit[0]
                if hit[1]:
                    found.append((last, card, "card"))
            if last >= ip:
                ip, good = _ip(t, last)
                if good:
                    found.append((last, ip, "ip"))
        elif what == "+":
            if last >= phone and (hit := _phone(t, last)):
                phone = hit[0]
                if hit[1]:
                    found.append((last, phone, "phone"))
        elif what == "@":
            if last >= email and (span := _email(t, last, email)):
                email = span[1]
                found.append((*span, "email"))
        elif what == ":":
            if last >= url and (span := _url(t, last + 1, url)):
                url = span[1]
                found.append((*span, "url"))
        else:
            kind, size = what
            start = last + 1 - size
            if start > 0 and t[start - 1].isalnum():
                continue
            if kind == "account":
                if last >= account and (span := _account(t, last + 1)):
                    account = span[1]
                    found.append((*span, kind))
            elif kind == "key":
                end = _run(t, start, _UPPER)
                if end - start == 20 and start >= secret:
                    secret = end
                    found.append((start, end, "secret"))
            elif last >= secret and (span := _secret(t, last + 1)):
                secret = span[1]
                found.append((*span, kind))
    found.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return found


def _digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, z, k in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans array<struct<start int, end int, kind string>>`` of each whole text.

    Null and empty texts have no span. Null ids and repeated rows are kept; other columns
    are ignored.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[{"start": a, "end": z, "kind": k} for a, z, k in find_spans(t)] for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, spans array<struct<start:int,end:int,kind:string>>")


def summarize(found: DataFrame) -> DataFrame:
    """``find_pii`` rows to ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``:
    the SHA-256 of the base spans, and all spans, written ``kind:start:end`` and joined by commas."""
    base = ", ".join(f"'{k}'" for k in BASE)
    write = "transform({}, s -> concat_ws(':', s.kind, s.start, s.end))"
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE),
        F.expr("sha2(array_join(" + write.format(f"filter(spans, s -> s.kind IN ({base}))") + ", ','), 256)").alias("base_sha256"),
        F.expr("array_join(" + write.format("spans") + ", ',')").alias("spans"),
    )


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """``text`` with each span as ``[KIND]``; spans that overlap become one, named by the first."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for a, z, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, z)
    return "".join([*out, text[at:]])


def redact_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the same columns, personal data in ``text_col`` replaced by its kind
    and ``length_col``, if there, set to the new number of characters. Null texts stay null."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: redact(t, find_spans(t)), na_action="ignore")

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    if length_col in docs.columns:
        kind = dict(docs.dtypes)[length_col]
        out = out.withColumn(length_col, F.coalesce(F.length(text_col).cast(kind), F.col(length_col)))
    return out.select(*docs.columns)
