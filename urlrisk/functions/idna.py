"""Host names in their two forms by the IDNA rules of 2008 (RFC 5890 to 5893).

Where the public ``idna`` library is installed it does the work; elsewhere the same rules
are taken from the character data that Python has itself. What Python lacks is the joining
type of letters: a zero width non-joiner is then accepted after a virama only.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

try:
    import idna as _library
except ImportError:  # the rules below serve instead
    _library = None

# --- fixed values: exceptions and ignorable characters that RFC 5892 lists one by one ---

_VALID = {0xDF, 0x3C2, 0x6FD, 0x6FE, 0xF0B, 0x3007}
_BY_CONTEXT = {0xB7, 0x375, 0x5F3, 0x5F4, 0x30FB, 0x200C, 0x200D, *range(0x660, 0x66A), *range(0x6F0, 0x6FA)}
_INVALID = {0x640, 0x7FA, 0x302E, 0x302F, *range(0x3031, 0x3036), 0x303B}
_IGNORABLE = {0x34F, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
_BLOCKS = (range(0x1100, 0x1200), range(0xA960, 0xA97D), range(0xD7B0, 0xD7FC), range(0x20D0, 0x2100), range(0x1D100, 0x1D200), range(0x1D200, 0x1D250))
_LETTERS = {"Ll", "Lu", "Lo", "Nd", "Lm", "Mn", "Mc"}
_DOTS = re.compile("[.。．｡]")
_RIGHT, _IN_RIGHT, _IN_LEFT = {"R", "AL", "AN"}, {"R", "AL", "AN", "EN", "ES", "CS", "ET", "ON", "BN", "NSM"}, {"L", "EN", "ES", "CS", "ET", "ON", "BN", "NSM"}
_VIRAMA = 9


class HostError(ValueError):
    """A host that has no other form by the rules."""


@lru_cache(1 << 16)
def _is_valid(c: str) -> bool:
    """Whether a character may stand in a label wherever it is."""
    cp = ord(c)
    if cp in _VALID or c == "-" or "a" <= c <= "z" or "0" <= c <= "9":
        return True
    if cp in _INVALID or cp in _IGNORABLE or cp in _BY_CONTEXT or any(cp in block for block in _BLOCKS):
        return False
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).casefold())
    return folded == c and unicodedata.category(c) in _LETTERS


def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0]


def _fits(label: str, k: int) -> bool:
    """Whether the character at ``k``, which is valid in some context only, is in one."""
    c, before, after = label[k], label[k - 1 : k] if k else "", label[k + 1 : k + 2]
    if c in "‌‍":
        return bool(before) and unicodedata.combining(before) == _VIRAMA
    if c == "·":
        return before == after == "l"
    if c == "͵":
        return bool(after) and _script(after) == "GREEK"
    if c in "׳״":
        return bool(before) and _script(before) == "HEBREW"
    if c == "・":
        return any(x != c and _script(x) in ("HIRAGANA", "KATAKANA", "CJK", "IDEOGRAPHIC") for x in label)
    other = range(0x6F0, 0x6FA) if ord(c) < 0x6F0 else range(0x660, 0x66A)
    return not any(ord(x) in other for x in label)


def _is_ordered(label: str) -> bool:
    """The rule for labels with letters or digits that are written from right to left."""
    kinds = [unicodedata.bidirectional(c) for c in label]
    if not _RIGHT & set(kinds):
        return True
    if kinds[0] not in ("L", "R", "AL"):
        return False
    last = next((k for k in reversed(kinds) if k != "NSM"), "")
    if kinds[0] == "L":
        return set(kinds) <= _IN_LEFT and last in ("L", "EN")
    return set(kinds) <= _IN_RIGHT and last in ("R", "AL", "EN", "AN") and not {"EN", "AN"} <= set(kinds)


def check_label(label: str) -> None:
    """Raise ``HostError`` unless a label in its readable form is valid."""
    if not label or label[2:4] == "--" or label[0] == "-" or label[-1] == "-":
        raise HostError(f"hyphens or nothing in {label!r}")
    if unicodedata.normalize("NFC", label) != label or unicodedata.category(label[0])[0] == "M":
        raise HostError(f"not composed: {label!r}")
    for k, c in enumerate(label):
        if not _is_valid(c) and not (ord(c) in _BY_CONTEXT and _fits(label, k)):
            raise HostError(f"{c!r} in {label!r}")
    if not _is_ordered(label):
        raise HostError(f"directions in {label!r}")


def _encoded(label: str) -> str:
    if label.isascii():
        _decoded(label)
        return label
    check_label(label)
    return "xn--" + label.encode("punycode").decode("ascii")


def _decoded(label: str) -> str:
    if label.isascii():
        label = label.lower()
        if label.startswith("xn--"):
            code = label[4:]
            if not code or code.endswith("-"):
                raise HostError(f"no code in {label!r}")
            try:
                plain = code.encode("ascii").decode("punycode")
            except (UnicodeError, ValueError, OverflowError) as e:
                raise HostError(f"no code in {label!r}") from e
            check_label(plain)
            if plain.isascii() or plain.encode("punycode").decode("ascii") != code:
                raise HostError(f"another code for {label!r}")
            return plain
    check_label(label)
    return label


def _each(host: str, form) -> list[str]:
    labels = _DOTS.split(host)
    dot = len(labels) > 1 and not labels[-1]
    out = [form(x) for x in (labels[:-1] if dot else labels)]
    return [*out, ""] if dot else out


def encode_by_rules(host: str) -> str:
    """The ASCII form of a host; ``HostError`` if it has none."""
    labels = _each(host, _encoded)
    out = ".".join(labels)
    if any(len(x) > 63 for x in labels) or len(out) > (254 if out.endswith(".") else 253):
        raise HostError("too long")
    return out


def decode_by_rules(host: str) -> str:
    """The readable form of a host; ``HostError`` if it has none."""
    return ".".join(_each(host, _decoded))


def to_ascii(host: str) -> str | None:
    """The ASCII form of a host, or None."""
    try:
        return encode_by_rules(host) if _library is None else _library.encode(host).decode("ascii")
    except (UnicodeError, ValueError):
        return None


def to_unicode(host: str) -> str | None:
    """The readable form of a host, or None."""
    try:
        return decode_by_rules(host) if _library is None else _library.decode(host)
    except (UnicodeError, ValueError):
        return None
