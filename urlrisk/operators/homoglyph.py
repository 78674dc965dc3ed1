"""Punycode, mixed scripts and look-alike characters, once for each distinct host."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from urlrisk.config import HOMOGLYPH_FROM
from urlrisk.functions.text import fold_homoglyphs, literal_array

#: Letters of a script, by code points.
_LATIN = r"[A-Za-zÀ-ÖØ-öø-ʸᴀ-ᴥᴬ-ᵜᵢ-ᵥᵫ-ᵷᵹ-ᶾḀ-ỿⱠ-ⱿꜢ-ꞇꞋ-ꟊＡ-Ｚａ-ｚªº]"
_OTHER = r"[Ͱ-ͳͶͷͻ-ͽͿΆΈ-ϿЀ-ҁҊ-ԯᲀ-ᲈᴦ-ᴫἀ-῿ⷠ-ⷿꙀ-ꚟ]"


def is_mixed(unicode_domain: str) -> Column:
    """Some label has letters both Latin and Cyrillic or Greek."""
    return F.exists(F.split(unicode_domain, r"\."), lambda x: x.rlike(_LATIN) & x.rlike(_OTHER))


def look_alikes(unicode_domain: str) -> Column:
    """The first three distinct look-alike characters of a host, each with its name."""
    known = literal_array(list(HOMOGLYPH_FROM))
    names = F.create_map(*(F.lit(x) for c in HOMOGLYPH_FROM for x in (c, f"'{c}' ({unicodedata.name(c)})")))
    found = F.array_distinct(F.filter(F.split(unicode_domain, ""), lambda c: F.array_contains(known, c)))
    return F.transform(F.slice(found, 1, 3), lambda c: F.element_at(names, c))


def imitated(unicode_domain: str, registered_domain: str) -> Column:
    """The registered domain with look-alikes folded, or null if the host has none."""
    folded = fold_homoglyphs(F.col(registered_domain))
    return F.when((fold_homoglyphs(F.col(unicode_domain)) != F.col(unicode_domain)) & (folded != F.col(registered_domain)), folded)
