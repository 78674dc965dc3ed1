"""How signals are written while they are gathered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urlrisk.config import SCRIPT_WEIGHT_HIGH, SCRIPT_WEIGHT_OTHER, WEIGHTS

#: The order in which detectors give their signals.
ORDER = (
    "ioc", "typosquat", "punycode", "scripts", "homoglyph_brand", "entropy_host", "entropy_path",
    "raw_ip", "tld", "subdomains", "hyphens", "long_url", "long_host", "at", "nested", "percent", "params", "port",
    "credential", "financial", "urgency", "brand",
)


def weight(name: Column, severity: Column) -> Column:
    """The weight of a signal: the first rule whose text is part of its name."""
    out = None
    for part, points in WEIGHTS:
        value = F.when(severity == "high", SCRIPT_WEIGHT_HIGH).otherwise(SCRIPT_WEIGHT_OTHER) if points is None else F.lit(points)
        test = F.contains(name, F.lit(part))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(0).cast("int")


def weight_of(name: str, severity: str) -> int:
    """As ``weight``, for a name and a severity that are known already."""
    points = next((points for part, points in WEIGHTS if part in name), 0)
    return points if points is not None else SCRIPT_WEIGHT_HIGH if severity == "high" else SCRIPT_WEIGHT_OTHER


def signal(place: str, name: Column | str, severity: Column | str, evidence: Column) -> Column:
    """A ranked signal, of the shape of ``RANKED_SIGNAL``."""
    known = isinstance(name, str) and isinstance(severity, str)
    points = F.lit(weight_of(name, severity)).cast("int") if known else None
    name, severity = (F.lit(x) if isinstance(x, str) else x for x in (name, severity))
    points = weight(name, severity) if points is None else points
    return F.struct(
        F.lit(ORDER.index(place)).alias("ord"), name.alias("name"), severity.alias("severity"), evidence.alias("evidence"), points.alias("weight")
    )


def gather(*signals: Column) -> Column:
    """Those signals that are not null, as one array."""
    return F.filter(F.array(*signals), lambda s: s.isNotNull())
