"""Detectors of one's own: functions from a table to a long table of signals."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.operators.signals import ORDER, weight
from urlrisk.schemas import RANKED_SIGNAL

#: The key of each grain.
GRAINS = {"url": "url_id", "host": "hostname", "domain": "registered_domain"}


@dataclass(frozen=True)
class Detector:
    """``find`` is given the table of the grain and returns signals: the key of the grain,
    ``name, severity, evidence`` and, if it likes, ``weight``, whose nulls are filled by
    the rules for names. Any number of rows for a key, and keys in any number of rows.

    ``url``: the valid rows of ``normalize_urls``, key ``url_id``. ``host``: the distinct hosts
    of ``host_table``, key ``hostname``. ``domain``: the distinct ``registered_domain`` of hosts
    that are not addresses, in lower case.

    Signals stand after all others, in the order of the detectors, or in the place of the
    detector named by ``instead_of``, which then gives none.
    """

    grain: str
    find: Callable[[DataFrame], DataFrame]
    instead_of: str | None = None

    def __post_init__(self):
        if self.grain not in GRAINS:
            raise ValueError(f"grain is one of {', '.join(GRAINS)}")
        if self.instead_of is not None:
            check_places([self.instead_of])


def check_places(places: Collection[str]) -> frozenset[str]:
    """``places``, if all are detectors that can be left out: all in ``ORDER`` but the
    indicators, for which one gives another feed."""
    wrong = set(places) - set(ORDER[1:])
    if wrong:
        raise ValueError(f"no such detector: {', '.join(sorted(wrong))}")
    return frozenset(places)


def left_out(without: Collection[str], detectors: Sequence[Detector]) -> frozenset[str]:
    """The places of the detectors that give no signals."""
    return check_places(without) | {d.instead_of for d in detectors if d.instead_of is not None}


def own_signals(table: DataFrame, detectors: Sequence[Detector], grain: str) -> DataFrame | None:
    """``key, own``: the signals of all detectors of a grain as one array of ``RANKED_SIGNAL``
    for each key that has any, by one grouping; None if there is no such detector."""
    key = GRAINS[grain]
    found = None
    for k, d in enumerate(detectors):
        if d.grain != grain:
            continue
        rows = d.find(table)
        points = weight(F.col("name"), F.col("severity"))
        points = F.coalesce(F.col("weight").cast("int"), points) if "weight" in rows.columns else points
        place = ORDER.index(d.instead_of) if d.instead_of is not None else len(ORDER) + k
        rows = rows.where(F.col(key).isNotNull()).select(
            F.col(key).alias(f"own_{grain}_key"),
            F.struct(F.lit(place).alias("ord"), F.col("name").cast("string").alias("name"), F.col("severity").cast("string").alias("severity"), F.col("evidence").cast("string").alias("evidence"), points.alias("weight")).cast(RANKED_SIGNAL).alias("s"),
        )
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return None
    return found.groupBy(f"own_{grain}_key").agg(F.collect_list("s").alias(f"own_{grain}"))


def with_own(rows: DataFrame, own: DataFrame | None, grain: str, key: str | None = None) -> DataFrame:
    """``rows`` with the array ``own_<grain>``, empty where there is none, by one join on the key."""
    name = f"own_{grain}"
    if own is None:
        return rows.withColumn(name, F.expr(f"cast(array() as array<{RANKED_SIGNAL}>)"))
    joined = rows.join(own, F.expr(key or GRAINS[grain]) == F.col(f"{name}_key"), "left").drop(f"{name}_key")
    return joined.withColumn(name, F.coalesce(name, F.expr(f"cast(array() as array<{RANKED_SIGNAL}>)")))
