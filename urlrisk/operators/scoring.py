"""From the signals of a URL to its verdict, within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk import config as C
from urlrisk.schemas import SIGNAL

#: Signals that say nothing on a trusted domain.
LURES = ("Credential-related path", "Financial/payment intent", "Urgency-inducing keyword")


def suppress_trusted(signals: str, trusted: str) -> Column:
    """The signals without lures of the path, on trusted domains."""
    return F.when(F.col(trusted), F.filter(signals, lambda s: ~s["name"].isin(*LURES))).otherwise(F.col(signals))


def risk_score(signals: str, ioc: str) -> Column:
    """Sum of the weights, 40 for an indicator and 15 more if its source has ``community``
    in its name; at least 80 with an indicator, at most 100."""
    found = f"{ioc} IS NOT NULL"
    total = f"aggregate({signals}, 0, (a, s) -> a + s.weight) + if({found}, 40 + if(contains(lower(coalesce({ioc}.source, '')), 'community'), 15, 0), 0)"
    return F.expr(f"cast(greatest(0, least(100, greatest({total}, if({found}, 80, 0)))) as int)")


def risk_level(score: str) -> Column:
    s = F.col(score)
    return F.when(s >= 75, "CRITICAL").when(s >= 50, "HIGH").when(s >= 25, "CAUTION").otherwise("LOW")


def severity_counts(signals: str) -> dict[str, Column]:
    """``n_high`` (critical ones too), ``n_medium`` and ``n_low``."""
    kinds = {"n_high": "'high', 'critical'", "n_medium": "'medium'", "n_low": "'low'"}
    return {k: F.expr(f"size(filter({signals}, s -> s.severity IN ({v})))") for k, v in kinds.items()}


def classify(ioc: str = "ioc", score: str = "risk_score") -> Column:
    return F.expr(
        f"CASE WHEN {ioc} IS NOT NULL THEN 'Known Malicious' "
        f"WHEN {score} >= 70 OR n_high >= 2 OR (n_high >= 1 AND n_medium >= 2) OR {score} >= 50 OR (n_high >= 1 AND n_medium >= 1) THEN 'Potential Phishing' "
        f"WHEN {score} >= 25 OR n_medium >= 2 OR n_high >= 1 THEN 'Suspicious' "
        f"WHEN {score} > 0 OR n_medium = 1 OR n_low > 0 THEN 'Low Risk' ELSE 'Safe' END"
    )


def confidence(ioc: str = "ioc", trusted: str = "is_trusted", signals: str = "signals") -> Column:
    return F.expr(
        f"cast(CASE WHEN {ioc} IS NOT NULL THEN 0.98 WHEN {trusted} AND size({signals}) = 0 THEN 0.95 WHEN n_high >= 2 THEN 0.92 "
        f"WHEN n_high = 1 AND n_medium >= 1 THEN 0.88 WHEN n_high = 1 THEN 0.80 WHEN n_medium >= 2 THEN 0.78 WHEN n_medium = 1 THEN 0.60 "
        f"WHEN size({signals}) > 0 THEN 0.55 ELSE 0.85 END as double)"
    )


def recommend(classification: str = "classification") -> Column:
    out = None
    for name, text in C.RECOMMENDATIONS.items():
        out = F.when(F.col(classification) == name, text) if out is None else out.when(F.col(classification) == name, text)
    return out


def judge(rows: DataFrame, *also: str) -> DataFrame:
    """``rows(url_id, signals, ioc, is_trusted)`` to verdicts, with the columns ``also``; the
    signals are ordered and those that a trusted domain suppresses are gone."""
    v = rows.withColumns(severity_counts("signals")).withColumn("risk_score", risk_score("signals", "ioc"))
    v = v.withColumn("classification", classify())
    return v.select(
        "url_id",
        "risk_score",
        risk_level("risk_score").alias("risk_level"),
        "classification",
        confidence().alias("confidence"),
        F.col("ioc").isNotNull().alias("known_ioc"),
        F.expr("transform(signals, s -> struct(s.name, s.severity, s.evidence))").cast(f"array<{SIGNAL}>").alias("signals"),
        recommend().alias("recommendation"),
        *also,
    )


def malformed_verdicts(bad: DataFrame) -> DataFrame:
    """The fixed verdict of URLs that are not valid, with the error as its one signal."""
    return bad.select(
        "url_id",
        F.lit(5).alias("risk_score"),
        F.lit("LOW").alias("risk_level"),
        F.lit("Low Risk").alias("classification"),
        F.lit(0.5).cast("double").alias("confidence"),
        F.lit(False).alias("known_ioc"),
        F.array(F.struct(F.lit("Malformed URL").alias("name"), F.lit("low").alias("severity"), F.col("error").alias("evidence"))).cast(f"array<{SIGNAL}>").alias("signals"),
        F.lit(C.MALFORMED_RECOMMENDATION).alias("recommendation"),
    )
