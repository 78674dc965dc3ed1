"""Signals from the entropy of the characters of hosts and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urlrisk.config import RiskConfig
from urlrisk.functions.text import entropy
from urlrisk.operators.signals import signal


def host_entropy_signal(cfg: RiskConfig) -> Column:
    """Needs ``registered_domain`` and ``subdomain``. The subdomain counts only where the
    first label of the registered domain is not a signal itself."""
    label = "split_part(registered_domain, '.', 1)"
    h, s = entropy(label), entropy("subdomain")
    text = lambda what, x: F.concat(F.lit(f"{what} has unusually high character entropy (H="), F.format_number(x, 2), F.lit(f", threshold={cfg.entropy_threshold:.2f})"))
    own = (F.length(F.expr(label)) >= cfg.entropy_min_length) & (h >= cfg.entropy_threshold)
    sub = (F.length("subdomain") >= cfg.entropy_min_length) & (s >= cfg.entropy_threshold)
    return F.when(own, signal("entropy_host", "High entropy hostname", "low", text("Hostname", h))).when(
        sub, signal("entropy_host", "High entropy subdomain", "low", text("Subdomain", s))
    )


def path_entropy_signal(cfg: RiskConfig) -> Column:
    """Needs ``path``."""
    h = entropy("path")
    evidence = F.concat(F.lit("URL path exhibits unusually high character entropy (H="), F.format_number(h, 2), F.lit(")"))
    return F.when(
        (F.length("path") > cfg.path_entropy_length) & (h >= cfg.path_entropy_threshold), signal("entropy_path", "High entropy path component", "low", evidence)
    )
