"""Schemas of tables and of the verdict."""

IOC = "id long, indicator string, indicator_type string, source string, severity string, description string, created_at timestamp"
IOC_UPDATE = "seq long, indicator string, indicator_type string, source string, severity string, description string"
SIGNAL = "struct<name:string,severity:string,evidence:string>"
#: A signal on its way to the verdict: its place among the signals and its weight.
RANKED_SIGNAL = "struct<ord:int,name:string,severity:string,evidence:string,weight:int>"
VERDICT = (
    "url_id long, risk_score int, risk_level string, classification string, confidence double, known_ioc boolean, "
    f"signals array<{SIGNAL}>, recommendation string"
)
