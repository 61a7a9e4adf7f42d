"""Pattern scans over lines, with severities and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code, category, severity, pattern (RE2 and Java alike).
RULES: list[tuple[str, str, str, str]] = [
    ("SEC001", "HardcodedSecret", "High", r"(?i)(api_?key|apikey)\s*[:=]\s*[\"'][^\"']{8,}[\"']"),
    ("SEC002", "HardcodedSecret", "Critical", r"(?i)(password|passwd|pwd)\s*[:=]\s*[\"'][^\"']+[\"']"),
    ("SEC003", "HardcodedSecret", "High", r"(?i)(secret|token)\s*[:=]\s*[\"'][^\"']{8,}[\"']"),
    ("SEC030", "InsecureNetwork", "Medium", r"(?i)http://"),
]
LOCAL = r"(?i)http://(localhost|127\.0\.0\.1)"
SEVERITIES = ["Critical", "High", "Medium", "Low"]


def finding(text: Column, code: str) -> Column:
    """Whether a rule finds something; plain http on this machine is none."""
    pattern = next(p for c, _, _, p in RULES if c == code)
    found = text.rlike(pattern)
    return found & ~text.rlike(LOCAL) if code == "SEC030" else found


def scan_lines(lines: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, code, severity): every rule over every line in one pass."""
    hits = F.array_compact(F.array(*[F.when(finding(F.col(text), c), F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"))) for c, _, s, _ in RULES]))
    return lines.select(key, "line", F.explode(hits).alias("h")).select(key, "line", "h.code", "h.severity")


def severity_counts(issues: DataFrame, group: str) -> DataFrame:
    """One row per group with a count per severity."""
    return issues.groupBy(group).agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])
