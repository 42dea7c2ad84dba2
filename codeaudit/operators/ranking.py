"""Report rankings.  Every per-project list is limited in each task before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit.functions.findings import severity_index
from codeaudit.operators.ordered import first_n

ORDER = ["file", "line", "seq"]


def _severe():
    return F.col("severity").isin("HIGH", "BLOCKER")


def files_by_risk(findings: DataFrame, keys: list[str] = ("project_id",)) -> DataFrame:
    """Files by their number of HIGH and BLOCKER findings."""
    return findings.groupBy(*keys, "file").agg(
        F.count_if(_severe()).alias("severe"), F.count("*").alias("findings")
    ).orderBy(*keys, F.col("severe").desc(), "file")


def findings_in_file_order(findings: DataFrame, keys: list[str] = ("project_id",)) -> DataFrame:
    """Findings by file, severity, then line."""
    return findings.orderBy(
        *keys, "file", severity_index(F.col("severity")), F.coalesce("line", F.lit(0)), "seq")


def top_risks(findings: DataFrame, n: int = 5, keys: list[str] = ("project_id",), confidence: str = "confidence_score") -> DataFrame:
    """Five severe findings: those with an analysis by confidence, or the first ones
    of a project that has none."""
    keys = list(keys)
    severe = findings.filter(_severe())
    analysed = first_n(severe.filter(F.col(confidence).isNotNull()), n, keys,
                       [F.col(confidence).desc(), *ORDER], rank="position")
    rest = severe.join(analysed.select(*keys).distinct(), keys, "left_anti")
    return analysed.unionByName(first_n(rest, n, keys, ORDER, rank="position"))


def likely_false_positives(findings: DataFrame, n: int = 10, keys: list[str] = ("project_id",), probability: str = "false_positive") -> DataFrame:
    picked = findings.filter(F.coalesce(probability, F.lit(0.0)) > 0.3)
    return first_n(picked, n, list(keys), [F.col(probability).desc(), *ORDER], rank="position")


def remediation_plan(findings: DataFrame, n: int = 20, keys: list[str] = ("project_id",)) -> DataFrame:
    """Twenty items: BLOCKER, HIGH, MEDIUM; one per (rule, file) within a severity."""
    keys = list(keys)
    picked = findings.filter(F.col("severity").isin("BLOCKER", "HIGH", "MEDIUM"))
    group = [*keys, "severity", F.coalesce("rule", F.lit("")).alias("_rule"), "file"]
    names = [c for c in findings.columns if c not in (*keys, "severity", "file")]
    firsts = picked.groupBy(*group).agg(F.min_by(
        F.struct(*names), F.struct(F.coalesce("line", F.lit(0)), "seq")).alias("_f")
    ).select(*keys, "severity", "file", "_f.*")
    return first_n(firsts, n, keys, [severity_index(F.col("severity")), *ORDER], rank="position")


def first_findings(findings: DataFrame, n: int = 10, keys: list[str] = ("project_id",)) -> DataFrame:
    """The first findings for display, each with the number of those left out."""
    keys = list(keys)
    totals = findings.groupBy(*keys).agg(F.count("*").alias("_n"))
    shown = first_n(findings, n, keys, ORDER, rank="position")
    return shown.join(totals, keys).withColumn("more", F.greatest(F.col("_n") - n, F.lit(0))).drop("_n")
