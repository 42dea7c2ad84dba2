"""Linter reports, from files or from a table of raw texts, to one row per result.

Each `parse_*` takes a DataFrame (project_id, report) with the raw report text;
each `read_*` reads such texts from a folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit import schemas as S

# Fixed value: one compiler diagnostic per line.
TSC_LINE = r"^(.+)\((\d+),(\d+)\):\s+(error|warning|message)\s+(TS\d+):\s+(.+)$"


def read_raw_reports(
    spark: SparkSession, path: str, project: Column | None = None, whole: bool = True
) -> DataFrame:
    """Report texts of a folder; the project defaults to the parent folder's name."""
    text = spark.read.text(path, wholetext=whole, recursiveFileLookup=True)
    owner = project if project is not None else F.regexp_extract(
        F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return text.select(owner.alias("project_id"), F.col("value").alias("report"))


def parse_eslint(raw: DataFrame) -> DataFrame:
    files = raw.select("project_id", F.posexplode(F.from_json("report", S.ESLINT_REPORT)).alias("_f", "_file"))
    return files.select(
        "project_id", "_f", F.col("_file.filePath").alias("filePath"),
        F.posexplode("_file.messages").alias("_m", "_msg"),
    ).select("project_id", (F.col("_f") * 1_000_000 + F.col("_m")).alias("pos"), "filePath", "_msg.*")


def parse_tsc(raw: DataFrame) -> DataFrame:
    """One row per diagnostic line; other lines are dropped."""
    lines = raw.select("project_id", F.posexplode(F.split("report", "\n")).alias("pos", "_l"))

    def part(n: int) -> Column:
        return F.regexp_extract("_l", TSC_LINE, n)

    return lines.filter(F.col("_l").rlike(TSC_LINE) & ~F.col("_l").startswith("Found")).select(
        "project_id", "pos", part(1).alias("file"), part(2).cast("int").alias("line"),
        part(3).cast("int").alias("column"), part(4).alias("category"), part(5).alias("code"),
        part(6).alias("message"))


def parse_ruff(raw: DataFrame) -> DataFrame:
    rows = raw.select("project_id", F.posexplode(F.from_json("report", S.RUFF_REPORT)).alias("pos", "_r"))
    return rows.select(
        "project_id", "pos", F.coalesce("_r.filename", "_r.file").alias("filename"), F.col("_r.code").alias("code"),
        F.coalesce("_r.message", "_r.text").alias("message"),
        F.coalesce("_r.location.row", "_r.line").alias("row"),
        F.coalesce("_r.location.column", "_r.column").alias("column"), F.col("_r.fix").alias("fix"))


def parse_bandit(raw: DataFrame) -> DataFrame:
    parsed = raw.select("project_id", F.from_json("report", S.BANDIT_REPORT).alias("_d"))
    return parsed.select("project_id", F.posexplode("_d.results").alias("pos", "_r")).select(
        "project_id", "pos", "_r.filename", "_r.test_id",
        F.coalesce("_r.issue_severity", F.lit("MEDIUM")).alias("issue_severity"),
        F.coalesce("_r.issue_confidence", F.lit("MEDIUM")).alias("issue_confidence"),
        "_r.issue_text", "_r.line_number")


def parse_semgrep(raw: DataFrame) -> DataFrame:
    parsed = raw.select("project_id", F.from_json("report", S.SEMGREP_REPORT).alias("_d"))
    return parsed.select("project_id", F.posexplode("_d.results").alias("pos", "_r")).select(
        "project_id", "pos", "_r.path", "_r.check_id",
        F.coalesce("_r.extra.severity", "_r.severity").alias("severity"),
        F.coalesce("_r.extra.message", "_r.message").alias("message"),
        F.col("_r.start.line").alias("line"), F.col("_r.start.col").alias("col"))


PARSERS = {
    "eslint": parse_eslint, "typescript": parse_tsc, "ruff": parse_ruff,
    "bandit": parse_bandit, "semgrep": parse_semgrep,
}


def read_eslint_report(spark: SparkSession, path: str, project: Column | None = None) -> DataFrame:
    return parse_eslint(read_raw_reports(spark, path, project))


def read_tsc_output(spark: SparkSession, path: str, project: Column | None = None) -> DataFrame:
    return parse_tsc(read_raw_reports(spark, path, project))


def read_ruff_report(spark: SparkSession, path: str, project: Column | None = None) -> DataFrame:
    return parse_ruff(read_raw_reports(spark, path, project))


def read_bandit_report(spark: SparkSession, path: str, project: Column | None = None) -> DataFrame:
    return parse_bandit(read_raw_reports(spark, path, project))


def read_semgrep_report(spark: SparkSession, path: str, project: Column | None = None) -> DataFrame:
    return parse_semgrep(read_raw_reports(spark, path, project))
