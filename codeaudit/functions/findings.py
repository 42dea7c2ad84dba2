"""Construction and validation of the central Finding record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit import schemas as S
from codeaudit.functions.text import literal_map


def short_hash(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 over the parts joined by ':'."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def map_category(category: Column) -> Column:
    return F.coalesce(literal_map(S.CATEGORY_MAP)[category], category)


def to_legacy(category: Column) -> Column:
    return F.coalesce(literal_map(S.REVERSE_CATEGORY_MAP)[category], category)


def severity_index(severity: Column) -> Column:
    """0 for BLOCKER … 4 for INFO; -1 for anything else, as an index lookup gives."""
    return F.array_position(F.array(*[F.lit(s) for s in S.SEVERITIES]), severity).cast("int") - 1


def finding_id(tool: Column, file: Column, line: Column, rule: Column) -> Column:
    text = F.coalesce(line.cast("string"), F.lit("null"))
    rule_text = F.when(rule.isNull() | (rule == ""), F.lit("none")).otherwise(rule)
    return short_hash(tool, file, text, rule_text)


def finding_fingerprint(file: Column, line: Column, category: Column) -> Column:
    return short_hash(file, F.coalesce(line.cast("string"), F.lit("null")), category)


def build_findings(df: DataFrame) -> DataFrame:
    """Complete raw rows (project_id, seq, tool, category, severity, file, line, column,
    rule, message, suggestedFix[, confidence]) to the Finding schema."""
    confidence = F.col("confidence") if "confidence" in df.columns else F.lit("medium")
    rule = F.when(F.col("rule") == "", F.lit(None)).otherwise(F.col("rule"))
    category = map_category(F.col("category"))
    return df.select(
        "project_id",
        F.col("seq").cast("long").alias("seq"),
        finding_id(F.col("tool"), F.col("file"), F.col("line"), F.col("rule")).alias("id"),
        "tool",
        category.alias("category"),
        to_legacy(category).alias("legacyCategory"),
        "severity",
        "file",
        F.col("line").cast("int").alias("line"),
        F.col("column").cast("int").alias("column"),
        rule.alias("rule"),
        rule.alias("ruleId"),
        "message",
        F.col("suggestedFix").cast("string").alias("suggestedFix"),
        confidence.alias("confidence"),
        finding_fingerprint(F.col("file"), F.col("line"), category).alias("fingerprint"),
        F.struct(
            F.col("tool").alias("tool"),
            rule.alias("ruleId"),
            F.lit(None).cast("string").alias("analyzerVersion"),
        ).alias("source"),
    )


def distinct_findings(df: DataFrame) -> DataFrame:
    """`build_findings(df).distinct()`, where rows are told apart by what findings are made of.

    Ids, fingerprints and the legacy names follow from the other columns; they are
    made after the shuffle, which then moves about half the bytes.
    """
    plain = {
        "seq": F.col("seq").cast("long"), "category": map_category(F.col("category")),
        "column": F.col("column").cast("int"), "suggestedFix": F.col("suggestedFix").cast("string"),
        "rule": F.when(F.col("rule") == "", F.lit(None)).otherwise(F.col("rule"))}
    made_of = ["project_id", "seq", "tool", "category", "severity", "file", "line", "column", "rule", "message", "suggestedFix"]
    made_of += [c for c in ("confidence",) if c in df.columns]
    return build_findings(df.withColumns(plain).select(*made_of).distinct())


def finding_error(df: DataFrame) -> Column:
    """Reason a row cannot become a finding, or null."""
    has = df.columns

    def col(name: str) -> Column:
        return F.col(name) if name in has else F.lit(None).cast("string")

    return (
        F.when(~F.coalesce(col("tool").isin(S.TOOLS), F.lit(False)), "invalid tool")
        .when(~F.coalesce(col("category").isin(S.CATEGORIES), F.lit(False)), "invalid category")
        .when(~F.coalesce(col("severity").isin(S.SEVERITIES), F.lit(False)), "invalid severity")
        .when(F.coalesce(col("file"), F.lit("")) == "", "missing file")
        .when(F.coalesce(col("message"), F.lit("")) == "", "missing message")
        .when(
            ~F.coalesce(col("confidence"), F.lit("medium")).isin(S.CONFIDENCES),
            "invalid confidence",
        )
    )


def validate_findings(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split rows into valid ones and rejects (which carry `reject_reason`)."""
    marked = df.withColumn("reject_reason", finding_error(df))
    valid = marked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return valid, marked.filter(F.col("reject_reason").isNotNull())
