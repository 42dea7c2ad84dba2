"""Record types, enumerations and weights.  Rules and weights are data, not code."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: enumerations and maps that results depend on ---------------
SEVERITIES = ["BLOCKER", "HIGH", "MEDIUM", "LOW", "INFO"]
LEGACY_CATEGORIES = ["bug", "vulnerability", "code-quality", "performance", "resource", "style"]
NEW_CATEGORIES = ["security", "bugs", "efficiency", "resources"]
CATEGORIES = LEGACY_CATEGORIES + NEW_CATEGORIES
CATEGORY_MAP = {
    "bug": "bugs",
    "vulnerability": "security",
    "code-quality": "bugs",
    "performance": "efficiency",
    "resource": "resources",
    "style": "bugs",
}
REVERSE_CATEGORY_MAP = {
    "security": "vulnerability",
    "bugs": "bug",
    "efficiency": "performance",
    "resources": "resource",
}
CONFIDENCES = ["high", "medium", "low"]
SCORE_WEIGHTS = {"BLOCKER": 10, "HIGH": 5, "MEDIUM": 2, "LOW": 1, "INFO": 0}
GRADE_PENALTIES = {"BLOCKER": 25, "HIGH": 12, "MEDIUM": 5, "LOW": 1}
GATE_PENALTIES = {"BLOCKER": 30, "HIGH": 15, "MEDIUM": 5, "LOW": 2}
# --- end of fixed values ------------------------------------------------------

NATIVE_TOOL = "codeaudit"  # the tool name given to findings of the built-in rule packs
ASSURANCE_TOOL = "assurance"
TOOLS = [
    "eslint", "typescript", "ruff", "bandit", "semgrep", NATIVE_TOOL, "ai",
    "deployguard", "modelshield", "dependency-audit", "sca", ASSURANCE_TOOL,
]

SOURCE_FILES = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("mtime", T.TimestampType()),
    T.StructField("size", T.LongType()),
])

FINDING_SOURCE = T.StructType([
    T.StructField("tool", T.StringType()),
    T.StructField("ruleId", T.StringType()),
    T.StructField("analyzerVersion", T.StringType()),
])

FINDING = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("tool", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("legacyCategory", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("column", T.IntegerType()),
    T.StructField("rule", T.StringType()),
    T.StructField("ruleId", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("suggestedFix", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("source", FINDING_SOURCE),
])
FINDING_COLUMNS = [f.name for f in FINDING.fields]

# Linter reports, one struct per tool.
ESLINT_REPORT = T.ArrayType(T.StructType([
    T.StructField("filePath", T.StringType()),
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("ruleId", T.StringType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("column", T.IntegerType()),
        T.StructField("fix", T.StringType()),
    ]))),
]))
RUFF_REPORT = T.ArrayType(T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("location", T.StructType([
        T.StructField("row", T.IntegerType()), T.StructField("column", T.IntegerType())])),
    T.StructField("line", T.IntegerType()),
    T.StructField("column", T.IntegerType()),
    T.StructField("fix", T.StringType()),
]))
BANDIT_REPORT = T.StructType([T.StructField("results", T.ArrayType(T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("test_id", T.StringType()),
    T.StructField("issue_severity", T.StringType()),
    T.StructField("issue_confidence", T.StringType()),
    T.StructField("issue_text", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
])))])
SEMGREP_REPORT = T.StructType([T.StructField("results", T.ArrayType(T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("check_id", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("extra", T.StructType([
        T.StructField("severity", T.StringType()), T.StructField("message", T.StringType())])),
    T.StructField("start", T.StructType([
        T.StructField("line", T.IntegerType()), T.StructField("col", T.IntegerType())])),
])))])

DEPENDENCY = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("rawVersion", T.StringType()),
    T.StructField("ecosystem", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
])
ADVISORY = T.StructType([
    T.StructField("ord", T.IntegerType()),
    T.StructField("ecosystem", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("affected", T.ArrayType(T.StringType())),
    T.StructField("cve", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("fixed", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
])

ARTIFACT_REF = T.StructType([
    T.StructField("artifact", T.StringType()), T.StructField("sha256", T.StringType())])
ACTOR = T.StructType([
    T.StructField("contributor", T.StringType()), T.StructField("key_id", T.StringType())])
PROV_RECORD = T.StructType([
    T.StructField("schema_version", T.StringType()),
    T.StructField("record_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("actor", ACTOR),
    T.StructField("inputs", T.ArrayType(ARTIFACT_REF)),
    T.StructField("outputs", T.ArrayType(ARTIFACT_REF)),
    T.StructField("parent_record_hashes", T.ArrayType(T.StringType())),
    T.StructField("prev_record_hash", T.StringType()),
    T.StructField("record_hash", T.StringType()),
    T.StructField("signature", T.StringType()),
    T.StructField("contributor", T.StringType()),
    T.StructField("key_id", T.StringType()),
    T.StructField("operations", T.ArrayType(T.StringType())),
    T.StructField("public_key_der_b64", T.StringType()),
    T.StructField("operation", T.StringType()),
])
MANIFEST_FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("sha256", T.StringType()),
])
