import hashlib

import pytest
from pyspark.sql import functions as F

from codeaudit.functions.findings import build_findings, validate_findings
from codeaudit.operators import history as H
from codeaudit.operators import normalise as N
from codeaudit.operators import scoring as A
from codeaudit.operators.ordered import cap_per_rule

RAW = "project_id string, seq long, tool string, category string, severity string, file string, line int, column int, rule string, message string, suggestedFix string"


def findings(spark, rows):
    return build_findings(spark.createDataFrame([("p", n, t, c, s, f, line, None, "r", "m", None) for n, (t, c, s, f, line) in enumerate(rows)], RAW))


def test_ids(spark):
    row = findings(spark, [("eslint", "bug", "LOW", "a.js", None)]).first()
    assert row.id == hashlib.sha256(b"eslint:a.js:null:r").hexdigest()[:16]
    assert row.fingerprint == hashlib.sha256(b"a.js:null:bugs").hexdigest()[:16]
    assert (row.category, row.legacyCategory) == ("bugs", "bug")


def test_dedupe_keeps_most_severe_then_first(spark):
    df = findings(spark, [("eslint", "bugs", "LOW", "a", 1), ("ruff", "bugs", "BLOCKER", "a", 1), ("bandit", "bugs", "BLOCKER", "a", 1), ("ruff", "security", "LOW", "a", 1)])
    kept = {(r.tool, r.severity) for r in A.dedupe_findings(df).collect()}
    assert kept == {("ruff", "BLOCKER"), ("ruff", "LOW")}
    assert {r.group_size for r in A.duplicate_groups(df).collect()} == {3}


def test_dedupe_of_a_hot_fingerprint(spark):
    df = spark.range(50_000).select(
        F.lit("p").alias("project_id"), F.col("id").alias("seq"), F.lit("ruff").alias("tool"), F.lit("bugs").alias("category"),
        F.when(F.col("id") == 33_333, "HIGH").otherwise("LOW").alias("severity"), F.lit("a").alias("file"), F.lit(1).alias("line"),
        F.lit(None).cast("int").alias("column"), F.lit("r").alias("rule"), F.lit("m").alias("message"), F.lit(None).cast("string").alias("suggestedFix"))
    assert [(r.seq, r.severity) for r in A.dedupe_findings(build_findings(df)).collect()] == [(33_333, "HIGH")]


def test_scores(spark):
    df = findings(spark, [("ruff", "bugs", s, f"f{n}", n) for n, s in enumerate(["BLOCKER"] + ["HIGH"] * 2 + ["MEDIUM"] * 3 + ["LOW"] * 4)])
    row = A.project_score(df, spark.createDataFrame([("p",), ("q",)], "project_id string")).orderBy("project_id").collect()
    assert (row[0].score, row[0].verdict, row[0].penalty) == (70, "WARN", 30)
    assert (row[1].score, row[1].total, row[1].verdict) == (100, 0, "PASS")
    grade = A.risk_grade(df).first()
    assert (grade.risk_penalty, grade.risk_score, grade.grade) == (25 + 24 + 15 + 4, 32, "F")


def test_gate_ignores_tests_and_exits(spark):
    df = findings(spark, [("ruff", "security", "BLOCKER", "tests/a.py", 1), ("ruff", "security", "HIGH", "src/a.py", 1)])
    gate = A.deploy_readiness(df).withColumn("findings", F.lit(2))
    row = A.gate_exit(gate).first()
    assert (row.blockers, row.readiness_score, row.readiness_status, row.exit_code) == (0, 85, "WARNING", 1)
    errors = spark.createDataFrame([("p", 1)], "project_id string, errors int")
    assert A.gate_exit(gate, errors, gate_mode=True).first().exit_code == 2


def test_validation_splits_rows(spark):
    rows = [("p", 1, "nope", "bugs", "LOW", "a", 1, None, "r", "m", None), ("p", 2, "ruff", "bugs", "LOW", "a", 1, None, "r", "m", None)]
    valid, rejects = validate_findings(spark.createDataFrame(rows, RAW))
    assert valid.count() == 1 and rejects.first().reject_reason == "invalid tool"


def test_unknown_normalizer():
    with pytest.raises(ValueError, match="no normalizer"):
        N.normalize("nothing", None)


def test_trend_over_bucket_borders_and_hot_project(spark):
    """Brute force: the previous scan of every scan, with most scans in one project."""
    rows = [("hot" if n % 4 else f"p{n % 12}", 1_700_000_000 + n * 977 % 400_000, n, n * 37 % 101, "A") for n in range(800)]
    df = spark.createDataFrame(rows, "project_id string, t long, seq long, score int, grade string").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.seq: (r.previous_score, r.direction) for r in H.score_trend(df, bucket_seconds=3_600).collect()}
    last, want = {}, {}
    for p, t, seq, score, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        before = last.get(p)
        want[seq] = (score, "baseline") if before is None else (
            before, "improved" if score > before else "degraded" if score < before else "unchanged")
        last[p] = score
    assert got == want


def test_cap_per_rule_counts_the_rest(spark):
    df = spark.range(250).select(F.lit("p").alias("project_id"), F.lit("findings").alias("list"), F.lit("R").alias("rule"),
                                 F.lit("HIGH").alias("severity"), F.col("id").alias("seq"), F.lit("m").alias("message"))
    out = cap_per_rule(df, 100).collect()
    assert len(out) == 101 and [r.message for r in out if r.truncated] == ["150 additional R finding(s) omitted"]


def test_learned_fix(spark):
    df = spark.createDataFrame([("p", "1", "loose-equality", "bugs", "if (x == y) {"), ("p", "2", "x", "resources", "")],
                               "project_id string, id string, ruleId string, category string, snippet string")
    got = {r.id: (r.pattern_id, r.proposed_patch) for r in H.match_learned_fix(df, H.seed_patterns(spark)).collect()}
    assert got == {"1": ("loose-equality", "if (x === y) {"), "2": (None, None)}
