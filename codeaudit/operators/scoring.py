"""Dedup, aggregation, scores, grades and gates.  One hash shuffle each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit import schemas as S
from codeaudit.functions import text as X
from codeaudit.functions.findings import severity_index
from codeaudit.operators.discovery import is_production_path
from codeaudit.operators.ordered import first_n

KEYS = ["project_id"]


def js_round(value: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(value + F.lit(0.5)).cast("int")


def weight(severity: Column, weights: dict[str, int], other: int = 0) -> Column:
    return F.coalesce(X.literal_map(weights)[severity], F.lit(other))


def severity_threshold(df: DataFrame, level: str | None) -> DataFrame:
    """Keep findings at least as severe as `level`; an unknown level keeps all."""
    if level not in S.SEVERITIES:
        return df
    return df.filter(F.col("severity").isin(S.SEVERITIES[: S.SEVERITIES.index(level) + 1]))


def category_filter(df: DataFrame, category: str | None) -> DataFrame:
    return df if not category else df.filter(F.col("category") == category)


def dedupe_findings(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per fingerprint keep the most severe finding, the first seen on ties.

    Equal `seq` is decided by file, line, rule and message, so task order never matters.

    A rank of which one row is kept: every task keeps one row of a fingerprint before
    it shuffles, so one that repeats a billion times reaches the shuffle once per task.
    Unlike a struct of all columns, it lets the planner drop those that nobody reads.
    """
    order = [severity_index(F.col("severity")), *[F.col(c) for c in ("seq", "file", "line", "rule", "message") if c in df.columns]]
    return first_n(df, 1, [*keys, "fingerprint"], order)


def duplicate_groups(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Members of every fingerprint that occurs more than once, with the group size.

    Long format: a group is rows, never one array, so its size has no bound.
    """
    on = [*keys, "fingerprint"]
    sizes = df.groupBy(*on).agg(F.count("*").alias("group_size")).filter("group_size > 1")
    return df.join(sizes, on, "inner")


def aggregate_findings(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Counts in total and by severity (zero-filled), category, tool and file.

    One grouping-sets query; the severity counts ride on the total row.
    """
    sets = [keys, [*keys, "category"], [*keys, "tool"], [*keys, "file"]]
    columns = [F.col(k) for k in keys] + [F.col("category"), F.col("tool"), F.col("file")]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        F.count("*").alias("_n"),
        F.grouping_id().alias("_gid"),
        *[F.count_if(F.col("severity") == s).alias(f"_{s}") for s in S.SEVERITIES],
    )

    def row(dimension: str, key: Column, n: Column) -> Column:
        return F.struct(F.lit(dimension).alias("dimension"), key.alias("key"), n.alias("findings"))

    totals = F.array(
        row("total", F.lit("total"), F.col("_n")),
        *[row("severity", F.lit(s), F.col(f"_{s}")) for s in S.SEVERITIES],
    )
    # grouping_id bits, high to low: the keys, then category, tool, file; 1 = not grouped.
    rows = (
        F.when(F.col("_gid") == 0b111, totals)
        .when(F.col("_gid") == 0b011, F.array(row("category", F.col("category"), F.col("_n"))))
        .when(F.col("_gid") == 0b101, F.array(row("tool", F.col("tool"), F.col("_n"))))
        .otherwise(F.array(row("file", F.col("file"), F.col("_n"))))
    )
    return grouped.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def severity_counts(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in S.SEVERITIES],
    )


def with_score(counts: DataFrame) -> DataFrame:
    """Relative score, its penalty and the non-zero penalties by severity."""
    parts = {s: F.col(s.lower()) * w for s, w in S.SCORE_WEIGHTS.items()}
    penalty = sum(parts.values(), F.lit(0))
    worst = F.col("total") * S.SCORE_WEIGHTS["BLOCKER"]
    value = js_round(100 - penalty / worst * 100)
    breakdown = F.concat_ws(",", *[
        F.when(p > 0, F.concat(F.lit(f"{s}="), p.cast("string"))) for s, p in parts.items()])
    return counts.withColumns({
        "score": F.when(F.col("total") == 0, F.lit(100)).otherwise(F.greatest(F.lit(0), value)),
        "penalty": penalty.cast("long"),
        "max_penalty": worst.cast("long"),
        "breakdown": breakdown,
    })


# Verdict thresholds and texts.
VERDICTS = [
    (80, "PASS", "Codebase meets quality thresholds."),
    (50, "WARN", "Codebase has moderate issues that should be addressed."),
]
FAIL_MESSAGE = "Codebase has significant issues that must be resolved."


def verdict_status(score: Column) -> Column:
    return F.when(score >= 80, "PASS").when(score >= 50, "WARN").otherwise("FAIL")


def verdict_message(score: Column) -> Column:
    return (F.when(score >= 80, VERDICTS[0][2]).when(score >= 50, VERDICTS[1][2])
            .otherwise(FAIL_MESSAGE))


def project_score(
    df: DataFrame, projects: DataFrame | None = None, keys: list[str] = KEYS
) -> DataFrame:
    """Score and verdict per project; `projects` adds those without findings (score 100)."""
    counts = severity_counts(df, keys)
    if projects is not None:
        names = [c for c in counts.columns if c not in keys]
        counts = projects.select(*keys).distinct().join(counts, keys, "left").fillna(0, names)
    scored = with_score(counts)
    return scored.withColumns({
        "verdict": verdict_status(F.col("score")), "verdict_message": verdict_message(F.col("score"))})


def deploy_readiness(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Production readiness gate over security findings of production files, with the count of all findings."""
    relevant = (
        (F.col("tool") == "deployguard") | (F.col("category") == "security")
        | F.coalesce(F.col("ruleId").startswith("deployguard-"), F.lit(False))
    )
    production = F.coalesce(is_production_path(F.col("file")), F.lit(True))
    counted = relevant & production
    names = {"BLOCKER": "blockers", "HIGH": "high", "MEDIUM": "medium", "LOW": "low"}
    counts = df.groupBy(*keys).agg(
        F.count_if(counted).alias("total_issues"),
        *[F.count_if(counted & (F.upper("severity") == s)).alias(n) for s, n in names.items()],
        F.count("*").alias("findings"),
    )
    penalty = sum((F.col(n) * S.GATE_PENALTIES[s] for s, n in names.items()), F.lit(0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - penalty)).cast("int")
    blocked = (F.col("blockers") > 0) | (F.col("readiness_score") < 60)
    warned = (F.col("high") > 0) | (F.col("readiness_score") < 80)
    return counts.withColumn("readiness_score", score).withColumns({
        "readiness_status": F.when(blocked, "BLOCKED").when(warned, "WARNING").otherwise("PASSED"),
        "readiness_message": F.when(blocked, F.format_string(
            "Deployment blocked! Detected %d critical blocker(s) in configuration or infrastructure.",
            F.col("blockers")))
        .when(warned, F.format_string(
            "Deployment requires review. %d high-priority risk(s) identified before production.",
            F.col("high")))
        .otherwise("All pre-deployment security & configuration checks passed. "
                   "Ready for production release."),
    })


def grade_of(score: Column) -> Column:
    return (F.when(score >= 95, "A+").when(score >= 88, "A").when(score >= 78, "B")
            .when(score >= 65, "C").when(score >= 45, "D").otherwise("F"))


def risk_grade(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Absolute risk score and letter grade; unknown severities cost 1."""
    penalty = F.sum(weight(F.upper("severity"), S.GRADE_PENALTIES, other=1))
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.col("risk_penalty"))).cast("int")
    return (
        df.groupBy(*keys)
        .agg(penalty.cast("long").alias("risk_penalty"), F.count("*").alias("findings"))
        .withColumn("risk_score", score)
        .withColumn("grade", grade_of(F.col("risk_score")))
    )


CATEGORY_BUCKETS = [*S.NEW_CATEGORIES, "modelshield", "deployguard"]


def category_breakdown(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Count and penalty in the six known buckets, zero where nothing falls in one."""
    category = F.lower(F.coalesce(F.col("category"), F.lit("bugs")))
    cost = weight(F.upper("severity"), S.GRADE_PENALTIES, other=1)
    wide = df.groupBy(*keys).agg(*[
        agg for b in CATEGORY_BUCKETS for agg in (
            F.count_if(category == b).alias(f"_n_{b}"),
            F.coalesce(F.sum(F.when(category == b, cost)), F.lit(0)).cast("long").alias(f"_p_{b}"))
    ])
    rows = F.array(*[
        F.struct(F.lit(b).alias("bucket"), F.col(f"_n_{b}").alias("findings"),
                 F.col(f"_p_{b}").alias("penalty"))
        for b in CATEGORY_BUCKETS])
    return wide.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def gate_exit(
    gate: DataFrame, errors: DataFrame | None = None, assurance: DataFrame | None = None,
    gate_mode: bool = False, keys: list[str] = KEYS,
) -> DataFrame:
    """Exit code per project as a column.

    `gate` is `deploy_readiness` with its `findings` count; `errors` and `assurance`
    carry one row per project (`errors` count, `assurance_exit`).
    """
    out = gate
    if errors is not None:
        out = out.join(errors.select(*keys, "errors"), keys, "left")
    else:
        out = out.withColumn("errors", F.lit(0))
    if assurance is not None:
        out = out.join(assurance.select(*keys, "assurance_exit"), keys, "left")
    else:
        out = out.withColumn("assurance_exit", F.lit(0))
    own = (
        F.when(F.coalesce(F.col("errors"), F.lit(0)) > 0, 2)
        .when(F.lit(gate_mode), F.when(F.col("readiness_status") == "BLOCKED", 1).otherwise(0))
        .when(F.col("findings") > 0, 1).otherwise(0)
    )
    return out.withColumn(
        "exit_code", F.greatest(own, F.coalesce(F.col("assurance_exit"), F.lit(0))))
