"""Prompt tables for findings, and repair of model responses.  No network calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit.functions import text as X
from codeaudit.operators.ordered import first_n

# --- Fixed values -------------------------------------------------------------
RESPONSE_OBJECT = r"\{[\s\S]*?\}"
RESPONSE_SEVERITIES = ["HIGH", "MEDIUM", "LOW"]
DEFAULTS = {
    "explanation": "AI analysis completed but explanation was not provided.",
    "impact": "Impact assessment requires manual review.",
    "suggestedFix": "Review the code and apply appropriate remediation.",
}
DEFAULT_SEVERITY, DEFAULT_CONFIDENCE, DEFAULT_FALSE_POSITIVE = "MEDIUM", 0.5, 0.2
TRUNCATION_MARKER = "\n... [truncated] ..."
MAX_CONTEXT = 2000
MAX_FINDINGS = 10
COMPLEX_LANGUAGES = ["typescript", "python", "java", "go", "rust"]
FINDING_HEAD = [
    "You are a code analysis tool. Analyze this finding and respond ONLY with a JSON object.",
    "Do not include any explanation before or after the JSON. Just the raw JSON object.",
    "",
]
FINDING_TAIL = [
    "Respond with this exact JSON structure:",
    '{"explanation":"brief explanation","severity":"HIGH|MEDIUM|LOW","confidence":0.8,"falsePositiveProbability":0.1,"impact":"brief impact","suggestedFix":"brief fix"}',
]
CORRELATION_HEAD = ["Analyze the following code findings and identify any correlations or relationships between them:", ""]
CORRELATION_TAIL = [
    "Please identify:", "1. Which findings might be related", "2. Common patterns or root causes",
    "3. Potential attack chains or combined risks", "4. Prioritized remediation order", "",
    "Respond in JSON format:", "```json", "{", '  "correlations": [', "    {",
    '      "findingIndices": [0, 1, 2],', '      "relationship": "...",', '      "riskLevel": "HIGH|MEDIUM|LOW",',
    '      "explanation": "..."', "    }", "  ],", '  "rootCause": "...",', '  "prioritizedFixes": ["..."]', "}", "```",
]
RECONCILE_TAIL = [
    "Please provide a reconciled severity and confidence assessment.", "", "Respond in JSON format:", "```json", "{",
    '  "reconciledSeverity": "HIGH|MEDIUM|LOW",', '  "reconciledConfidence": 0.0-1.0,', '  "reasoning": "..."', "}", "```",
]
# --- end of fixed values ------------------------------------------------------


def _block(*lines: Column | str) -> Column:
    """Lines joined by line feeds; null lines are left out."""
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


def _field(label: str, value: Column, optional: bool = False) -> Column:
    text = F.concat(F.lit(f"- {label}: "), F.coalesce(value.cast("string"), F.lit("null")))
    return F.when(F.coalesce(value.cast("string"), F.lit("")) != "", text) if optional else text


def source_context(findings: DataFrame, files: DataFrame, radius: int = 10) -> DataFrame:
    """Add `source_context`: the lines around each finding.  Files are split before the join."""
    split = files.select("project_id", F.col("path").alias("file"), X.split_lines(F.col("content")).alias("_lines"))
    line = F.when(F.coalesce("line", F.lit(0)) == 0, 1).otherwise(F.col("line"))
    first = F.greatest(line - radius - 1, F.lit(0))
    count = F.greatest(F.least(line + radius, F.size("_lines")) - first, F.lit(0))
    return findings.join(split, ["project_id", "file"], "left").withColumn(
        "source_context", F.array_join(F.slice("_lines", first + 1, count), "\n")).drop("_lines")


def line_snippet(findings: DataFrame, files: DataFrame, radius: int = 2) -> DataFrame:
    """Add `snippet_lines`: array of (lineNum, isTarget, text) around each finding."""
    split = files.select("project_id", F.col("path").alias("file"), X.snippet_lines(F.col("content")).alias("_lines"))
    line = F.col("line")
    first = F.greatest(line - 1 - radius, F.lit(0))
    count = F.greatest(F.least(line + radius, F.size("_lines")) - first, F.lit(0))
    rows = F.transform(F.slice("_lines", first + 1, count), lambda t, k: F.struct(
        (first + k + 1).alias("lineNum"), (first + k + 1 == line).alias("isTarget"), t.alias("text")))
    return findings.join(split, ["project_id", "file"], "left").withColumn(
        "snippet_lines", F.when(F.coalesce("line", F.lit(0)) > 0, rows)).drop("_lines")


def truncate_context(text: Column, limit: int = MAX_CONTEXT) -> Column:
    """Cut at `limit`, at a line break if one lies in the last fifth."""
    room = limit - len(TRUNCATION_MARKER)
    marker = F.lit(TRUNCATION_MARKER)
    if room <= 0:
        return F.when(F.length(text) <= limit, text).otherwise(marker)
    cut = F.substring(text, 1, room)
    last = F.lit(room) - F.instr(F.reverse(cut), "\n")  # 0-based place of the last line feed
    has_break = cut.contains("\n") & (last > room * 0.8)
    kept = F.when(has_break, F.substr(cut, F.lit(1), last)).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(kept, marker))


def finding_prompts(
    findings: DataFrame, context: str | None = "source_context", impacted: str | None = None, summary: str | None = None
) -> DataFrame:
    """Add `prompt` for the analysis of one finding."""
    source = F.col(context) if context else F.lit(None).cast("string")
    has_source = F.coalesce(source, F.lit("")) != ""
    files = F.col(impacted) if impacted else F.array().cast("array<string>")
    about = F.col(summary) if summary else F.lit(None).cast("string")
    with_files = F.when(F.size(files) > 0, F.concat(
        F.lit("- Dependent / Impacted Files ("), F.size(files).cast("string"), F.lit("): "), F.array_join(files, ", ")))
    with_about = F.when(F.coalesce(about, F.lit("")) != "", about)
    has_context = F.lit(bool(impacted or summary))
    return findings.withColumn("prompt", _block(
        *FINDING_HEAD, "Finding:", _field("Category", F.col("category")), _field("Severity", F.col("severity")),
        _field("File", F.col("file")), _field("Line", F.when(F.col("line") != 0, F.col("line")), True),
        _field("Rule", F.col("rule"), True), _field("Message", F.col("message")),
        _field("Suggested Fix", F.col("suggestedFix"), True), "",
        F.when(has_source, _block("Source code:", "```", source, "```", "")),
        F.when(has_context, _block("Architecture & Impact Context:", with_files, with_about, "")), *FINDING_TAIL))


def correlation_prompts(findings: DataFrame, keys: list[str] = ("project_id",), limit: int = MAX_FINDINGS) -> DataFrame:
    """One prompt per project about its first `limit` findings (a prompt has a budget)."""
    top = first_n(findings, limit, list(keys), ["file", "line", "seq"], rank="_n")
    entry = _block(
        F.concat(F.lit("Finding "), F.col("_n").cast("string"), F.lit(":")), _field("Category", F.col("category")),
        _field("Severity", F.col("severity")),
        F.concat(F.lit("- File: "), F.col("file"), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("?"))),
        _field("Rule", F.col("rule")), _field("Message", F.col("message")), "")
    listed = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", entry.alias("t")))).alias("_e"))
    body = F.array_join(F.transform("_e", lambda e: e["t"]), "\n")
    return listed.select(*keys, _block(*CORRELATION_HEAD, body, *CORRELATION_TAIL).alias("prompt"))


def reconciliation_prompts(findings: DataFrame, analysis: str = "ai") -> DataFrame:
    """Add `prompt` that asks to reconcile a tool severity with an analysis."""
    a = F.col(analysis)
    return findings.withColumn("prompt", _block(
        "Reconcile the following severity assessments:", "", "Original Finding:",
        _field("Tool Severity", F.col("severity")), _field("Category", F.col("category")), _field("Rule", F.col("rule")),
        _field("Message", F.col("message")), "", "AI Analysis:", _field("AI Severity", a["severity"]),
        _field("Confidence", a["confidence"]), _field("Explanation", a["explanation"]), "", *RECONCILE_TAIL))


def ai_budget(findings: DataFrame, n: int = MAX_FINDINGS, keys: list[str] = ("project_id",), order: list = ("file", "line", "seq")) -> DataFrame:
    """The first `n` findings of each project, the ones an analysis may spend calls on."""
    return first_n(findings, n, list(keys), list(order))


# ---- responses ---------------------------------------------------------------

def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def parse_response(response: Column, strict: bool = False) -> Column:
    """struct(explanation, severity, confidence, falsePositiveProbability, impact, suggestedFix);
    null if no JSON object parses (or, strict, if any field needs repair)."""
    doc = F.try_parse_json(F.regexp_extract(response, RESPONSE_OBJECT, 0))

    def part(name: str) -> Column:
        return F.try_variant_get(doc, f"$.{name}", "variant")

    def text(name: str) -> Column:
        value = F.try_variant_get(doc, f"$.{name}", "string")
        return F.when((_kind(part(name)) == "STRING") & (value != ""), value)

    def number(name: str) -> Column:
        value = F.try_variant_get(doc, f"$.{name}", "double")
        return F.when(_kind(part(name)).rlike("^(BIGINT|DECIMAL|DOUBLE)") & (value >= 0) & (value <= 1), value)

    severity = F.when(text("severity").isin(RESPONSE_SEVERITIES), text("severity"))
    found = {"explanation": text("explanation"), "severity": severity, "confidence": number("confidence"),
             "falsePositiveProbability": number("falsePositiveProbability"), "impact": text("impact"),
             "suggestedFix": text("suggestedFix")}
    defaults = {**DEFAULTS, "severity": DEFAULT_SEVERITY, "confidence": DEFAULT_CONFIDENCE,
                "falsePositiveProbability": DEFAULT_FALSE_POSITIVE}
    out = F.struct(*[F.coalesce(c, F.lit(defaults[n])).alias(n) for n, c in found.items()])
    usable = F.coalesce(_kind(doc).startswith("OBJECT"), F.lit(False))
    if strict:
        for c in found.values():
            usable = usable & c.isNotNull()
    return F.when(usable, out)


def repair_responses(responses: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(parsed, rejects) of (finding_id, model, response)."""
    marked = responses.withColumn("ai", parse_response(F.col("response"), strict))
    return marked.filter(F.col("ai").isNotNull()), marked.filter(F.col("ai").isNull()).drop("ai")


def parse_correlation(response: Column) -> Column:
    """Only the six repaired fields survive a parse, so correlations are always empty."""
    ok = parse_response(response).isNotNull()
    return F.struct(
        F.array().cast("array<string>").alias("correlations"),
        F.when(ok, "Unable to determine root cause").otherwise("Failed to parse correlation analysis").alias("rootCause"),
        F.array().cast("array<string>").alias("prioritizedFixes"))


def parse_reconciliation(response: Column) -> Column:
    ok = parse_response(response).isNotNull()
    return F.struct(
        F.lit(DEFAULT_SEVERITY).alias("reconciledSeverity"), F.lit(DEFAULT_CONFIDENCE).alias("reconciledConfidence"),
        F.when(ok, "").otherwise("Failed to parse severity reconciliation").alias("reasoning"))


def attach_analysis(findings: DataFrame, parsed: DataFrame) -> DataFrame:
    """Add `ai` (fields and model) to findings by id; the first response wins."""
    one = parsed.groupBy(F.col("finding_id").alias("id")).agg(F.min_by(
        F.struct(*[F.col(f"ai.{n}").alias(n) for n in (
            "explanation", "severity", "confidence", "falsePositiveProbability", "impact", "suggestedFix")],
            "model"), F.col("model")).alias("ai"))
    return findings.join(one, "id", "left")


def ai_summary(analysed: DataFrame, keys: list[str] = ("project_id",)) -> DataFrame:
    """Findings per model and confidence band; rows carry columns model, confidence."""
    level = F.coalesce("confidence", F.lit(0.0))
    return analysed.groupBy(*keys, F.coalesce("model", F.lit("unknown")).alias("model")).agg(
        F.count("*").alias("findings"), F.count_if(level >= 0.8).alias("high_confidence"),
        F.count_if((level >= 0.5) & (level < 0.8)).alias("medium_confidence"),
        F.count_if(level < 0.5).alias("low_confidence"))


def corpus_complexity(files: DataFrame, keys: list[str] = ("project_id",)) -> DataFrame:
    """Complexity score of each project: files, languages, lines (needs `language`, `content`)."""
    lines = X.count_of(F.col("content"), "\n") + 1
    sums = files.groupBy(*keys).agg(
        F.count("*").alias("files"), F.count_distinct("language").alias("languages"), F.sum(lines).alias("lines"),
        F.bool_or(F.lower("language").isin(COMPLEX_LANGUAGES)).alias("_complex"))
    score = (
        F.least(F.col("files") / 50, F.lit(1.0)) * 30 + F.least(F.col("languages") / 3, F.lit(1.0)) * 20
        + F.least(F.col("lines") / 5000, F.lit(1.0)) * 30 + F.when(F.coalesce("_complex", F.lit(False)), 20).otherwise(0))
    return sums.withColumn("complexity", score).withColumn(
        "level", F.when(F.col("complexity") >= 70, "complex").when(F.col("complexity") >= 40, "moderate").otherwise("simple")
    ).drop("_complex")
