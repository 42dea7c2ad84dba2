"""Report rankings and linter normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeaudit.operators import ai as AI
from codeaudit.operators import normalise as N
from codeaudit.operators import ranking as R
from codeaudit.queries import inputs as I
from codeaudit.queries.registry import query, table
from codeaudit.sources import reports as SR

FS = "WITH " + I.FINDINGS_SQL


def scored(spark, sf):
    """Findings with an analysis on some: confidence and false-positive probability."""
    n = F.floor(F.col("seq") / 1_000_000)
    return I.findings_once(spark, sf).withColumns({
        "confidence_score": F.when((n % 3 == 0) & (F.col("project_id") != "proj1"), (n % 100) / 100.0),
        "false_positive": F.when(n % 3 == 0, (n % 50) / 50.0)})


_SCORED = """u AS (SELECT DISTINCT * FROM findings),
scored AS (SELECT *, CASE WHEN seq // 1000000 % 3 = 0 AND project_id <> 'proj1' THEN (seq // 1000000 % 100) / 100.0 END AS c, CASE WHEN seq // 1000000 % 3 = 0 THEN (seq // 1000000 % 50) / 50.0 END AS fp FROM u)"""
_ORD = "file, line, seq"


@query("files_by_risk", "project_id s, file s, severe l, findings l", f"{FS} SELECT project_id, file, count(*) FILTER (severity IN ('HIGH','BLOCKER')) AS severe, count(*) AS findings FROM findings GROUP BY ALL")
def files_by_risk(spark, sf):
    return R.files_by_risk(I.findings(spark, sf))


@query("findings_in_file_order", "project_id s, file s, line l, severity s, seq l", f"{FS} SELECT project_id, file, line, severity, seq FROM findings")
def findings_in_file_order(spark, sf):
    return R.findings_in_file_order(I.findings(spark, sf))


@query("top_risks", "project_id s, seq l, position l", f"""{FS}, {_SCORED},
s AS (SELECT * FROM scored WHERE severity IN ('HIGH','BLOCKER')), a AS (SELECT project_id, seq, row_number() OVER (PARTITION BY project_id ORDER BY c DESC, {_ORD}) AS position FROM s WHERE c IS NOT NULL QUALIFY position <= 5)
SELECT * FROM a UNION ALL SELECT project_id, seq, row_number() OVER (PARTITION BY project_id ORDER BY {_ORD}) AS position FROM s WHERE project_id NOT IN (SELECT project_id FROM a) QUALIFY position <= 5""")
def top_risks(spark, sf):
    return R.top_risks(scored(spark, sf))


@query("likely_false_positives", "project_id s, seq l, position l", f"""{FS}, {_SCORED} SELECT project_id, seq, row_number() OVER (PARTITION BY project_id ORDER BY fp DESC, {_ORD}) AS position FROM scored WHERE fp > 0.3 QUALIFY position <= 10""")
def likely_false_positives(spark, sf):
    return R.likely_false_positives(scored(spark, sf))


@query("remediation_plan", "project_id s, severity s, file s, rule s, seq l, position l", f"""{FS}, u AS (SELECT DISTINCT * FROM findings),
f AS (SELECT * FROM u WHERE sev_idx <= 2 QUALIFY row_number() OVER (PARTITION BY project_id, severity, rule, file ORDER BY line, seq) = 1)
SELECT project_id, severity, file, rule, seq, row_number() OVER (PARTITION BY project_id ORDER BY sev_idx, {_ORD}) AS position FROM f QUALIFY position <= 20""")
def remediation_plan(spark, sf):
    return R.remediation_plan(I.findings_once(spark, sf))


@query("first_findings", "project_id s, seq l, position l, more l", f"""{FS}, u AS (SELECT DISTINCT * FROM findings)
SELECT project_id, seq, row_number() OVER (PARTITION BY project_id ORDER BY {_ORD}) AS position, greatest(count(*) OVER (PARTITION BY project_id) - 10, 0) AS more FROM u QUALIFY position <= 10""")
def first_findings(spark, sf):
    return R.first_findings(I.findings_once(spark, sf))


@query("ai_budget", "project_id s, seq l", f"""{FS}, u AS (SELECT DISTINCT * FROM findings) SELECT project_id, seq FROM u QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY {_ORD}) <= 10""")
def ai_budget(spark, sf):
    return AI.ai_budget(I.findings_once(spark, sf))


# ---- linter reports: JSON texts built from part, findings expected from the columns ----
OUT = "project_id s, file s, line l, column l, rule s, severity s, category s, message s, confidence s, id s"
_ESL = ["no-unused-vars", "no-eval", "complexity", "semi", "no-undef", "security/detect-x"]
_ESC = ["bugs", "security", "efficiency", "bugs", "bugs", "security"]
_RUFF = ["E501", "W291", "F401", "S101", "B006", "T201", "XYZ"]


def _reports(spark, sf, report):
    p = table(spark, sf, "part")
    return p.select(I.text("proj", I.div(F.col("p_partkey"), 100)).alias("project_id"), report.alias("report"))


def _id(tool: str, file: str, line: str, rule: str) -> str:
    return f"substr(sha256('{tool}:' || {file} || ':' || {line} || ':' || {rule}), 1, 16) AS id"


def K():
    return F.col("p_partkey")


@query("normalise_eslint", OUT, f"""WITH b AS (SELECT 'proj' || (p_partkey // 100) AS project_id, p_partkey AS k, unnest([0, 1]) AS m FROM part),
x AS (SELECT *, ({I.sql_list(_ESL)})[(k + m) % 6 + 1] AS rule, ({I.sql_list(_ESC)})[(k + m) % 6 + 1] AS category, CASE WHEN m = 1 THEN 0 ELSE k % 4 END AS sev FROM b)
SELECT project_id, 'f' || k || '.js' AS file, k + m AS line, m + 1 AS "column", rule, CASE sev WHEN 2 THEN 'BLOCKER' WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, category, 'msg ' || k AS message, 'medium' AS confidence,
  {_id('eslint', "'f' || k || '.js'", '(k + m)', 'rule')} FROM x WHERE sev <> 0""")
def normalise_eslint(spark, sf):
    def message(m, severity):
        return I.text('{"ruleId":"', I.pick(_ESL, (K() + m) % 6), '","severity":', severity, ',"message":"msg ', K(), '","line":', K() + m, ',"column":', F.lit(m + 1), "}")

    report = I.text('[{"filePath":"f', K(), '.js","messages":[', message(0, K() % 4), ",", message(1, F.lit(0)), "]}]")
    return N.normalize("eslint", SR.parse_eslint(_reports(spark, sf, report)))


@query("normalise_typescript", OUT, f"""SELECT 'proj' || (p_partkey // 100) AS project_id, 'f' || p_partkey || '.ts' AS file, p_partkey AS line, 7 AS "column", 'TSTS' || (2000 + p_partkey % 9) AS rule,
  CASE p_partkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity, 'bugs' AS category, 'bad (x): y' AS message, 'medium' AS confidence, {_id('typescript', "'f' || p_partkey || '.ts'", 'p_partkey', "'TSTS' || (2000 + p_partkey % 9)")} FROM part""")
def normalise_typescript(spark, sf):
    kind = I.pick(["error", "warning", "message"], K() % 3)
    report = I.text("noise\nf", K(), ".ts(", K(), ",7): ", kind, " TS", K() % 9 + 2000, ": bad (x): y\nFound 1 error.")
    return N.normalize("typescript", SR.parse_tsc(_reports(spark, sf, report)))


@query("normalise_ruff", OUT, f"""WITH x AS (SELECT p_partkey AS k, ({I.sql_list(_RUFF)})[p_partkey % 7 + 1] AS rule FROM part)
SELECT 'proj' || (k // 100) AS project_id, 'f' || k || '.py' AS file, k AS line, 2 AS "column", rule, CASE substr(rule, 1, 1) WHEN 'W' THEN 'LOW' WHEN 'F' THEN 'HIGH' WHEN 'S' THEN 'HIGH' WHEN 'T' THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  CASE WHEN rule = 'S101' THEN 'security' ELSE 'bugs' END AS category, 'm' || k AS message, 'medium' AS confidence, {_id('ruff', "'f' || k || '.py'", 'k', 'rule')} FROM x""")
def normalise_ruff(spark, sf):
    report = I.text('[{"filename":"f', K(), '.py","code":"', I.pick(_RUFF, K() % 7), '","message":"m', K(), '","location":{"row":', K(), ',"column":2}}]')
    return N.normalize("ruff", SR.parse_ruff(_reports(spark, sf, report)))


@query("normalise_bandit", OUT, f"""SELECT 'proj' || (p_partkey // 100) AS project_id, 'f' || p_partkey || '.py' AS file, p_partkey AS line, NULL AS "column", 'B10' || (p_partkey % 5) AS rule, (['HIGH','MEDIUM','LOW','MEDIUM'])[p_partkey % 4 + 1] AS severity, 'security' AS category,
  't' || p_partkey AS message, (['high','medium','low','medium'])[p_partkey % 4 + 1] AS confidence, {_id('bandit', "'f' || p_partkey || '.py'", 'p_partkey', "'B10' || (p_partkey % 5)")} FROM part""")
def normalise_bandit(spark, sf):
    level = I.pick(["HIGH", "MEDIUM", "LOW", "ODD"], K() % 4)
    report = I.text('{"results":[{"filename":"f', K(), '.py","test_id":"B10', K() % 5, '","issue_severity":"', level, '","issue_confidence":"', level, '","issue_text":"t', K(), '","line_number":', K(), "}]}")
    return N.normalize("bandit", SR.parse_bandit(_reports(spark, sf, report)))


_CHECKS = ["py.security.x", "js.bug.y", "perf.slow", "style.z"]


@query("normalise_semgrep", OUT, f"""SELECT 'proj' || (p_partkey // 100) AS project_id, 'f' || p_partkey || '.py' AS file, p_partkey AS line, 3 AS "column", ({I.sql_list(_CHECKS)})[p_partkey % 4 + 1] AS rule, (['HIGH','LOW','MEDIUM'])[p_partkey % 3 + 1] AS severity,
  (['security','bugs','efficiency','bugs'])[p_partkey % 4 + 1] AS category, 'm' || p_partkey AS message, 'medium' AS confidence, {_id('semgrep', "'f' || p_partkey || '.py'", 'p_partkey', f"({I.sql_list(_CHECKS)})[p_partkey % 4 + 1]")} FROM part""")
def normalise_semgrep(spark, sf):
    report = I.text('{"results":[{"path":"f', K(), '.py","check_id":"', I.pick(_CHECKS, K() % 4), '","extra":{"severity":"', I.pick(["high", "Low", "ERROR"], K() % 3), '","message":"m', K(), '"},"start":{"line":', K(), ',"col":3}}]}')
    return N.normalize("semgrep", SR.parse_semgrep(_reports(spark, sf, report)))


@query("normalise_native", "project_id s, file s, seq l, tool s, line l, rule s", f"""{FS} SELECT project_id, file, seq, 'codeaudit' AS tool, line, rule FROM findings WHERE severity <> 'INFO'""")
def normalise_native(spark, sf):
    raw = I.raw_findings(spark, sf).withColumn("message", F.when(F.col("severity") != "INFO", F.col("message")))
    return N.normalize_native(raw)
