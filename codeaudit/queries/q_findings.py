"""Finding construction, dedup, aggregation, scores, gates and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeaudit.functions.findings import build_findings, validate_findings
from codeaudit.operators import history as H
from codeaudit.operators import scoring as A
from codeaudit.operators.ordered import cap_per_rule
from codeaudit.operators.scan_rules import scan_rules
from codeaudit.queries import inputs as I
from codeaudit.queries.q_rules import security_groups, rule_rows
from codeaudit.operators.rules import security
from codeaudit.queries.registry import query, table

FS, DS = "WITH " + I.FINDINGS_SQL, "WITH " + I.DEDUPED_SQL


@query("finding_ids", "project_id s, seq l, id s, fingerprint s, category s, legacyCategory s, tool s, rule s", f"""{FS}
SELECT project_id, seq, id, fingerprint, category, CASE category WHEN 'security' THEN 'vulnerability' WHEN 'bugs' THEN 'bug'
  WHEN 'efficiency' THEN 'performance' ELSE 'resource' END AS legacyCategory, tool, rule FROM findings""")
def finding_ids(spark, sf):
    return I.findings(spark, sf)


@query("category_map", "name s, category s, legacyCategory s, findings l", """
SELECT name, CASE name WHEN 'bug' THEN 'bugs' WHEN 'vulnerability' THEN 'security' WHEN 'code-quality' THEN 'bugs'
    WHEN 'performance' THEN 'efficiency' WHEN 'resource' THEN 'resources' WHEN 'style' THEN 'bugs' ELSE name END AS category,
  CASE WHEN name IN ('bug','code-quality','style','bugs') THEN 'bug' WHEN name IN ('vulnerability','security') THEN 'vulnerability'
    WHEN name IN ('performance','efficiency') THEN 'performance' ELSE 'resource' END AS legacyCategory, count(*) AS findings
FROM (SELECT (['bug','vulnerability','code-quality','performance','resource','style','security','bugs','efficiency','resources'])[l_orderkey % 10 + 1] AS name FROM lineitem)
GROUP BY ALL""")
def category_map(spark, sf):
    names = ["bug", "vulnerability", "code-quality", "performance", "resource", "style", "security", "bugs", "efficiency", "resources"]
    raw = I.raw_findings(spark, sf).withColumn("name", I.pick(names, F.floor(F.col("seq") / 1_000_000) % 10))
    built = build_findings(raw.withColumn("category", F.col("name")).withColumn("message", F.col("name")))
    return built.groupBy(F.col("message").alias("name"), "category", "legacyCategory").agg(F.count("*").alias("findings"))


@query("validate_findings", "reject_reason s, findings l", """
SELECT CASE WHEN l_linenumber = 1 THEN 'invalid severity' WHEN l_linenumber = 2 THEN 'invalid tool' WHEN l_linenumber = 3 THEN 'missing message'
  WHEN l_linenumber = 4 THEN 'invalid category' ELSE 'valid' END AS reject_reason, count(*) AS findings FROM lineitem GROUP BY ALL""")
def validate_findings_query(spark, sf):
    n = F.floor(F.col("seq") / 100_000) % 10
    raw = I.raw_findings(spark, sf)
    raw = raw.withColumns({
        "severity": F.when(n == 1, "URGENT").otherwise(F.col("severity")), "tool": F.when(n == 2, "grep").otherwise(F.col("tool")),
        "message": F.when(n == 3, "").otherwise(F.col("message")), "category": F.when(n == 4, "misc").otherwise(F.col("category"))})
    valid, rejects = validate_findings(raw)
    both = valid.withColumn("reject_reason", F.lit("valid")).unionByName(rejects)
    return both.groupBy("reject_reason").agg(F.count("*").alias("findings"))


_F = "project_id, seq, id, severity, category, tool, file, line, rule, message, fingerprint"
_FC = "project_id s, seq l, id s, severity s, category s, tool s, file s, line l, rule s, message s, fingerprint s"


@query("dedupe_findings", _FC, f"{DS} SELECT {_F} FROM deduped")
def dedupe_findings(spark, sf):
    return A.dedupe_findings(I.findings(spark, sf))


@query("duplicate_groups", _FC + ", group_size l", f"""{FS}
SELECT {_F}, count(*) OVER (PARTITION BY project_id, fingerprint) AS group_size FROM findings QUALIFY group_size > 1""")
def duplicate_groups(spark, sf):
    return A.duplicate_groups(I.findings(spark, sf))


@query("aggregate_findings", "project_id s, dimension s, key s, findings l", f"""{DS},
levels AS (SELECT unnest(['BLOCKER','HIGH','MEDIUM','LOW','INFO']) AS severity),
sets AS (SELECT project_id, category, tool, file, count(*) AS n, grouping_id(category, tool, file) AS g FROM deduped
  GROUP BY GROUPING SETS ((project_id), (project_id, category), (project_id, tool), (project_id, file)))
SELECT project_id, CASE g WHEN 7 THEN 'total' WHEN 3 THEN 'category' WHEN 5 THEN 'tool' ELSE 'file' END AS dimension,
  CASE g WHEN 7 THEN 'total' WHEN 3 THEN category WHEN 5 THEN tool ELSE file END AS key, n AS findings FROM sets
UNION ALL
SELECT p.project_id, 'severity', l.severity, count(d.id) FROM (SELECT DISTINCT project_id FROM deduped) p CROSS JOIN levels l
  LEFT JOIN deduped d ON d.project_id = p.project_id AND d.severity = l.severity GROUP BY ALL""")
def aggregate_findings(spark, sf):
    return A.aggregate_findings(A.dedupe_findings(I.findings(spark, sf)))


_COUNTS = """count(*) AS total, count(*) FILTER (severity = 'BLOCKER') AS blocker, count(*) FILTER (severity = 'HIGH') AS high,
  count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (severity = 'INFO') AS info"""
_SCORE = """greatest(0, floor(100 - (10 * blocker + 5 * high + 2 * medium + low) / (total * 10.0) * 100 + 0.5))"""
_VERDICT = f"""CASE WHEN {_SCORE} >= 80 THEN 'PASS' WHEN {_SCORE} >= 50 THEN 'WARN' ELSE 'FAIL' END"""


@query("project_score", "project_id s, total l, score l, penalty l, max_penalty l, breakdown s, verdict s, verdict_message s", f"""{DS},
c AS (SELECT project_id, {_COUNTS} FROM deduped GROUP BY ALL)
SELECT project_id, total, {_SCORE} AS score, 10 * blocker + 5 * high + 2 * medium + low AS penalty, total * 10 AS max_penalty,
  concat_ws(',', CASE WHEN blocker > 0 THEN 'BLOCKER=' || (10 * blocker) END, CASE WHEN high > 0 THEN 'HIGH=' || (5 * high) END,
    CASE WHEN medium > 0 THEN 'MEDIUM=' || (2 * medium) END, CASE WHEN low > 0 THEN 'LOW=' || low END) AS breakdown, {_VERDICT} AS verdict,
  CASE {_VERDICT} WHEN 'PASS' THEN 'Codebase meets quality thresholds.' WHEN 'WARN' THEN 'Codebase has moderate issues that should be addressed.'
    ELSE 'Codebase has significant issues that must be resolved.' END AS verdict_message FROM c""")
def project_score(spark, sf):
    return A.project_score(A.dedupe_findings(I.findings(spark, sf)))


def _scan_sql(ctes: str) -> str:
    rules = security.RULES
    rows = rule_rows("code_lines", security_groups(), "security", {r.rule: r.severity for r in rules}, {r.rule: "" for r in rules},
                     "t <> '' AND NOT starts_with(t, '//') AND NOT starts_with(t, '#')")
    return f"""WITH {ctes}, hits AS ({rows}),
    best AS (SELECT project_id, fingerprint, min(list_position(['BLOCKER','HIGH','MEDIUM','LOW','INFO'], severity)) AS s FROM hits GROUP BY ALL),
    named AS (SELECT project_id, (['BLOCKER','HIGH','MEDIUM','LOW','INFO'])[s] AS severity FROM best),
    c AS (SELECT project_id, {_COUNTS} FROM named GROUP BY ALL),
    p AS (SELECT DISTINCT project_id FROM code_files)
    SELECT p.project_id, coalesce(total, 0) AS total, coalesce({_SCORE}, 100) AS score, coalesce({_VERDICT}, '') AS v,
      CASE WHEN total IS NULL THEN 'PASS' ELSE {_VERDICT} END AS verdict FROM p LEFT JOIN c USING (project_id)"""


@query("project_scan_score", "project_id s, total l, score l, verdict s", _scan_sql(I.CODE_FILES_SQL))
def project_scan_score(spark, sf):
    files = I.code_files(spark, sf)
    found = A.dedupe_findings(scan_rules(files, ["security"]))
    return A.project_score(found, files.select("project_id"))


_GATE = """SELECT project_id, count(*) FILTER (ok) AS total_issues, count(*) FILTER (ok AND severity = 'BLOCKER') AS blockers,
  count(*) FILTER (ok AND severity = 'HIGH') AS high, count(*) FILTER (ok AND severity = 'MEDIUM') AS medium,
  count(*) FILTER (ok AND severity = 'LOW') AS low, count(*) AS findings
  FROM (SELECT *, category = 'security' AND NOT regexp_matches(file, '(^|/)(tests?|fixtures|spec|node_modules)(/|$)') AS ok FROM deduped) GROUP BY ALL"""
_READY = "greatest(0, least(100, 100 - 30 * blockers - 15 * high - 5 * medium - 2 * low))"
_STATUS = f"CASE WHEN blockers > 0 OR {_READY} < 60 THEN 'BLOCKED' WHEN high > 0 OR {_READY} < 80 THEN 'WARNING' ELSE 'PASSED' END"


@query("deploy_readiness", "project_id s, total_issues l, blockers l, high l, medium l, low l, readiness_score l, readiness_status s", f"""{DS},
g AS ({_GATE}) SELECT *, {_READY} AS readiness_score, {_STATUS} AS readiness_status FROM g""")
def deploy_readiness(spark, sf):
    return A.deploy_readiness(A.dedupe_findings(I.findings(spark, sf)))


@query("gate_exit", "project_id s, exit_code l", f"""{DS},
g AS ({_GATE}) SELECT project_id, CASE WHEN {_STATUS} = 'BLOCKED' THEN 1 ELSE 0 END AS exit_code FROM g""")
def gate_exit(spark, sf):
    return A.gate_exit(A.deploy_readiness(A.dedupe_findings(I.findings(spark, sf))), gate_mode=True)


_COST = "CASE severity WHEN 'BLOCKER' THEN 25 WHEN 'HIGH' THEN 12 WHEN 'MEDIUM' THEN 5 ELSE 1 END"
_GRADE = "CASE WHEN {s} >= 95 THEN 'A+' WHEN {s} >= 88 THEN 'A' WHEN {s} >= 78 THEN 'B' WHEN {s} >= 65 THEN 'C' WHEN {s} >= 45 THEN 'D' ELSE 'F' END"


@query("risk_grade", "project_id s, file s, findings l, risk_penalty l, risk_score l, grade s", f"""{DS},
g AS (SELECT project_id, file, count(*) AS findings, sum({_COST}) AS risk_penalty FROM deduped GROUP BY ALL)
SELECT *, greatest(0, 100 - risk_penalty) AS risk_score, {_GRADE.format(s='greatest(0, 100 - risk_penalty)')} AS grade FROM g""")
def risk_grade(spark, sf):
    return A.risk_grade(A.dedupe_findings(I.findings(spark, sf)), ["project_id", "file"])


@query("category_breakdown", "project_id s, bucket s, findings l, penalty l", f"""{DS},
b AS (SELECT unnest(['security','bugs','efficiency','resources','modelshield','deployguard']) AS bucket)
SELECT p.project_id, b.bucket, count(d.id) AS findings, coalesce(sum({_COST}) FILTER (d.id IS NOT NULL), 0) AS penalty
FROM (SELECT DISTINCT project_id FROM deduped) p CROSS JOIN b LEFT JOIN deduped d ON d.project_id = p.project_id AND d.category = b.bucket GROUP BY ALL""")
def category_breakdown(spark, sf):
    return A.category_breakdown(A.dedupe_findings(I.findings(spark, sf)))


@query("severity_category_filter", _FC, f"{FS} SELECT {_F} FROM findings WHERE severity IN ('BLOCKER','HIGH','MEDIUM') AND category = 'bugs'")
def severity_category_filter(spark, sf):
    return A.category_filter(A.severity_threshold(I.findings(spark, sf), "MEDIUM"), "bugs")


@query("cap_per_rule", "category s, rule s, severity s, seq l, message s, truncated b", f"""{FS},
r AS (SELECT category, rule, 'HIGH' AS severity, seq, message, row_number() OVER (PARTITION BY category, rule ORDER BY seq, message) AS rn,
        count(*) OVER (PARTITION BY category, rule) AS n FROM findings)
SELECT category, rule, severity, seq, message, FALSE AS truncated FROM r WHERE rn <= 100
UNION ALL SELECT DISTINCT category, rule, severity, NULL, (n - 100) || ' additional ' || rule || ' finding(s) omitted', TRUE FROM r WHERE n > 100""")
def cap_per_rule_query(spark, sf):
    found = I.findings(spark, sf).select("category", "rule", F.lit("HIGH").alias("severity"), "seq", "message")
    return cap_per_rule(found, 100, ["category", "rule"], ["seq", "message"])


# ---- history -----------------------------------------------------------------

def scans(spark, sf):
    e = table(spark, sf, "events")
    score = (F.floor(F.col("value") % 100)).cast("int")
    return e.select(F.concat(F.lit("proj"), F.col("user_id").cast("string")).alias("project_id"), "ts", F.col("event_id").alias("seq"),
                    score.alias("score"), A.grade_of(score).alias("grade"), F.col("event_id").alias("findingsCount"))


_SCANS = f"""scans AS (SELECT 'proj' || user_id AS project_id, ts, event_id AS seq, CAST(floor(value % 100) AS INTEGER) AS score,
  {_GRADE.format(s='CAST(floor(value % 100) AS INTEGER)')} AS grade FROM events)"""


@query("score_trend", "project_id s, seq l, score l, grade s, previous_score l, previous_grade s, delta l, direction s, symbol s", f"""WITH {_SCANS},
p AS (SELECT *, lag(score) OVER w AS ps, lag(grade) OVER w AS pg FROM scans WINDOW w AS (PARTITION BY project_id ORDER BY ts, seq))
SELECT project_id, seq, score, grade, coalesce(ps, score) AS previous_score, coalesce(pg, grade) AS previous_grade, coalesce(score - ps, 0) AS delta,
  CASE WHEN ps IS NULL THEN 'baseline' WHEN score > ps THEN 'improved' WHEN score < ps THEN 'degraded' ELSE 'unchanged' END AS direction,
  CASE WHEN ps IS NULL THEN '● baseline' WHEN score > ps THEN '▲ +' || (score - ps) WHEN score < ps THEN '▼ ' || (score - ps) ELSE '■ 0' END AS symbol FROM p""")
def score_trend(spark, sf):
    return H.score_trend(scans(spark, sf))


@query("history_retention", "project_id s, seq l, score l, scope s", f"""WITH {_SCANS}
SELECT project_id, seq, score, 'project' AS scope FROM scans QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, seq DESC) <= 5
UNION ALL (SELECT project_id, seq, score, 'global' FROM scans ORDER BY ts DESC, seq DESC LIMIT 50)""")
def history_retention(spark, sf):
    own = H.retain_last(scans(spark, sf), 5, "project").withColumn("scope", F.lit("project"))
    return own.unionByName(H.retain_last(scans(spark, sf)).withColumn("scope", F.lit("global")))


_TEXTS = ["if (x == y) {", "if (x != y) {", "jwt.sign(user, 'secret')", 'db.query("SELECT a FROM t WHERE id = " + id)', "f = open(name)", "nothing here"]
_LRULES = ["loose-equality", "js-hardcoded-secret", "sql-injection-concat", "resource-leak", "other"]
_LEARNED = """
 CASE WHEN text = '' THEN CASE WHEN rule = 'loose-equality' THEN 'loose-equality' WHEN rule = 'js-hardcoded-secret' THEN 'hardcoded-jwt-secret'
     WHEN rule = 'sql-injection-concat' THEN 'sqli-string-concat' WHEN rule = 'resource-leak' THEN 'py-open-resource-leak' END
 WHEN text = 'if (x == y) {' AND (category = 'bugs' OR rule = 'loose-equality') THEN 'loose-equality'
 WHEN text = 'if (x != y) {' AND (category = 'bugs' OR rule = 'loose-equality') THEN 'loose-inequality'
 WHEN starts_with(text, 'jwt') AND (category = 'security' OR rule = 'js-hardcoded-secret') THEN 'hardcoded-jwt-secret'
 WHEN starts_with(text, 'db') AND (category = 'security' OR rule = 'sql-injection-concat') THEN 'sqli-string-concat'
 WHEN starts_with(text, 'f =') AND (category = 'resources' OR rule = 'resource-leak') THEN 'py-open-resource-leak' END"""
_PATCHES = """CASE WHEN text = '' THEN NULL ELSE CASE pattern_id WHEN 'loose-equality' THEN 'if (x === y) {' WHEN 'loose-inequality' THEN 'if (x !== y) {'
 WHEN 'hardcoded-jwt-secret' THEN 'jwt.sign(user, process.env.JWT_SECRET || "")' WHEN 'py-open-resource-leak' THEN 'with open(name) as f:'
 WHEN 'sqli-string-concat' THEN 'db.query("SELECT a FROM t WHERE id = "SELECT a FROM t WHERE id = ", [id])' END END"""


def _snippets(spark, sf):
    f = I.findings(spark, sf)
    n = F.floor(F.col("seq") / 1_000_000)
    rule = I.pick(_LRULES, n % 5)
    return f.withColumns({"rule": rule, "ruleId": rule, "snippet": I.pick([*_TEXTS, ""], n % 7)})


_SNIPPETS = f"""snips AS (SELECT project_id, seq, category, ({I.sql_list(_LRULES)})[seq // 1000000 % 5 + 1] AS rule, ({I.sql_list(_TEXTS + [''])})[seq // 1000000 % 7 + 1] AS text FROM findings),
matched AS (SELECT *, {_LEARNED} AS pattern_id FROM snips)"""


@query("learned_fix_match", "project_id s, seq l, rule s, pattern_id s, proposed_patch s, offline_resolvable b", f"""{FS}, {_SNIPPETS}
SELECT project_id, seq, rule, pattern_id, {_PATCHES} AS proposed_patch, pattern_id IS NOT NULL AS offline_resolvable FROM matched""")
def learned_fix_match(spark, sf):
    return H.match_learned_fix(_snippets(spark, sf), H.seed_patterns(spark))


@query("offline_resolvable_count", "project_id s, offline_resolvable l, findings l", f"""{FS}, {_SNIPPETS}
SELECT project_id, count(pattern_id) AS offline_resolvable, count(*) AS findings FROM matched GROUP BY ALL""")
def offline_resolvable_count(spark, sf):
    return H.offline_resolvable_count(H.match_learned_fix(_snippets(spark, sf), H.seed_patterns(spark)))


@query("learn_patterns", "ruleId s, signature s, category s, successCount l", """
WITH seeds AS (SELECT * FROM (VALUES ('loose-equality', '([a-zA-Z0-9_$.]+)\\s*==\\s*([a-zA-Z0-9_$.''"]+)', 'bugs', 15),
    ('loose-equality', '([a-zA-Z0-9_$.]+)\\s*!=\\s*([a-zA-Z0-9_$.''"]+)', 'bugs', 12),
    ('hardcoded-secret', 'jwt\\.sign\\([^,]+,\\s*[''"][^''"]+[''"]', 'security', 9),
    ('sql-injection', 'db\\.query\\(\\s*["'']SELECT .+ WHERE \\w+\\s*=\\s*[''"]\\s*\\+\\s*([a-zA-Z0-9_$.]+)', 'security', 8),
    ('resource-leak', '([a-zA-Z0-9_]+)\\s*=\\s*open\\(([^)]+)\\)', 'resources', 11)) v(ruleId, signature, category, successCount))
SELECT * FROM seeds UNION ALL
SELECT 'rule-' || (l_orderkey % 7), 'call\\(' || (l_partkey % 20) || '\\)', 'bugs', count(*) FROM lineitem WHERE l_linenumber <> 7 GROUP BY ALL""")
def learn_patterns(spark, sf):
    li = table(spark, sf, "lineitem")
    call = I.text("call(", F.col("l_partkey") % 20, ")")
    applied = li.select(I.text("rule-", F.col("l_orderkey") % 7).alias("ruleId"), F.lit("bugs").alias("category"), call.alias("original"),
                        F.when(F.col("l_linenumber") == 7, call).otherwise(F.concat(F.lit("safe_"), call)).alias("fixed"))
    return H.learn_patterns(H.seed_patterns(spark), applied)
