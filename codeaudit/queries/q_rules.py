"""Rule scan queries: code derived from orders, whole documents, deployment files from customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeaudit.operators import discovery as D
from codeaudit.operators.rules import aimodel, bugs, efficiency, resources, security
from codeaudit.operators.scan_rules import scan_rules
from codeaudit.queries import inputs as I
from codeaudit.queries.inputs import quote
from codeaudit.queries.registry import query, table

COLUMNS = "project_id s, file s, line l, rule s, severity s, category s, message s, fingerprint s"


def any_of(patterns: list[str], text: str = "text") -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {quote(p)})" for p in patterns) + ")"


def has_rule(packs: str, rule: str, which: int = 0):
    rules = {"security": security, "bugs": bugs, "efficiency": efficiency, "resources": resources, "model": aimodel}[packs].RULES
    return [r for r in rules if r.rule == rule][which]


def chain(*branches: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {quote(rule)}" for rule, test in branches) + " END"


def rule_rows(source: str, groups: list[str], category: str, severities: dict[str, str], messages: dict[str, str], where: str = "TRUE") -> str:
    """SELECT with one row per line and rule that fires."""
    sev = "CASE rule " + " ".join(f"WHEN {quote(r)} THEN {quote(v)}" for r, v in severities.items()) + " END"
    msg = "CASE rule " + " ".join(f"WHEN {quote(r)} THEN {quote(v)}" for r, v in messages.items()) + " END"
    return f"""
    SELECT project_id, file, line, rule, {sev} AS severity, '{category}' AS category, {msg} AS message,
           substr(sha256(file || ':' || line || ':{category}'), 1, 16) AS fingerprint
    FROM (SELECT project_id, file, line, unnest([{", ".join(groups)}]) AS rule FROM {source} WHERE {where})
    WHERE rule IS NOT NULL"""


def security_groups() -> list[str]:
    P = security.PATTERNS
    js, py = "NOT is_py AND ", "is_py AND "
    secret_free = " AND ".join(f"NOT contains(text, {quote(w)})" for w in security.SECRET_EXEMPTIONS)
    traversal = f"({any_of(P['path-traversal'])} OR ({any_of(P['path-traversal-file'])} AND contains(text, 'file')))"
    return [
        chain(*[(r, js + any_of(P[r])) for r in ("sql-injection-template", "sql-injection-concat")]),
        chain(("code-injection-eval", js + any_of(P["code-injection-eval"]) +
               " AND NOT contains(text, '//') AND NOT contains(text, 'typeof eval')"),
              ("code-injection-function", js + any_of(P["code-injection-function"]))),
        chain(("path-traversal", js + traversal)),
        *[chain((r, js + any_of(P[r]))) for r in (
            "command-injection", "weak-crypto-hash", "prototype-pollution", "xss-dangerously-set-inner-html")],
        chain(*[(r, py + any_of(P[r])) for r in ("py-sql-injection-fstring", "py-sql-injection-concat")]),
        *[chain((r, py + any_of(P[r]))) for r in ("py-code-injection", "py-command-injection", "py-weak-crypto-hash")],
        chain(("hardcoded-aws-key", any_of(P["hardcoded-aws-key"])), ("hardcoded-github-token", any_of(P["hardcoded-github-token"])),
              ("hardcoded-secret", any_of(P["hardcoded-secret"]) + " AND " + secret_free)),
    ]


def security_sql(ctes: str) -> str:
    rules = security.RULES
    return f"WITH {ctes}" + rule_rows(
        "code_lines", security_groups(), "security", {r.rule: r.severity for r in rules}, {r.rule: r.message for r in rules},
        "t <> '' AND NOT starts_with(t, '//') AND NOT starts_with(t, '#')")


@query("security_rules_on_code", COLUMNS, security_sql(I.CODE_FILES_SQL))
def security_rules_on_code(spark, sf):
    return scan_rules(I.code_files(spark, sf), ["security"])


@query("security_rules_on_documents", COLUMNS, security_sql(I.DOCUMENT_FILES_SQL))
def security_rules_on_documents(spark, sf):
    return scan_rules(I.document_files(spark, sf), ["security"])


_B = bugs
_LOOSE = ("contains(t, '==') AND NOT contains(t, '===') AND NOT contains(t, '!==') AND regexp_matches(t, '[^!=<>]==') "
          "AND NOT contains(substr(t, 1, 80), '//') AND NOT contains(substr(t, 1, 80), '*')")
_SINGLE_R, _SINGLE_L = quote(_B.SINGLETON_RIGHT), quote(_B.SINGLETON_LEFT)
_TARGET = f"coalesce(nullif(regexp_extract(t, {_SINGLE_R}, 3), ''), regexp_extract(t, {_SINGLE_L}, 1))"
_OP = f"coalesce(nullif(regexp_extract(t, {_SINGLE_R}, 2), ''), regexp_extract(t, {_SINGLE_L}, 2))"
_WORD = f"CASE WHEN {_OP} = '!=' THEN 'is not' ELSE 'is' END"


NONE_NAME, NONE_RULE, BOOL_RULE = "None", "E711", "E712"


def bug_line_sql(ctes: str) -> str:
    single = f"(regexp_matches(t, {_SINGLE_R}) OR regexp_matches(t, {_SINGLE_L}))"
    always = ["Always-true condition (if (true))", "Always-false condition (if (false))",
              "Infinite loop (while (true)) — verify intentional", "Dead code — while (false) never executes"]
    always_case = "CASE " + " ".join(
        f"WHEN regexp_matches(t, {quote(p)}) THEN {{'rule': 'always-true-false', 'severity': 'MEDIUM', 'message': {quote(m)}}}"
        for p, m in zip(_B.ALWAYS_PATTERNS, always)) + " END"

    def one(rule: str, severity: str, message: str) -> str:
        return f"{{'rule': {rule}, 'severity': '{severity}', 'message': {message}}}"

    hits = [
        f"CASE WHEN {any_of(_B.SWALLOWED_PATTERNS, 't')} THEN {one(quote('swallowed-error'), 'MEDIUM', quote('Error is caught but appears to be silently ignored'))} END",
        f"CASE WHEN NOT is_py AND {any_of(_B.ASSIGN_JS_PATTERNS, 't')} THEN {one(quote('assignment-in-condition'), 'HIGH', quote('Assignment in condition — likely should be comparison (===)'))} "
        f"WHEN is_py AND {any_of(_B.ASSIGN_PY_PATTERNS, 't')} THEN {one(quote('assignment-in-condition'), 'HIGH', quote('Assignment in condition — likely should be comparison (==)'))} END",
        f"CASE WHEN is_py AND {single} THEN {one(f'CASE WHEN {_TARGET} = {quote(NONE_NAME)} THEN {quote(NONE_RULE)} ELSE {quote(BOOL_RULE)} END', 'LOW', _MSG)} "
        f"WHEN NOT is_py AND {_LOOSE} THEN {one(quote('loose-equality'), 'LOW', quote('Loose equality (==) used instead of strict equality (===)'))} END",
        f"CASE WHEN {any_of(_B.OFF_BY_ONE_PATTERNS, 't')} THEN {one(quote('off-by-one'), 'HIGH', quote('Potential off-by-one loop boundary error'))} END",
        always_case,
    ]
    return f"""WITH {ctes}
    SELECT project_id, file, line, h.rule AS rule, h.severity AS severity, 'bugs' AS category, h.message AS message,
           substr(sha256(file || ':' || line || ':bugs'), 1, 16) AS fingerprint
    FROM (SELECT project_id, file, line, unnest([{', '.join(hits)}]) AS h FROM code_lines WHERE t <> '') WHERE h IS NOT NULL"""


_MSG = f"'Comparison to ' || {_TARGET} || ' should use ''' || {_WORD} || ''' rather than ''' || {_OP} || ''''"
LINE_BUGS = ["swallowed-error", "assignment-in-condition", "E711", "E712", "loose-equality", "off-by-one", "always-true-false"]


@query("bug_line_rules", COLUMNS, bug_line_sql(I.CODE_FILES_SQL))
def bug_line_rules(spark, sf):
    return scan_rules(I.code_files(spark, sf), ["bugs"]).filter(F.col("rule").isin(LINE_BUGS))


@query("bug_line_rules_on_documents", COLUMNS, bug_line_sql(I.DOCUMENT_FILES_SQL))
def bug_line_rules_on_documents(spark, sf):
    return scan_rules(I.document_files(spark, sf), ["bugs"]).filter(F.col("rule").isin(LINE_BUGS))


# ---- context rules: folds in Spark, window frames and joins of lines in SQL ----
_BRACES = "(length({x}) - length(replace({x}, '{{', ''))) - (length({x}) - length(replace({x}, '}}', '')))"
_LOOP = quote(efficiency.LOOP)

CONTEXT_SQL = f"""WITH {I.CODE_FILES_SQL},
numbered AS (SELECT *, {_BRACES.format(x='text')} AS delta FROM code_lines),
ahead AS (  -- each trigger line with the lines behind it
  SELECT a.project_id, a.file, a.is_py, a.line, a.text AS head, a.t AS head_t, a.delta AS head_delta, b.line AS pos, b.text, b.t, b.delta,
         sum(b.delta) OVER w AS depth
  FROM numbered a JOIN numbered b ON a.project_id = b.project_id AND a.file = b.file AND b.line > a.line AND b.line <= a.line + 99
  WHERE regexp_matches(a.t, {_LOOP}) OR contains(a.text, 'catch') OR starts_with(a.t, 'if')
  WINDOW w AS (PARTITION BY a.project_id, a.file, a.line ORDER BY b.line)),
catches AS (
  SELECT project_id, file, line, min(pos) AS closes FROM ahead
  WHERE regexp_matches(head, {quote(_B.CATCH_OPEN)}) AND pos <= line + 9 AND 1 + depth <= 0 GROUP BY ALL),
empty_catch AS (
  SELECT a.project_id, a.file, a.line, string_agg(a.t, ' ' ORDER BY a.pos) AS body
  FROM ahead a JOIN catches c ON a.project_id = c.project_id AND a.file = c.file AND a.line = c.line AND a.pos <= c.closes GROUP BY ALL),
prior AS (
  SELECT *, last_value(CASE WHEN t <> '' AND NOT starts_with(t, '//') AND NOT starts_with(t, '/*') AND NOT starts_with(t, '*')
                            THEN {{'t': t, 'indent': length(text) - length(ltrim(text))}} END IGNORE NULLS)
     OVER (PARTITION BY project_id, file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM numbered),
conditions AS (
  SELECT *, trim(regexp_extract(head_t, {quote(_B.IF_CONDITION)}, 1)) AS cond,
         regexp_matches(t, {quote(_B.ELSE_IF_CONDITION)}) AS is_else_if, trim(regexp_extract(t, {quote(_B.ELSE_IF_CONDITION)}, 1)) AS other
  FROM ahead WHERE regexp_matches(head_t, {quote(_B.IF_CONDITION)})),
stops AS (
  SELECT project_id, file, line, min(CASE WHEN is_else_if AND cond = other THEN pos END) AS same,
         min(CASE WHEN NOT is_else_if AND (t = '}}' OR starts_with(t, 'if')) THEN pos END) AS stop FROM conditions GROUP BY ALL),
nested AS (
  SELECT *, bool_or(regexp_matches(t, {_LOOP})) OVER w AS inner_loop, min(depth) OVER w AS low FROM ahead
  WHERE NOT is_py AND regexp_matches(head_t, {_LOOP}) AND pos <= line + 29
  WINDOW w AS (PARTITION BY project_id, file, line ORDER BY pos)),
bodies AS (
  SELECT *, min(head_delta + depth) OVER (PARTITION BY project_id, file, line ORDER BY pos) AS low FROM ahead
  WHERE NOT is_py AND regexp_matches(head_t, {_LOOP}) AND pos <= line + 29),
traversals AS (
  SELECT project_id, file, line, regexp_extract(text, {quote(efficiency.TRAVERSAL)}, 1) AS name FROM numbered
  WHERE NOT is_py AND regexp_matches(text, {quote(efficiency.TRAVERSAL)})),
repeated AS (
  SELECT v.project_id, v.file, v.line, v.name, count(*) AS n FROM traversals v JOIN numbered b
    ON v.project_id = b.project_id AND v.file = b.file AND b.line BETWEEN v.line - 5 AND v.line + 9
   AND (contains(b.text, v.name || '.filter(') OR contains(b.text, v.name || '.map(') OR contains(b.text, v.name || '.reduce(') OR contains(b.text, v.name || '.find('))
  GROUP BY ALL),
opens AS (
  SELECT *, lag(text) OVER w AS above, coalesce(bool_or(contains(text, '.close()')) OVER (PARTITION BY project_id, file ORDER BY line
            ROWS BETWEEN 1 FOLLOWING AND 19 FOLLOWING), FALSE) AS closed FROM numbered WINDOW w AS (PARTITION BY project_id, file ORDER BY line)),
timers AS (
  SELECT *, max(CASE WHEN regexp_matches(t, {_LOOP}) THEN line END) OVER (w ROWS UNBOUNDED PRECEDING) AS armed,
         max(CASE WHEN t = '}}' OR regexp_matches(t, 'setTimeout\\s*\\(') THEN line END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS disarmed
  FROM numbered WHERE NOT is_py WINDOW w AS (PARTITION BY project_id, file ORDER BY line)),
sinks AS (
  SELECT *, bool_or(regexp_matches(text, {quote(aimodel.SOURCE)})) OVER (PARTITION BY project_id, file ORDER BY line ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS near
  FROM numbered WHERE regexp_matches(content, {quote(D.AI_KEYWORDS)}))
SELECT project_id, file, line, 'empty-catch' AS rule, 'Empty catch block swallows errors silently' AS message FROM empty_catch
 WHERE trim(regexp_replace(regexp_replace(body, '//.*$', ''), '/\\*.*?\\*/', '', 'gs')) IN ('', '}}')
UNION ALL SELECT project_id, file, line, 'unreachable-code', 'Code appears to be unreachable after return/throw/break/continue' FROM prior
 WHERE t <> '' AND NOT starts_with(t, '//') AND NOT starts_with(t, '/*') AND t NOT IN ('}}', '{{') AND NOT starts_with(t, '@')
   AND NOT regexp_matches(t, {quote(_B.DECLARATION)}) AND length(text) - length(ltrim(text)) >= p.indent
   AND regexp_matches(p.t, {quote(_B.TERMINATOR)}) AND NOT ends_with(p.t, '{{') AND NOT ends_with(p.t, ',')
UNION ALL SELECT project_id, file, line, 'duplicate-condition', 'Duplicate condition in if/else-if chain' FROM stops WHERE same IS NOT NULL AND (stop IS NULL OR same < stop)
UNION ALL SELECT DISTINCT project_id, file, line, 'nested-loop-search', 'O(n²) pattern: array search method inside nested loop' FROM nested
 WHERE low >= 0 AND inner_loop AND regexp_matches(t, {quote(efficiency.SEARCH_CALL)})
UNION ALL SELECT DISTINCT project_id, file, line, 'string-concat-loop', 'String concatenation with += in loop body may be inefficient' FROM bodies
 WHERE low > 0 AND regexp_matches(text, {quote(efficiency.STRING_APPEND)})
UNION ALL SELECT DISTINCT project_id, file, line, 'regex-in-loop', 'Regex compilation inside loop — compile once outside the loop' FROM bodies
 WHERE low > 0 AND regexp_matches(text, {quote(efficiency.NEW_REGEXP)})
UNION ALL SELECT project_id, file, line, 'repeated-array-traversal', 'Array "' || name || '" traversed ' || n || ' times in close proximity' FROM repeated WHERE n >= 3
UNION ALL SELECT project_id, file, line, 'py-open-no-with', 'File opened without "with" statement — resource may not be properly closed' FROM opens
 WHERE is_py AND regexp_matches(t, {quote(resources.OPEN_CALL)}) AND NOT starts_with(t, 'with ') AND NOT closed
   AND NOT (length(text) > length(ltrim(text)) AND coalesce(regexp_matches(above, 'with\\s+'), FALSE))
UNION ALL SELECT project_id, file, line, 'timeout-accumulation', 'setTimeout inside loop — timers accumulate and may cause resource issues' FROM timers
 WHERE regexp_matches(t, 'setTimeout\\s*\\(') AND armed IS NOT NULL AND (disarmed IS NULL OR armed > disarmed)
UNION ALL SELECT project_id, file, min(line), 'modelshield-agent-code-exec', {quote(aimodel.RULES[aimodel.AGENT].message)} FROM sinks
 WHERE near AND regexp_matches(text, {quote(aimodel.SINK)}) GROUP BY project_id, file
"""
CONTEXT_RULES = ["empty-catch", "unreachable-code", "duplicate-condition", "nested-loop-search", "string-concat-loop", "regex-in-loop",
                 "repeated-array-traversal", "py-open-no-with", "timeout-accumulation", "modelshield-agent-code-exec"]


@query("context_rules", "project_id s, file s, line l, rule s, message s", CONTEXT_SQL)
def context_rules(spark, sf):
    return scan_rules(I.code_files(spark, sf), ["bugs", "efficiency", "resources", "model"]).filter(F.col("rule").isin(CONTEXT_RULES))


_NAMES = "list_transform(string_split({x}, ','), lambda n: coalesce(nullif(regexp_extract(n, '(\\w+)(?:\\s+as\\s+(\\w+))?', 2), ''), regexp_extract(n, '(\\w+)', 1)))"
_BUILTINS = "[" + ", ".join(quote(b) for b in _B.PYTHON_BUILTINS) + "]"
_FLASK = "[" + ", ".join(quote(b) for b in _B.FLASK_FUNCTIONS) + "]"
_SKIP = " OR ".join(f"starts_with(t, {quote(p)})" for p in ("#", "import ", "from ", "def ", "class ", "@"))
PYTHON_SQL = f"""WITH {I.CODE_FILES_SQL},
py AS (SELECT * FROM code_lines WHERE is_py),
bound AS (
  SELECT project_id, file, unnest({_NAMES.format(x="regexp_extract(t, '^import\\s+(.+)', 1)")}) AS name FROM py WHERE regexp_matches(t, '^import\\s+[^(]')
  UNION ALL SELECT project_id, file, unnest({_NAMES.format(x="regexp_extract(t, '^from\\s+\\S+\\s+import\\s+(.+)', 1)")}) FROM py WHERE regexp_matches(t, '^from\\s+\\S+\\s+import\\s')
  UNION ALL SELECT project_id, file, regexp_extract(t, '^(?:def|class)\\s+(\\w+)', 1) FROM py WHERE regexp_matches(t, '^(?:def\\s+\\w+\\s*\\([^)]*\\)|class\\s+\\w)')
  UNION ALL SELECT project_id, file, regexp_extract(trim(unnest(string_split(regexp_extract(t, '^def\\s+\\w+\\s*\\(([^)]*)\\)', 1), ','))), '^\\**(\\w+)', 1) FROM py
  UNION ALL SELECT project_id, file, regexp_extract(t, '^(\\w+)\\s*=', 1) FROM py
  UNION ALL SELECT project_id, file, regexp_extract(t, '^for\\s+(\\w+)\\s+in\\b', 1) FROM py
  UNION ALL SELECT project_id, file, regexp_extract(t, '\\bas\\s+(\\w+)\\s*:', 1) FROM py
  UNION ALL SELECT project_id, file, regexp_extract(t, '^@(\\w+)', 1) FROM py),
defined AS (SELECT project_id, file, list(DISTINCT name) AS names FROM bound GROUP BY ALL),
calls AS (  -- a blank behind each parenthesis, so that neighbouring calls do not share a character
  SELECT project_id, file, line, 0 AS sub, regexp_extract_all(replace(split_part(t, '#', 1), '(', '( '),
         '(?:^|[^.\\w])([a-zA-Z_]\\w*)\\.(?:execute|query|run|send|close|commit|rollback|fetchone|fetchall|cursor|connect)\\s*\\(', 1) AS names
  FROM py WHERE t <> '' AND NOT ({_SKIP})
  UNION ALL SELECT project_id, file, line, 1, regexp_extract_all(replace(split_part(t, '#', 1), '(', '( '), '(?:^|[^.\\w])([a-zA-Z_]\\w*)\\s*\\(', 1)
  FROM py WHERE t <> '' AND NOT ({_SKIP})),
unknown AS (
  SELECT c.project_id, c.file, c.line, list_filter(c.names, lambda n: NOT list_contains(coalesce(d.names, []), n) AND NOT list_contains({_BUILTINS}, n))[1] AS name
  FROM calls c LEFT JOIN defined d ON c.project_id = d.project_id AND c.file = d.file),
used AS (SELECT DISTINCT project_id, file, unnest(regexp_extract_all(t, '\\w+')) AS word FROM py WHERE NOT starts_with(t, 'import ') AND NOT starts_with(t, 'from ')),
imported AS (
  SELECT project_id, file, line, regexp_extract(t, '^import\\s+(\\w+)', 1) AS module,
         coalesce(nullif(regexp_extract(t, '^import\\s+\\w+\\s+as\\s+(\\w+)', 1), ''), regexp_extract(t, '^import\\s+(\\w+)', 1)) AS name
  FROM py WHERE regexp_matches(t, '^import\\s+\\w+(?:\\s+as\\s+\\w+)?$')
  UNION ALL SELECT project_id, file, line, regexp_extract(n, '(\\w+)', 1), coalesce(nullif(regexp_extract(n, '\\s+as\\s+(\\w+)', 1), ''), regexp_extract(n, '(\\w+)', 1))
  FROM (SELECT project_id, file, line, unnest(string_split(regexp_extract(t, '^from\\s+\\S+\\s+import\\s+(.+)', 1), ',')) AS n FROM py WHERE regexp_matches(t, '^from\\s+\\S+\\s+import\\s'))),
flask AS (
  SELECT project_id, file, line, t, unnest({_FLASK}) AS fn FROM py
  WHERE (contains(content, 'from flask') OR contains(content, 'import flask')) AND t <> '' AND NOT starts_with(t, '#') AND NOT starts_with(t, 'import') AND NOT starts_with(t, 'from'))
SELECT project_id, file, line, 'undefined-variable' AS rule, 'Undefined variable ''' || name || ''' — name is not defined in this scope' AS message FROM unknown WHERE name IS NOT NULL
UNION ALL SELECT i.project_id, i.file, i.line, 'F401', '''' || module || ''' imported but unused' FROM imported i
 WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.project_id = i.project_id AND u.file = i.file AND u.word = i.name)
UNION ALL SELECT f.project_id, f.file, f.line, 'missing-import', '''' || fn || ''' is used but not imported from ''flask''' FROM flask f
 WHERE list_contains(regexp_extract_all(t, '(\\w+)\\s*\\(', 1), fn)
   AND NOT EXISTS (SELECT 1 FROM imported i WHERE i.project_id = f.project_id AND i.file = f.file AND i.name = f.fn)
"""


@query("python_name_rules", "project_id s, file s, line l, rule s, message s", PYTHON_SQL)
def python_name_rules(spark, sf):
    return scan_rules(I.code_files(spark, sf), ["bugs"]).filter(F.col("rule").isin("undefined-variable", "F401", "missing-import"))


def _position(p: str) -> str:
    return f"length(regexp_extract(text, '^(.*?)' || {quote(p)}, 1)) + 1"


_LEAKS = [
    ("setinterval-no-clear", "HIGH", resources.SET_INTERVAL, "NOT contains(content, 'clearInterval(') AND NOT contains(content, 'clearTimeout(')"),
    ("listener-no-remove", "MEDIUM", resources.ADD_LISTENER, "NOT contains(content, '.removeEventListener(')"),
    ("stream-no-close", "MEDIUM", r"fs\.create(?:Read|Write)Stream\s*\(", "NOT coalesce(closes, FALSE)"),
]
RESOURCE_SQL = f"""WITH {I.CODE_FILES_SQL},
closing AS (SELECT project_id, file, bool_or((contains(text, '.close(') OR contains(text, '.destroy(')) AND NOT starts_with(t, '//')
            AND NOT starts_with(t, '/*') AND NOT starts_with(t, '*')) AS closes FROM code_lines GROUP BY ALL),
marked AS (SELECT l.*, closes FROM code_lines l JOIN closing c USING (project_id, file)),
named AS (
  SELECT project_id, file, line, content, kind, name FROM (
    SELECT *, 'Map/Set' AS kind, regexp_extract(text, {quote(resources.COLLECTION_PATTERNS[0][0])}, 1) AS name FROM code_lines
    UNION ALL SELECT *, 'object', regexp_extract(text, {quote(resources.COLLECTION_PATTERNS[1][0])}, 1) FROM code_lines) WHERE name <> '')
""" + " UNION ALL ".join(
    f"SELECT project_id, file, line, {_position(p)} AS \"column\", '{r}' AS rule, '{s}' AS severity, "
    f"{quote(has_rule('resources', r).message)} AS message FROM marked WHERE NOT is_py AND regexp_matches(text, {quote(p)}) AND {absent}"
    for r, s, p, absent in _LEAKS) + """
UNION ALL SELECT project_id, file, line, NULL, 'unbounded-cache', 'LOW',
  'Collection "' || name || '" (' || kind || ') has no apparent eviction — potential unbounded growth' FROM named
 WHERE NOT contains(content, name || '.delete(') AND NOT contains(content, name || '.clear(') AND NOT contains(content, 'LRU') AND NOT contains(content, 'lru')
""" + f"""UNION ALL SELECT project_id, file, line, NULL, 'sync-in-async', 'MEDIUM', 'Synchronous filesystem call may block the event loop'
 FROM code_lines WHERE NOT is_py AND regexp_matches(t, {quote(efficiency.SYNC_CALL)})"""


@query("resource_rules", "project_id s, file s, line l, column l, rule s, severity s, message s", RESOURCE_SQL)
def resource_rules(spark, sf):
    kept = ["setinterval-no-clear", "listener-no-remove", "stream-no-close", "unbounded-cache", "sync-in-async"]
    return scan_rules(I.code_files(spark, sf), ["resources", "efficiency"]).filter(F.col("rule").isin(kept))


_M = aimodel.PATTERNS
_LOAD = r"(?i)(?:pickle\.loads?\(|joblib\.load\()"
MODEL_SQL = f"""WITH {I.CODE_FILES_SQL},
hits AS (SELECT project_id, file, line, unnest([
   CASE WHEN regexp_matches(text, {quote(_M[aimodel.PROMPT])}) THEN 'modelshield-prompt-injection' END,
   CASE WHEN regexp_matches(text, {quote(_LOAD)}) OR (regexp_matches(text, '(?i)torch\\.load\\(')
             AND NOT regexp_matches(text, '(?i)torch\\.load\\(.*weights_only\\s*=\\s*True')) THEN 'modelshield-unsafe-model-load' END,
   CASE WHEN regexp_matches(text, {quote(_M[aimodel.LEAK])}) THEN 'modelshield-pii-prompt-leak' END,
   CASE WHEN regexp_matches(text, {quote(_M[aimodel.RETRIEVAL])}) THEN 'modelshield-rag-retrieval-injection' END]) AS rule
  FROM code_lines WHERE regexp_matches(content, {quote(D.AI_KEYWORDS)}))
SELECT project_id, file, line, rule, 1 AS "column" FROM hits WHERE rule IS NOT NULL"""


@query("model_line_rules", "project_id s, file s, line l, rule s, column l", MODEL_SQL)
def model_line_rules(spark, sf):
    return scan_rules(I.code_files(spark, sf), ["model"]).filter(F.col("rule") != "modelshield-agent-code-exec")


DEPLOY_SQL = f"""WITH {I.DEPLOY_FILES_SQL},
roles AS (
  SELECT *, lower(regexp_extract(path, '[^/]*$')) AS base FROM deploy_files),
tests AS (
  SELECT project_id, path, base, content,
    base = 'dockerfile' OR ends_with(base, '.dockerfile') OR contains(base, 'containerfile') AS docker,
    contains(path, '.github/workflows') OR contains(path, '.gitlab-ci') AS ci,
    regexp_matches(base, '(server|app|index|config|settings)\\.(js|ts|py)$') AS config,
    base = '.env' OR (starts_with(base, '.env.') AND NOT contains(base, 'example') AND NOT contains(base, 'sample')) AS env FROM roles),
hits AS (SELECT project_id, path, unnest([
    CASE WHEN env THEN 'deployguard-committed-env' END,
    CASE WHEN docker AND len(list_filter(regexp_extract_all(content, '(?im)^\\s*USER\\s+(\\w+)', 1), lambda u: lower(u) <> 'root')) = 0 THEN 'deployguard-docker-root' END,
    CASE WHEN docker AND (regexp_matches(content, '(?im)^\\s*FROM\\s+[\\w.-]+(?:/[\\w.-]+)*:latest\\b') OR regexp_matches(content, '(?im)^\\s*FROM\\s+[a-zA-Z0-9_.-]+(?:/[a-zA-Z0-9_.-]+)*\\s*$')) THEN 'deployguard-docker-unpinned-tag' END,
    CASE WHEN docker AND regexp_matches(content, '(?im)^\\s*(?:ENV|ARG)\\s+(?:.*(?:SECRET|KEY|PASSWORD|TOKEN|AUTH|CREDENTIALS).*\\s*=\\s*[''"]?[a-zA-Z0-9_/+=.-]{{8,}}[''"]?)') THEN 'deployguard-docker-env-secret' END,
    CASE WHEN docker AND regexp_matches(regexp_replace(content, '(?i)ADD\\s+https?://', '', 'g'), '(?im)^\\s*ADD\\s') THEN 'deployguard-docker-add-directive' END,
    CASE WHEN ci AND regexp_matches(content, '(?i)uses:\\s+[\\w-]+/[\\w-]+@(main|master|latest)\\b') THEN 'deployguard-cicd-unpinned-action' END,
    CASE WHEN ci AND regexp_matches(content, '(?i)run:\\s+.*echo\\s+.*(?:\\$\\{{\\{{\\s*secrets\\.\\w+\\s*\\}}\\}}|\\$SECRET|\\$TOKEN)') THEN 'deployguard-cicd-secret-leak' END,
    CASE WHEN ci AND regexp_matches(content, '(?i)pull_request_target') AND regexp_matches(content, '(?i)actions/checkout') AND contains(content, 'github.event.pull_request.head.sha') THEN 'deployguard-cicd-pr-target' END,
    CASE WHEN config AND regexp_matches(content, '(?i)(?:DEBUG\\s*=\\s*(?:True|1)|app\\.debug\\s*=\\s*True|NODE_ENV\\s*=\\s*[''"]development[''"])') AND NOT regexp_matches(content, '(?i)test|fixture|spec') THEN 'deployguard-production-debug' END,
    CASE WHEN config AND regexp_matches(content, '(?is)(?:origin:\\s*[''"]\\*[''"]|allow_origins=\\[[''"]\\*[''"]\\]).*credentials:\\s*true') THEN 'deployguard-permissive-cors' END,
    CASE WHEN config AND regexp_matches(content, 'express\\(\\)|FastAPI\\(\\)|Flask\\(__name__\\)') AND NOT regexp_matches(content, '(?i)(helmet|SecurityMiddleware|Talisman)') THEN 'deployguard-missing-security-headers' END]) AS rule FROM tests)
SELECT project_id, path AS file, 1 AS line, 1 AS "column", rule, substr(sha256('codeaudit:' || path || ':1:' || rule), 1, 16) AS id FROM hits WHERE rule IS NOT NULL"""


@query("deployment_rules", "project_id s, file s, line l, column l, rule s, id s", DEPLOY_SQL)
def deployment_rules(spark, sf):
    return scan_rules(I.deploy_files(spark, sf), ["deploy"])


# ---- discovery ---------------------------------------------------------------
_FOLDERS = ["src", "node_modules/pkg", ".git", "lib/.hidden", "dist/js", "docs", "a/b/c/d/e/f/g/h/i/j/k", "build", "app/vendor/x", "tests"]
_FILES = ["app.js", "view.TSX", "main.py", "logo.PNG", "data.json", "mod.mjs", "run.pyw", "style.css", "types.d.cts", "Makefile"]


def listing(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(I.text("proj", I.div(k, 100)).alias("project_id"),
                    F.concat_ws("/", I.pick(_FOLDERS, k % 10), I.pick(_FILES, I.div(k, 10) % 10)).alias("path"), k.alias("key"))


_LISTING = f"""listing AS (SELECT 'proj' || (p_partkey // 100) AS project_id, p_partkey AS key,
  ({I.sql_list(_FOLDERS)})[p_partkey % 10 + 1] || '/' || ({I.sql_list(_FILES)})[p_partkey // 10 % 10 + 1] AS path FROM part)"""


@query("language_profile", "project_id s, language s, files l", f"""WITH {_LISTING},
kept AS (SELECT *, lower(regexp_extract(path, '\\.[^./]+$')) AS ext FROM listing
  WHERE NOT regexp_matches(path, '(^|/)(node_modules|vendor|dist|build|out|venv|coverage|__pycache__)/') AND NOT regexp_matches(path, '(^|/)\\.[^/]*/')
    AND len(string_split(path, '/')) - 1 <= 10)
SELECT project_id, CASE WHEN ext IN ('.js','.jsx','.mjs','.cjs') THEN 'javascript' WHEN ext IN ('.ts','.tsx','.mts','.cts') THEN 'typescript' ELSE 'python' END AS language, count(*) AS files
FROM kept WHERE ext IN ('.js','.jsx','.mjs','.cjs','.ts','.tsx','.mts','.cts','.py','.pyw') GROUP BY ALL""")
def language_profile(spark, sf):
    return D.language_profile(D.discover(listing(spark, sf)))


@query("ignore_filter", "project_id s, key l, path s", f"""WITH {_LISTING}
SELECT project_id, key, path FROM listing
WHERE NOT regexp_matches(path, '(^|/)(node_modules|\\.git|dist|build|__pycache__|\\.venv|venv|coverage|\\.next|\\.nuxt|vendor|\\.cache|\\.nyc_output)(/|$)')
  AND NOT regexp_matches(path, '^docs/[^/]*\\.css$') AND NOT regexp_matches(path, '^a/.*\\.py$') AND NOT regexp_matches(path, '(^|/)tests(/|$)')""")
def ignore_filter(spark, sf):
    return D.filter_ignored(listing(spark, sf), ["docs/*.css", "a/**.py", "tests/"])


@query("path_roles", "project_id s, path s, is_docker b, is_ci b, is_config b, is_env b, production b, analyzable b", f"""WITH {I.DEPLOY_FILES_SQL}
SELECT project_id, path, path IN ('Dockerfile', 'api.dockerfile', 'Containerfile') AS is_docker, path = '.github/workflows/ci.yml' AS is_ci,
  path IN ('server.js', 'app.py', 'settings.py', 'index.js') AS is_config, path = 'config/.env' AS is_env, TRUE AS production,
  path IN ('server.js', 'app.py', 'settings.py', 'index.js') AS analyzable FROM deploy_files""")
def path_roles(spark, sf):
    return D.with_file_roles(I.deploy_files(spark, sf)).withColumns({
        "production": D.is_production_path(F.col("path")), "analyzable": D.is_analyzable(F.col("path"))})


@query("canonical_paths", "key l, file s", """
SELECT p_partkey AS key, CASE p_partkey % 4 WHEN 0 THEN 'src/a' || p_partkey || '.js' WHEN 1 THEN 'lib/b' || p_partkey || '.py'
  WHEN 2 THEN 'c' || p_partkey || '.ts' ELSE 'win/d' || p_partkey || '.js' END AS file FROM part""")
def canonical_paths(spark, sf):
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, I.text("/work/proj/src/a", k, ".js")).when(k % 4 == 1, I.text("./lib/b", k, ".py")).when(
        k % 4 == 2, I.text(".//c", k, ".ts")).otherwise(I.text("win\\d", k, ".js"))
    return D.canonicalise_path(table(spark, sf, "part").select(k.alias("key"), raw.alias("file")), "/work/proj")
