"""Prompt tables and response repair, over conversations, documents and derived code."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeaudit.operators import ai as AI
from codeaudit.operators.discovery import with_language
from codeaudit.queries import inputs as I
from codeaudit.queries.registry import query, table


def responses(spark, sf):
    """A model response per conversation turn: prose around a JSON object, in several states of repair."""
    c = table(spark, sf, "conversations")
    n = F.col("conv_id") * 10 + F.col("turn")
    ok = I.text('{"explanation":"e', n, '","severity":"HIGH","confidence":0.', n % 10, ',"falsePositiveProbability":0.', (n * 3) % 10, ',"impact":"i","suggestedFix":"f"}')
    body = (
        F.when(n % 6 == 0, ok).when(n % 6 == 1, F.lit('{"explanation":5,"severity":"high","confidence":"0.9"}'))
        .when(n % 6 == 2, F.lit('{"confidence":1.5,"falsePositiveProbability":-1,"impact":"","severity":"LOW"}')).when(n % 6 == 3, F.lit("no object here"))
        .when(n % 6 == 4, F.lit('{"explanation": broken}')).otherwise(I.text('{"a":{"b":1},"severity":"LOW"}', ok)))
    return c.select(n.alias("finding_id"), I.text("model-", n % 4).alias("model"), F.concat(F.replace("text", F.lit("{"), F.lit("(")), F.lit(" "), body, F.lit(" done")).alias("response"))


_N = "conv_id * 10 + turn"
_PARSED = f"""SELECT n AS finding_id, CASE WHEN n % 6 = 0 THEN 'e' || n ELSE 'AI analysis completed but explanation was not provided.' END AS explanation,
  CASE n % 6 WHEN 0 THEN 'HIGH' WHEN 2 THEN 'LOW' ELSE 'MEDIUM' END AS severity, CASE WHEN n % 6 = 0 THEN (n % 10) / 10.0 ELSE 0.5 END AS confidence,
  CASE WHEN n % 6 = 0 THEN (n * 3 % 10) / 10.0 ELSE 0.2 END AS "falsePositiveProbability", CASE WHEN n % 6 = 0 THEN 'i' ELSE 'Impact assessment requires manual review.' END AS impact
FROM (SELECT {_N} AS n FROM conversations) WHERE n % 6 IN (0, 1, 2)"""


@query("ai_response_repair", "finding_id l, explanation s, severity s, confidence d, falsePositiveProbability d, impact s", _PARSED)
def ai_response_repair(spark, sf):
    return AI.repair_responses(responses(spark, sf))[0].select("finding_id", "ai.*")


@query("ai_response_rejects", "finding_id l, model s", f"SELECT n AS finding_id, 'model-' || (n % 4) AS model FROM (SELECT {_N} AS n FROM conversations) WHERE n % 6 IN (3, 4, 5)")
def ai_response_rejects(spark, sf):
    return AI.repair_responses(responses(spark, sf))[1]


@query("ai_reconciliation", "finding_id l, rootCause s, severity s, reasoning s", f"""SELECT n AS finding_id, CASE WHEN n % 6 < 3 THEN 'Unable to determine root cause' ELSE 'Failed to parse correlation analysis' END AS "rootCause", 'MEDIUM' AS severity,
  CASE WHEN n % 6 < 3 THEN '' ELSE 'Failed to parse severity reconciliation' END AS reasoning FROM (SELECT {_N} AS n FROM conversations)""")
def ai_reconciliation(spark, sf):
    r = F.col("response")
    return responses(spark, sf).select("finding_id", AI.parse_correlation(r)["rootCause"].alias("rootCause"),
                                       AI.parse_reconciliation(r)["reconciledSeverity"].alias("severity"), AI.parse_reconciliation(r)["reasoning"].alias("reasoning"))


@query("ai_summary", "model s, findings l, high_confidence l, medium_confidence l, low_confidence l", f"""WITH p AS (SELECT 'model-' || (n % 4) AS model, CASE WHEN n % 6 = 0 THEN (n % 10) / 10.0 ELSE 0.5 END AS c FROM (SELECT {_N} AS n FROM conversations) WHERE n % 6 IN (0, 1, 2))
SELECT model, count(*) AS findings, count(*) FILTER (c >= 0.8) AS high_confidence, count(*) FILTER (c >= 0.5 AND c < 0.8) AS medium_confidence, count(*) FILTER (c < 0.5) AS low_confidence FROM p GROUP BY ALL""")
def ai_summary(spark, sf):
    parsed = AI.repair_responses(responses(spark, sf))[0].withColumn("confidence", F.col("ai.confidence"))
    return AI.ai_summary(parsed, [])


_MARK = "chr(10) || '... [truncated] ...'"


@query("truncate_context", "doc_id l, text s", f"""WITH c AS (SELECT doc_id, text, substr(text, 1, 1980) AS cut, length(substr(text, 1, 1980)) - length(regexp_extract(substr(text, 1, 1980), '[^\\n]*$')) - 1 AS last FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text WHEN last > 1980 * 0.8 THEN substr(cut, 1, last) || {_MARK} ELSE cut || {_MARK} END AS text FROM c""")
def truncate_context(spark, sf):
    return table(spark, sf, "documents").select("doc_id", AI.truncate_context(F.col("text"), 2000).alias("text"))


def _sites(spark, sf):
    files = I.code_files(spark, sf)
    line = (F.length("content") % 7 + 1).cast("int")
    found = files.select("project_id", F.col("path").alias("file"), line.alias("line"), F.lit("HIGH").alias("severity"), F.lit("bugs").alias("category"),
                         F.lit("r").alias("rule"), F.lit("m").alias("message"), F.lit(None).cast("string").alias("suggestedFix"))
    return found, files


_SITES = "sites AS (SELECT project_id, path AS file, length(content) % 7 + 1 AS line, string_split(content, chr(10)) AS l FROM code_files)"


@query("source_context", "project_id s, file s, line l, context s, prompt s", f"""WITH {I.CODE_FILES_SQL}, {_SITES},
x AS (SELECT project_id, file, line, array_to_string(l[greatest(line - 2, 1):line + 2], chr(10)) AS context FROM sites)
SELECT *, array_to_string(['You are a code analysis tool. Analyze this finding and respond ONLY with a JSON object.', 'Do not include any explanation before or after the JSON. Just the raw JSON object.', '', 'Finding:', '- Category: bugs', '- Severity: HIGH',
  '- File: ' || file, '- Line: ' || line, '- Rule: r', '- Message: m', ''], chr(10)) || chr(10) || CASE WHEN context <> '' THEN array_to_string(['Source code:', '```', context, '```', '', ''], chr(10)) ELSE '' END || 'Respond with this exact JSON structure:' || chr(10) ||
  '{{"explanation":"brief explanation","severity":"HIGH|MEDIUM|LOW","confidence":0.8,"falsePositiveProbability":0.1,"impact":"brief impact","suggestedFix":"brief fix"}}' AS prompt FROM x""")
def source_context(spark, sf):
    found, files = _sites(spark, sf)
    with_context = AI.source_context(found, files, radius=2)
    return AI.finding_prompts(with_context).withColumnRenamed("source_context", "context")


@query("line_snippet", "project_id s, file s, line l, snippet s", f"""WITH {I.CODE_FILES_SQL}, {_SITES},
x AS (SELECT project_id, file, line, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM sites)
SELECT s.project_id, s.file, s.line, coalesce(string_agg(x.i || CASE WHEN x.i = s.line THEN '>' ELSE ':' END || x.t, chr(10) ORDER BY x.i), '') AS snippet
FROM sites s LEFT JOIN x ON x.project_id = s.project_id AND x.file = s.file AND x.i BETWEEN s.line - 2 AND s.line + 2 GROUP BY ALL""")
def line_snippet(spark, sf):
    out = AI.line_snippet(*_sites(spark, sf))
    return out.withColumn("snippet", F.array_join(F.transform("snippet_lines", lambda r: F.concat(
        r["lineNum"].cast("string"), F.when(r["isTarget"], ">").otherwise(":"), r["text"])), "\n"))


@query("corpus_complexity", "project_id s, files l, languages l, lines l, complexity d, level s", f"""WITH {I.CODE_FILES_SQL},
c AS (SELECT project_id, count(*) AS files, count(DISTINCT regexp_extract(path, '\\.\\w+$')) AS languages, sum(len(string_split(content, chr(10)))) AS lines, bool_or(NOT path LIKE '%.js') AS hard FROM code_files GROUP BY ALL),
s AS (SELECT *, least(files / 50.0, 1) * 30 + least(languages / 3.0, 1) * 20 + least(lines / 5000.0, 1) * 30 + CASE WHEN hard THEN 20 ELSE 0 END AS complexity FROM c)
SELECT project_id, files, languages, lines, round(complexity, 4) AS complexity, CASE WHEN complexity >= 70 THEN 'complex' WHEN complexity >= 40 THEN 'moderate' ELSE 'simple' END AS level FROM s""")
def corpus_complexity(spark, sf):
    out = AI.corpus_complexity(with_language(I.code_files(spark, sf)))
    return out.withColumn("complexity", F.round("complexity", 4))


@query("correlation_prompts", "project_id s, prompt_hash s", f"""WITH {I.DEDUPED_SQL},
t AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY file, line, seq) AS n FROM deduped QUALIFY n <= 10),
b AS (SELECT project_id, string_agg('Finding ' || n || ':' || chr(10) || '- Category: ' || category || chr(10) || '- Severity: ' || severity || chr(10) || '- File: ' || file || ':' || line || chr(10) || '- Rule: ' || rule || chr(10) || '- Message: ' || message || chr(10), chr(10) ORDER BY n) AS body FROM t GROUP BY ALL)
SELECT project_id, sha256({I.sql_list([chr(10).join(AI.CORRELATION_HEAD)])}[1] || chr(10) || body || chr(10) || {I.sql_list([chr(10).join(AI.CORRELATION_TAIL)])}[1]) AS prompt_hash FROM b""")
def correlation_prompts(spark, sf):
    from codeaudit.operators.scoring import dedupe_findings

    return AI.correlation_prompts(dedupe_findings(I.findings(spark, sf))).select("project_id", F.sha2("prompt", 256).alias("prompt_hash"))
