"""Components, imports, graph joins, closures and the dependency audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeaudit.operators import dependency_audit as DA
from codeaudit.operators import graph as G
from codeaudit.queries import inputs as I
from codeaudit.queries.inputs import quote
from codeaudit.queries.registry import query, table
from codeaudit.sources import dependencies as SD

_ROUTE = f"regexp_matches(text, {quote(G.JS_ROUTE)})"
_PYROUTE = f"regexp_extract(text, {quote(G.PY_ROUTE)}, 1)"


def _re(p: str) -> str:
    return f"regexp_matches(text, {quote(p)})"


COMPONENTS_SQL = f"""
lined AS (
  SELECT project_id, file, line, 'entry' AS prefix, 'ENTRYPOINT' AS type, CASE WHEN {_ROUTE} THEN upper(regexp_extract(text, {quote(G.JS_ROUTE)}, 1)) || ' ' ||
     regexp_extract(text, {quote(G.JS_ROUTE)}, 2) ELSE upper({_PYROUTE}) || ' ' || {_PYROUTE} END AS label FROM code_lines WHERE {_ROUTE} OR {_PYROUTE} <> ''
  UNION ALL SELECT project_id, file, line, 'ctrl', 'CONTROLLER', regexp_extract(text, {quote(G.CONTROLLER_NAME)}, 1) FROM code_lines
     WHERE {_re(G.CONTROLLER)} AND {_re(G.CONTROLLER_NAME)}
  UNION ALL SELECT project_id, file, line, 'dbsink', 'DATA_SINK', 'Database Sink' FROM code_lines WHERE {_re(G.DATA_SINK)}
  UNION ALL SELECT project_id, file, line, 'execsink', 'EXEC_SINK', 'Dynamic Code/Shell Sink' FROM code_lines WHERE {_re(G.EXEC_SINK)}
  UNION ALL SELECT project_id, file, line, 'aisink', 'AI_SINK', 'LLM Prompt Call' FROM code_lines WHERE {_re(G.AI_SINK)}),
symbols AS (
  SELECT project_id, file, line, n, CASE WHEN is_py THEN s ELSE trim(split_part(trim(s), ':', 1)) END AS s FROM (
    SELECT project_id, file, line, is_py, unnest(l) AS s, generate_subscripts(l, 1) AS n FROM (
      SELECT project_id, file, line, is_py, CASE WHEN is_py THEN list_filter([regexp_extract(text, {quote(G.PY_DEF)}, 1), regexp_extract(text, {quote(G.PY_CLASS)}, 1)], lambda x: NOT starts_with(x, '_'))
        ELSE list_concat(string_split(regexp_extract(text, 'module\\.exports\\s*=\\s*\\{{([^}}]+)\\}}', 1), ','),
          [regexp_extract(text, 'module\\.exports\\s*=\\s*([a-zA-Z0-9_]+)', 1), regexp_extract(text, {quote(G.ES_EXPORT)}, 1)]) END AS l FROM code_lines)) WHERE s <> ''),
firsts AS (SELECT project_id, file, s, min(line * 100 + n) AS o FROM symbols GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY project_id, file ORDER BY o) AS r FROM firsts),
components AS (
  SELECT project_id, prefix || '-' || file || '-' || line AS id, type, label, file, line FROM lined
  UNION ALL SELECT project_id, 'exports-' || file, 'EXPORTS', string_agg(s, ', ' ORDER BY o), file, 1 FROM ranked WHERE r <= 8 GROUP BY project_id, file)
"""
_CC = "project_id s, id s, type s, label s, file s, line l"


@query("components", _CC, f"WITH {I.CODE_FILES_SQL}, {COMPONENTS_SQL} SELECT * FROM components")
def components(spark, sf):
    return G.extract_components(I.code_files(spark, sf))


@query("architecture_summary", "project_id s, file s, summary s", f"""WITH {I.CODE_FILES_SQL}, {COMPONENTS_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY project_id, file ORDER BY line, list_position(['ENTRYPOINT','CONTROLLER','DATA_SINK','EXEC_SINK','AI_SINK'], type)) AS r
      FROM components WHERE type <> 'EXPORTS'),
p AS (SELECT project_id, file, '[' || string_agg(type || ': ' || label, ' · ' ORDER BY r) || ']' AS parts FROM o WHERE r <= 3 GROUP BY ALL),
e AS (SELECT project_id, file, ' -> exports: ' || label AS ex FROM components WHERE type = 'EXPORTS')
SELECT project_id, file, '- ' || file || ' ' || coalesce(parts, '') || coalesce(ex, '') AS summary FROM p FULL JOIN e USING (project_id, file)
QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY file) <= 29""")
def architecture_summary(spark, sf):
    return G.architecture_summary(G.extract_components(I.code_files(spark, sf)))


# ---- imports: modules derived from part, 100 per project ----------------------

def module_files(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    i = k % 100
    js = F.concat_ws(
        "\n", F.lit("const a = 1;"),
        F.when(i >= 2, I.text("const x = require('./f", i - 2, "');")),
        F.when((i >= 4) & (i % 6 == 0), I.text("import y from './sub/../f", i - 4, ".js'")),
        F.when((i >= 6) & (i % 10 == 0), I.text("import '../other/f", i - 6, ".js'")), F.lit("import fs from 'fs'"))
    py = F.concat_ws(
        "\n", F.when(i >= 3, I.text("from pkg.f", i - 2, " import x")), F.when((i >= 5) & (i % 5 == 0), I.text("import f", i - 4)), F.lit("import os"))
    return p.select(I.text("proj", I.div(k, 100)).alias("project_id"), F.concat(I.text("lib/f", i), F.when(i % 2 == 0, ".js").otherwise(".py")).alias("path"),
                    F.when(i % 2 == 0, js).otherwise(py).alias("content"))


EDGES_SQL = """
modules AS (SELECT 'proj' || (p_partkey // 100) AS project_id, p_partkey % 100 AS i FROM part),
links AS (
  SELECT project_id, i, i - 2 AS j FROM modules WHERE i % 2 = 0 AND i >= 2
  UNION ALL SELECT project_id, i, i - 4 FROM modules WHERE i % 6 = 0 AND i >= 4
  UNION ALL SELECT project_id, i, i - 6 FROM modules WHERE i % 10 = 0 AND i >= 6
  UNION ALL SELECT project_id, i, i - 2 FROM modules WHERE i % 2 = 1 AND i >= 3
  UNION ALL SELECT project_id, i, i - 4 FROM modules WHERE i % 2 = 1 AND i % 5 = 0 AND i >= 5),
edges AS (SELECT project_id, 'lib/f' || i || CASE WHEN i % 2 = 0 THEN '.js' ELSE '.py' END AS "from",
                 'lib/f' || j || CASE WHEN j % 2 = 0 THEN '.js' ELSE '.py' END AS "to" FROM links)
"""


@query("import_edges", "project_id s, from s, to s, type s", f"""WITH {EDGES_SQL} SELECT *, 'IMPORTS' AS type FROM edges""")
def import_edges(spark, sf):
    return G.import_edges(module_files(spark, sf))


@query("impacted_files", "project_id s, target s, impacted s", f"""WITH RECURSIVE {EDGES_SQL},
targets AS (SELECT DISTINCT project_id, t AS target FROM modules, (SELECT unnest(['lib/f90.js', 'lib/f81.py', 'lib/f70.js']) AS t)),
reach AS (SELECT e.project_id, t.target, e."from" AS impacted FROM targets t JOIN edges e ON e.project_id = t.project_id AND e."to" = t.target
  UNION SELECT e.project_id, r.target, e."from" FROM reach r JOIN edges e ON e.project_id = r.project_id AND e."to" = r.impacted)
SELECT project_id, target, impacted FROM reach WHERE impacted <> target""")
def impacted_files(spark, sf):
    edges = G.import_edges(module_files(spark, sf))
    projects = table(spark, sf, "part").select(I.text("proj", I.div(F.col("p_partkey"), 100)).alias("project_id")).distinct()
    targets = projects.select("project_id", F.explode(F.array(*[F.lit(t) for t in ("lib/f90.js", "lib/f81.py", "lib/f70.js")])).alias("target"))
    return G.impacted_files(edges, targets)


@query("graph_edges", "project_id s, from s, to s, type s", f"""WITH {EDGES_SQL}
SELECT DISTINCT project_id, "from", "to", 'IMPORTS' AS type FROM edges UNION ALL SELECT DISTINCT project_id, "to", "from", 'TRUSTS' FROM edges""")
def graph_edges(spark, sf):
    edges = G.import_edges(module_files(spark, sf))
    back = edges.select("project_id", F.col("to").alias("from"), F.col("from").alias("to"), F.lit("TRUSTS").alias("type"), "label")
    return G.union_edges(edges, back, edges)


# ---- graph joins on lineitem: returned lines are components, the rest findings -

def graph_sides(spark, sf):
    li = table(spark, sf, "lineitem")
    pk, ln = F.col("l_partkey"), F.col("l_linenumber")
    line = (F.col("l_quantity") * 3).cast("int")
    base = li.select("l_returnflag", I.text("proj", I.div(pk, 50)).alias("project_id"), I.text("src/P", pk, ".js").alias("file"), line.alias("line"), "l_orderkey", ln.alias("n"))
    kind = I.pick(["ENTRYPOINT", "CONTROLLER", "DATA_SINK", "EXEC_SINK", "AI_SINK", "EXPORTS", "EXPORTS"], F.col("n") - 1)
    comps = base.filter("l_returnflag = 'A'").select(
        "project_id", I.text("c-", F.col("l_orderkey"), "-", F.col("n"), "-", F.col("file")).alias("id"), kind.alias("type"),
        I.text("L", F.col("n")).alias("label"), "file", "line").distinct()
    found = base.filter("l_returnflag <> 'A'").select(
        "project_id", I.text("v-", F.col("l_orderkey"), "-", F.col("n"), "-", F.lower("file")).alias("id"),
        I.pick(I.SEVERITY_OF_LINE, F.col("n") - 1).alias("severity"), I.text("r", F.col("n")).alias("ruleId"), F.lit("bugs").alias("category"),
        F.lower("file").alias("file"), "line").distinct()
    return comps, found


SIDES_SQL = """
base AS (SELECT l_returnflag AS flag, 'proj' || (l_partkey // 50) AS project_id, 'src/P' || l_partkey || '.js' AS file, CAST(l_quantity * 3 AS INTEGER) AS line, l_orderkey AS k, l_linenumber AS n FROM lineitem),
comps AS (SELECT DISTINCT project_id, 'c-' || k || '-' || n || '-' || file AS id, (['ENTRYPOINT','CONTROLLER','DATA_SINK','EXEC_SINK','AI_SINK','EXPORTS','EXPORTS'])[n] AS type, 'L' || n AS label, file, line FROM base WHERE flag = 'A'),
vulns AS (SELECT DISTINCT project_id, 'vuln-v-' || k || '-' || n || '-' || lower(file) AS id, (['BLOCKER','HIGH','MEDIUM','LOW','LOW','INFO','INFO'])[n] AS severity, 'r' || n AS rule, lower(file) AS file, line FROM base WHERE flag <> 'A')
"""


@query("expose_edges", "project_id s, from s, to s, type s", f"""WITH {SIDES_SQL}
SELECT c.project_id, c.id AS "from", v.id AS "to", 'EXPOSES' AS type FROM comps c JOIN vulns v ON c.project_id = v.project_id AND lower(c.file) = v.file AND abs(c.line - v.line) < 25 WHERE c.type <> 'EXPORTS'""")
def expose_edges(spark, sf):
    return G.expose_edges(*graph_sides(spark, sf))


@query("attack_paths", "project_id s, id s, entrypoint s, entry_file s, target_file s, vulnerability s, severity s, chain s", f"""WITH {SIDES_SQL}
SELECT c.project_id, 'path-' || c.id || '-' || v.id AS id, c.label AS entrypoint, c.file || ':' || c.line AS entry_file, v.file || ':' || v.line AS target_file,
  v.severity || ': ' || v.rule AS vulnerability, v.severity,
  '[External Request] ➔ ' || c.label || ' (' || c.file || ':' || c.line || ') | [Tainted Parameter Flow] ➔ Unsanitized argument propagation | [Exploited Sink] ➔ ' ||
    v.severity || ': ' || v.rule || ' (' || v.file || ':' || v.line || ')' AS chain
FROM comps c JOIN vulns v ON c.project_id = v.project_id AND lower(c.file) = v.file WHERE c.type = 'ENTRYPOINT'""")
def attack_paths(spark, sf):
    return G.attack_paths(*graph_sides(spark, sf)).withColumn("chain", F.array_join("exploit_chain", " | "))


@query("first_attack_paths", "project_id s, id s, position l", f"""WITH {SIDES_SQL},
p AS (SELECT c.project_id, 'path-' || c.id || '-' || v.id AS id FROM comps c JOIN vulns v ON c.project_id = v.project_id AND lower(c.file) = v.file WHERE c.type = 'ENTRYPOINT')
SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY id) AS position FROM p QUALIFY position <= 5""")
def first_attack_paths(spark, sf):
    return G.first_attack_paths(*graph_sides(spark, sf), 5)


@query("attack_path_groups", "project_id s, file s, entries l, findings l, paths l", f"""WITH {SIDES_SQL}
SELECT c.project_id, v.file, count(DISTINCT (c.id, c.line)) AS entries, count(DISTINCT (v.id, v.line, v.severity)) AS findings, count(*) AS paths
FROM comps c JOIN vulns v ON c.project_id = v.project_id AND lower(c.file) = v.file WHERE c.type = 'ENTRYPOINT' GROUP BY ALL""")
def attack_path_groups(spark, sf):
    return G.attack_path_groups(*graph_sides(spark, sf))


@query("graph_nodes", "project_id s, id s, type s, label s, line l", f"""WITH {SIDES_SQL}
SELECT project_id, id, type, label, line FROM comps WHERE type <> 'EXPORTS' QUALIFY row_number() OVER (PARTITION BY project_id, id ORDER BY line) = 1
UNION ALL SELECT project_id, id, 'VULNERABILITY', severity || ': ' || rule, line FROM vulns QUALIFY row_number() OVER (PARTITION BY project_id, id ORDER BY line) = 1""")
def graph_nodes(spark, sf):
    comps, found = graph_sides(spark, sf)
    comps = comps.groupBy("project_id", "id", "type", "label", "file").agg(F.min("line").alias("line"))
    found = found.groupBy("project_id", "id", "severity", "ruleId", "category", "file").agg(F.min("line").alias("line"))
    return G.graph_nodes(comps, found)


# ---- dependencies ------------------------------------------------------------
NPM = ["lodash", "Axios", "express", "request", "event-stream", "left-pad", "jsonwebtoken"]
PYPI = ["flask", "requests", "PyYAML", "urllib3", "numpy"]
RANGES = ["^", "~", "", ">=", "="]


def manifests(spark, sf):
    """A package file and a requirements file per part."""
    p = table(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    version = I.text(k % 6, ".", size % 22, ".", k % 30)
    npm, dev, pypi = I.pick(NPM, k % 7), I.pick(NPM, (k + size) % 7), I.pick(PYPI, k % 5)
    package = I.text('{"name": "x",\n"dependencies": {\n"', npm, '": "', I.pick(RANGES, k % 5), version, '"},\n"devDependencies": {"', dev, '": "', version, '"}}')
    pinned = F.when(k % 4 == 0, pypi).otherwise(I.text(pypi, "==", version))
    listed = I.text("# pinned\n\n", pinned, "\nnumpy>=1.2.3")
    owner = I.text("proj", I.div(k, 20)).alias("project_id")
    one = p.select(owner, I.text("p", k, "/package.json").alias("path"), package.alias("content"))
    return one.unionByName(p.select(owner, I.text("p", k, "/requirements.txt").alias("path"), listed.alias("content")))


DEPS_SQL = f"""
b AS (SELECT p_partkey AS k, 'proj' || (p_partkey // 20) AS project_id, (p_partkey % 6) || '.' || (p_size % 22) || '.' || (p_partkey % 30) AS v,
  ({I.sql_list(NPM)})[p_partkey % 7 + 1] AS npm, ({I.sql_list(NPM)})[(p_partkey + p_size) % 7 + 1] AS dev, ({I.sql_list(PYPI)})[p_partkey % 5 + 1] AS pypi,
  ({I.sql_list(RANGES)})[p_partkey % 5 + 1] AS op FROM part),
deps AS (
  SELECT project_id, npm AS name, v AS version, op || v AS "rawVersion", 'npm' AS ecosystem, 'p' || k || '/package.json' AS file, 3 AS line FROM b WHERE npm <> dev
  UNION ALL SELECT project_id, dev, v, v, 'npm', 'p' || k || '/package.json', CASE WHEN npm = dev THEN 3 ELSE 4 END FROM b
  UNION ALL SELECT project_id, pypi, CASE WHEN k % 4 = 0 THEN '*' ELSE v END, CASE WHEN k % 4 = 0 THEN pypi ELSE pypi || '==' || v END, 'pypi', 'p' || k || '/requirements.txt', 3 FROM b
  UNION ALL SELECT project_id, 'numpy', '1.2.3', 'numpy>=1.2.3', 'pypi', 'p' || k || '/requirements.txt', 4 FROM b)
"""


@query("dependency_manifests", "project_id s, name s, version s, rawVersion s, ecosystem s, file s, line l", f"WITH {DEPS_SQL} SELECT * FROM deps")
def dependency_manifests(spark, sf):
    return SD.read_dependency_manifests(manifests(spark, sf))


EXTRA = [(0, "npm", "left-pad", ["<=2.5.0", "5.0.1"], "CVE-X-1", "MEDIUM", "old", "3.0.0"), (1, "npm", "lodash", ["*"], "CVE-X-2", "LOW", "later entry", "none"),
         (2, "pypi", "numpy", ["=1.2.3"], "CVE-X-3", None, "exact", "")]


def _extra(spark):
    return spark.createDataFrame(EXTRA, "ord int, ecosystem string, name string, affected array<string>, cve string, severity string, summary string, fixed string")


_ADV = [(n, *row) for n, row in enumerate(SD.SEED_ADVISORIES)] + [(10 + e[0], *e[1:]) for e in EXTRA]
_ADV_SQL = "adv(ord, ecosystem, name, cond, cve, severity, summary, fixed) AS (VALUES " + ", ".join(
    f"({n}, '{eco}', '{name}', '{c}', '{cve}', {quote(sev) if sev else 'NULL'}, {quote(summary)}, {quote(fixed)})"
    for n, eco, name, conds, cve, sev, summary, fixed in _ADV for c in conds) + ")"
_KEY = "list_transform(string_split(split_part({x}, '-', 1), '.'), lambda p: coalesce(TRY_CAST(nullif(regexp_extract(p, '^\\d+'), '') AS BIGINT), 0))"
_PAD = "list_concat({k}, [0, 0, 0, 0])[1:4]"
_VK = _PAD.format(k=_KEY.format(x="d.version"))
_CK = _PAD.format(k=_KEY.format(x="regexp_replace(a.cond, '^(<=|<|=)', '')"))
AUDIT_SQL = f"""{DEPS_SQL}, {_ADV_SQL},
pairs AS (
  SELECT d.*, a.ord, a.cve, a.severity, a.summary, a.fixed FROM deps d JOIN adv a ON a.ecosystem = d.ecosystem AND lower(a.name) = lower(d.name)
  WHERE CASE WHEN a.cond = '*' THEN TRUE WHEN starts_with(a.cond, '<=') THEN {_VK} <= {_CK} WHEN starts_with(a.cond, '<') THEN {_VK} < {_CK}
             WHEN starts_with(a.cond, '=') THEN {_VK} = {_CK} ELSE d.version = a.cond END),
firsts AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY project_id, file, line, name, ecosystem ORDER BY ord) = 1)
"""


@query("dependency_audit", "project_id s, file s, line l, rule s, severity s, message s, suggestedFix s", f"""WITH {AUDIT_SQL}
SELECT project_id, file, line, cve AS rule, coalesce(severity, 'HIGH') AS severity, 'Dependency "' || name || '" (' || version || ') has known vulnerability [' || cve || ']: ' || summary AS message,
  'Upgrade ' || name || ' to ' || coalesce(nullif(fixed, ''), 'latest secure release') AS "suggestedFix" FROM firsts""")
def dependency_audit(spark, sf):
    return DA.audit_dependencies(SD.read_dependency_manifests(manifests(spark, sf)), SD.load_advisories(spark, _extra(spark)))


@query("unmatched_dependencies", "project_id s, file s, line l, name s, version s", f"""WITH {AUDIT_SQL}
SELECT project_id, file, line, name, version FROM deps d WHERE NOT EXISTS (SELECT 1 FROM firsts f WHERE f.project_id = d.project_id AND f.file = d.file AND f.line = d.line AND f.name = d.name)""")
def unmatched_dependencies(spark, sf):
    return DA.unmatched_dependencies(SD.read_dependency_manifests(manifests(spark, sf)), SD.load_advisories(spark, _extra(spark)))


@query("stale_advisories", "event_id l", "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR")
def stale_advisories(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("ts").alias("fetched_at"))
    return SD.stale_advisories(rows, F.lit("2024-01-20 00:00:00").cast("timestamp"))


@query("semver_order", "a s, b s, pairs l, ordering l", f"""WITH v AS (SELECT (p_partkey % 3) || '.' || (p_size % 4) || CASE WHEN p_size % 3 = 0 THEN '.0' ELSE '' END AS a,
   '^' || (p_size % 3) || '.' || (p_partkey % 4) || '-beta' AS b FROM part),
k AS (SELECT a, b, {_PAD.format(k=_KEY.format(x='a'))} AS ka, {_PAD.format(k=_KEY.format(x="ltrim(b, '^')"))} AS kb FROM v)
SELECT a, b, count(*) AS pairs, CASE WHEN ka < kb THEN -1 WHEN ka > kb THEN 1 ELSE 0 END AS ordering FROM k GROUP BY ALL""")
def semver_order(spark, sf):
    from codeaudit.functions.versions import compare_semver

    p = table(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    a = F.concat(I.text(k % 3, ".", size % 4), F.when(size % 3 == 0, ".0").otherwise(""))
    b = I.text("^", size % 3, ".", k % 4, "-beta")
    pairs = p.select(a.alias("a"), b.alias("b")).groupBy("a", "b").agg(F.count("*").alias("pairs"))
    return pairs.withColumn("ordering", compare_semver(F.col("a"), F.col("b")))
