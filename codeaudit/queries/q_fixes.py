"""Fix proposals, patches and alteration reports: one derived file per order, expected texts as literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeaudit.operators import fixes as FX
from codeaudit.operators import patches as PT
from codeaudit.queries import inputs as I
from codeaudit.queries.registry import query, table

# (extension, rule, message, file text, line of the finding, old snippet, new snippet)
CASES = [
    (".js", "loose-equality", "", "if (a == b) {", 1, "if (a == b) {", "if (a === b) {"),
    (".js", "eqeqeq", "", "if (a != b) {", 1, "if (a != b) {", "if (a !== b) {"),
    (".py", "E711", "", "if x == None and y != None:", 1, "if x == None and y != None:", "if x is None and y is not None:"),
    (".js", "off-by-one", "", "for (i = 0; i <= xs.length; i++) {", 1, "for (i = 0; i <= xs.length; i++) {", "for (i = 0; i < xs.length; i++) {"),
    (".py", "off-by-one", "", "for i in range(0, len(xs) + 1):", 1, "for i in range(0, len(xs) + 1):", "for i in range(len(xs)):"),
    (".js", "empty-catch", "", "  } catch (err) {\n  }", 1, "  } catch (err) {", "  } catch (err) {\n    console.error(err);"),
    (".js", "swallowed-error", "", "try { a() } catch (e) { }", 1, "try { a() } catch (e) { }", "try { a() } catch (e) { }\n  console.error('Error caught:', e);"),
    (".js", "assignment-in-condition", "", "if (a = b) {", 1, "if (a = b) {", "if (a === b) {"),
    (".py", "assignment-in-condition", "", "while n = 3:", 1, "while n = 3:", "while n == 3:"),
    (".js", "duplicate-condition", "", "if (p) {\n} else if (q) {\n} else if (p) {", 1, "} else if (p) {", "} /* Duplicate condition removed */ else if (false) {"),
    (".js", "unreachable-code", "", "return;\ngo();", 2, "go();", ""),
    (".py", "E999", "", "query = run(a) td hd", 1, "query = run(a) td hd", "query = run(a)"),
    (".py", "invalid-syntax", "", "@app.route(x) junk", 1, "@app.route(x) junk", "@app.route(x)"),
    (".py", "syntax-error", "", "reh seh", 1, "reh seh", ""),
    (".py", "B018", "", "  stray", 1, "  stray", ""),
    (".js", "always-true-false", "", "if (true) {", 1, "if (true) {", "{ // always executes:"),
    (".js", "always-true-false", "", "if (false) {", 1, "if (false) {", ""),
    (".py", "B201", "", "app.run(host='0.0.0.0', debug=True)", 1, "app.run(host='0.0.0.0', debug=True)", "app.run(host='127.0.0.1', debug=False)"),
    (".py", "B105", "", "x = 1\napi_token = 'abc123'", 1, "api_token = 'abc123'", "api_token = os.environ.get('api_token', '')"),
    (".js", "hardcoded-secret", "", "const API_KEY = 'abcdef';", 1, "const API_KEY = 'abcdef';", "const API_KEY = process.env.API_KEY || ''"),
    (".js", "sql-injection-template", "", "db.query(`SELECT * FROM t WHERE a = ${a} AND b = ${b}`);", 1, "db.query(`SELECT * FROM t WHERE a = ${a} AND b = ${b}`);",
     "db.query('SELECT * FROM t WHERE a = $1 AND b = $2', [a, b]);"),
    (".js", "sql-injection-concat", "", "db.query(\"SELECT * FROM t WHERE id = \" + id);", 1, "db.query(\"SELECT * FROM t WHERE id = \" + id);", "db.query(\"SELECT * FROM t WHERE id =  $1\", [id]);"),
    (".py", "B608", "", "query = f\"SELECT * FROM t WHERE n = '{name}'\"\ndb.execute(query)", 1, "query = f\"SELECT * FROM t WHERE n = '{name}'\"\ndb.execute(query)",
     "query = \"SELECT * FROM t WHERE n = %s\"\ndb.execute(query, (name,))"),
    (".js", "code-injection-eval", "", "x = eval(y);", 1, "x = eval(y);", "x = JSON.parse(y);"),
    (".py", "B307", "", "x = eval(y)", 1, "x = eval(y)", "x = ast.literal_eval(y)"),
    (".py", "B102", "", "a = request.args\nexec(a)", 2, "a = request.args\nexec(a)",
     "_a = request.args\n# Dynamic execution disabled by codeaudit\nraise NotImplementedError(\"Dynamic execution disabled\")"),
    (".js", "code-injection-function", "", "f = new Function('a', b);", 1, "f = new Function('a', b);", "f = (() => { throw new Error(\"Dynamic Function constructor removed by codeaudit\"); });"),
    (".js", "command-injection", "", "execSync(a); exec(b);", 1, "execSync(a); exec(b);", "execFileSync(a); execFile(b);"),
    (".py", "B602", "", "os.system(cmd)", 1, "os.system(cmd)", "subprocess.run(shlex.split(cmd), check=True)"),
    (".js", "path-traversal", "", "  res.sendFile(filePath);", 1, "  res.sendFile(filePath);",
     "  // codeaudit: Validate resolved path stays within base directory\n  const safePath = path.resolve(path.join(__dirname, path.basename(req.params.filename || '')));\n  res.sendFile(safePath);"),
    (".py", "py-weak-crypto-hash", "", "h = hashlib.md5(x)", 1, "h = hashlib.md5(x)", "h = hashlib.sha256(x)"),
    (".js", "weak-crypto-hash", "", "crypto.createHash('SHA1')", 1, "crypto.createHash('SHA1')", "crypto.createHash('sha256')"),
    (".js", "prototype-pollution", "", "o.__proto__ = x;", 1, "o.__proto__ = x;", "o.constructor.prototype = /* BLOCKED */  x;"),
    (".py", "F401", "'b' imported but unused", "from m import a, b, c", 1, "from m import a, b, c", "from m import a, c"),
    (".py", "F401", "'os' imported but unused", "import os", 1, "import os", ""),
    (".py", "B301", "", "d = 1\nx = pickle.loads(d)", 1, "x = pickle.loads(d)", "x = json.loads(d)"),
    (".py", "B404", "", "import subprocess", 1, "import subprocess", "import subprocess  # noqa: B404 — validated safe usage (codeaudit)"),
    (".py", "F841", "Local variable `tmp` is assigned to but never used", "a = 1\ntmp = 2", 1, "tmp = 2", "_tmp = 2"),
    (".js", "sync-in-async", "", "d = fs.readFileSync(p);", 1, "d = fs.readFileSync(p);", "d = await fs.promises.readFile(p);"),
    (".py", "SIM115", "", "  fh = open(p, 'r')", 1, "  fh = open(p, 'r')", "  with open(p, 'r') as fh:"),
    (".js", "xss-dangerously-set-inner-html", "", "<p dangerouslySetInnerHTML={{ __html: h }} />", 1, "<p dangerouslySetInnerHTML={{ __html: h }} />", "<p dangerouslySetInnerHTML={{ __html: DOMPurify.sanitize(h ) }} />".replace("h ) }}", "h )}}")),
    (".py", "UP006", "", "def f(a: List[int], b: Dict[str, Set[int]]):", 1, "def f(a: List[int], b: Dict[str, Set[int]]):", "def f(a: list[int], b: dict[str, set[int]]):"),
    (".py", "UP045", "", "def f(a: Optional[int]):", 1, "def f(a: Optional[int]):", "def f(a: int | None):"),
    (".py", "SIM103", "", "  if a > b:\n    return True\n  else:\n    return False", 1, "  if a > b:\n    return True\n  else:\n    return False", "  return bool(a > b)"),
    (".py", "SIM102", "", "if a:\n    if b:", 1, "if a:\n    if b:", "if a and b:"),
    (".py", "B006", "", "def f(a=[], b={}):", 1, "def f(a=[], b={}):", "def f(a=None, b=None):"),
    (".py", "E722", "", "except:", 1, "except:", "except Exception:"),
    (".py", "BLE001", "", "except Exception:", 1, "except Exception:", "except Exception as err:"),
    (".py", "S110", "", "    pass", 1, "    pass", "    import logging\n    logging.exception(\"Handled unexpected exception\")"),
    (".py", "B113", "", "r = requests.get(url)", 1, "r = requests.get(url)", "r = requests.get(url, timeout=10)"),
    (".js", "B104", "", "listen('0.0.0.0')", 1, "listen('0.0.0.0')", "listen('127.0.0.1')"),
    (".js", "unbounded-cache", "", "const memo = {};", 1, "const memo = {};", "const memo = {};\nconst MAX_MEMO_KEYS = 5000;"),
    (".js", "unbounded-cache", "", "const seen = new Set();", 1, "const seen = new Set();",
     "const seen = new Set();\nconst MAX_SEEN_SIZE = 5000;\n// codeaudit: eviction guard helper\nfunction pruneSeen() { while (seen.size > MAX_SEEN_SIZE) seen.delete(seen.keys().next().value); }"),
    (".js", "stream-no-close", "", "const s = fs.createReadStream(p);", 1, "const s = fs.createReadStream(p);",
     "const s = fs.createReadStream(p);\ns.on('end', () => s.destroy());\ns.on('error', () => s.destroy());"),
    (".js", "setinterval-no-clear", "", "setInterval(f, 5);", 1, "setInterval(f, 5);", "const intervalTimer = setInterval(f, 5);\n// codeaudit: remember to clearInterval(intervalTimer) on teardown"),
    (".js", "listener-no-remove", "", "el.addEventListener('x', go);", 1, "el.addEventListener('x', go);", "el.addEventListener('x', go);\n// Teardown: el.removeEventListener('x', go);"),
    (".js", "regex-in-loop", "", "const re = new RegExp(p);", 1, "const re = new RegExp(p);", "// Hoisted outside loop: const re = new RegExp(p);\nconst re = re;"),
    (".js", "deployguard-missing-security-headers", "", "x();\nconst app = express();", 1, "const app = express();", "const helmet = require('helmet');\nconst app = express();\napp.use(helmet());"),
    (".py", "undefined-variable", "Undefined variable 'json' — x", "import os\nx = json.dumps(1)", 2, "import os", "import os\nimport json"),
    (".py", "F821", "Undefined name `jsonify`", "from flask import Flask\nreturn jsonify(1)", 2, "from flask import Flask", "from flask import Flask, jsonify"),
    (".py", "missing-import", "'redirect' is used", "from flask import Flask\nredirect(1)", 2, "from flask import Flask", "from flask import Flask, redirect"),
    (".py", "I001", "", "import b\nfrom z import y\nimport a", 1, "import b\nfrom z import y\nimport a", "from z import y\nimport a\nimport b"),
    (".js", "no-such-rule", "", "plain line", 1, None, None),
]
_N = len(CASES)
_COLUMNS = list(zip(*CASES))


def sites(spark, sf):
    """(findings, files): one case per order."""
    k = F.col("o_orderkey")
    case = k % _N

    def part(n: int):
        return F.element_at(F.array(*[F.lit(v) for v in _COLUMNS[n]]), case.cast("int") + 1)

    base = table(spark, sf, "orders").select(
        I.text("proj", I.div(k, 100)).alias("project_id"), F.concat(I.text("src/f", k), part(0)).alias("path"), part(3).alias("content"),
        part(1).alias("rule"), part(2).alias("message"), part(4).alias("line"), k.alias("seq"))
    findings = base.select("project_id", F.col("path").alias("file"), "line", "rule", F.lit("LOW").alias("severity"), "message", "seq")
    return findings, base.select("project_id", "path", "content")


def _list(n: int) -> str:
    return "[" + ", ".join("NULL" if v is None else I.sql_list([v])[1:-1] for v in _COLUMNS[n]) + "]"


_FINAL = "[" + ", ".join(I.sql_list([c[3] if c[5] is None else c[3].replace(c[5], c[6], 1)])[1:-1] for c in CASES) + "]"
_PLACE = f"'proj' || (o_orderkey // 100) AS project_id, 'src/f' || o_orderkey || ({_list(0)})[o_orderkey % {_N} + 1] AS"
_SKIP_LAST = f"o_orderkey % {_N} <> {_N - 1}"


@query("fix_proposals", "project_id s, file s, rule s, old_snippet s, new_snippet s", f"""SELECT {_PLACE} file, ({_list(1)})[o_orderkey % {_N} + 1] AS rule, ({_list(5)})[o_orderkey % {_N} + 1] AS old_snippet,
  ({_list(6)})[o_orderkey % {_N} + 1] AS new_snippet FROM orders WHERE ({_list(5)})[o_orderkey % {_N} + 1] IS NOT NULL""")
def fix_proposals(spark, sf):
    return FX.propose_fixes(*sites(spark, sf), spark.sparkContext.defaultParallelism)


@query("apply_patches", "project_id s, path s, new_content s, applied l, failed l", f"""SELECT {_PLACE} path, ({_FINAL})[o_orderkey % {_N} + 1] AS new_content, 1 AS applied, 0 AS failed
FROM orders WHERE ({_list(5)})[o_orderkey % {_N} + 1] IS NOT NULL""")
def apply_patches(spark, sf):
    findings, files = sites(spark, sf)
    return PT.apply_patches(files, FX.propose_fixes(findings, files))


@query("alteration_summary", "project_id s, total l, applied l, failed l, verified l, unverified l", f"""SELECT 'proj' || (o_orderkey // 100) AS project_id, count(*) AS total, count(*) FILTER (o_orderkey % 2 = 0) AS applied, count(*) FILTER (o_orderkey % 2 = 1) AS failed,
  count(*) FILTER (o_orderkey % 2 = 0) AS verified, 0 AS unverified FROM orders WHERE ({_list(5)})[o_orderkey % {_N} + 1] IS NOT NULL GROUP BY ALL""")
def alteration_summary(spark, sf):
    proposals = FX.propose_fixes(*sites(spark, sf))
    return PT.alteration_summary(PT.alteration_report(proposals, F.when(F.col("seq") % 2 == 0, "applied").otherwise("failed")))


_SNIPS = ["let a = 1;", "eval (x)", "os.system(c)", "drop table t", "fs.rmSync(p)", "x = pickle.load(f)"]
_PATHS = ["src/a.js", "Dockerfile", "app/settings.py", "lib/b.py"]


@query("critical_change", "key l, critical b", f"""SELECT o_orderkey AS key, o_orderkey % 4 IN (1, 2) OR o_orderkey % 6 <> 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 9 = 0 AS critical FROM orders""")
def critical_change(spark, sf):
    k = F.col("o_orderkey")
    test = PT.is_critical_change(
        I.pick(_PATHS, k % 4), F.when(k % 5 == 0, "HIGH").otherwise("LOW"), F.when(k % 7 == 0, "security").otherwise("bugs"),
        F.when(k % 9 == 0, "hardcoded-secret").otherwise("semi"), I.pick(_SNIPS, k % 6))
    return table(spark, sf, "orders").select(k.alias("key"), test.alias("critical"))


# (text before, text after clean-up)
PYTHON = [
    ("import sys\nimport os\nfrom b import z, a\nx = 1", "import os\nimport sys\n\nfrom b import a, z\n\nx = 1"),
    ("x = os.path.join(a)\nword junk line", "import os\n\n\nx = os.path.join(a)"),
    ("import pickle\nx = pickle.loads(d)", "import json\n\n\nx = json.loads(d)"),
    ("from flask import Flask\n\nreturn send_file(p)", "from flask import Flask, send_file\n\nreturn send_file(p)"),
    ("import subprocess\ny = 2", "y = 2"),
    ("def f(a): junk words\n    return a", "def f(a):\n    return a"),
]


@query("postprocess_python", "project_id s, path s, new_content s", f"""SELECT 'proj' || (p_partkey // 100) AS project_id, 'f' || p_partkey || '.py' AS path, ({I.sql_list([b for _, b in PYTHON])})[p_partkey % {len(PYTHON)} + 1] AS new_content FROM part""")
def postprocess_python(spark, sf):
    k = F.col("p_partkey")
    files = table(spark, sf, "part").select(I.text("proj", I.div(k, 100)).alias("project_id"), I.text("f", k, ".py").alias("path"), I.pick([a for a, _ in PYTHON], k % len(PYTHON)).alias("new_content"))
    return PT.postprocess_patched(files)


_SYNTAX = ["x = 1", "def f(:\n  pass", "a = 1\nb = = 2", "if True:\npass"]


@query("python_syntax", "project_id s, path s, line l", """SELECT 'proj' || (p_partkey // 100) AS project_id, 'f' || p_partkey || '.py' AS path, CASE p_partkey % 4 WHEN 1 THEN 1 ELSE 2 END AS line FROM part WHERE p_partkey % 4 <> 0""")
def python_syntax(spark, sf):
    k = F.col("p_partkey")
    files = table(spark, sf, "part").select(I.text("proj", I.div(k, 100)).alias("project_id"), I.text("f", k, ".py").alias("path"), I.pick(_SYNTAX, k % 4).alias("content"))
    return PT.validate_python_syntax(files)


@query("balanced_braces", "doc_id l, balanced b", "SELECT doc_id, abs((length(text) - length(replace(text, '{', ''))) - (length(text) - length(replace(text, '}', '')))) <= 5 AS balanced FROM documents")
def balanced_braces(spark, sf):
    return PT.reject_unbalanced(table(spark, sf, "documents").select("doc_id", F.col("text").alias("new_content")))
