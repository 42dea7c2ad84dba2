"""Applying proposals to file texts, cleaning Python files, and the alteration report."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeaudit.functions import text as X
from codeaudit.operators.fixes import DB_CLIENT, FLASK_APP, FLASK_HEADERS, is_stray_words, propose_fixes, strip_def_tail, sub_first
from codeaudit.session import checkpoint

# --- Fixed values -------------------------------------------------------------
CRITICAL_RULES = [
    "sql-injection", "sqli-string-concat", "command-injection", "code-injection", "unsafe-eval",
    "unsafe-pickle", "hardcoded-secret", "deployguard-docker-env-secret", "deployguard-docker-root",
    "deployguard-cicd-secret-leak", "deployguard-committed-env", "modelshield-prompt-injection",
    "modelshield-unsafe-model-load", "modelshield-agent-code-exec",
]
DANGEROUS_SNIPPETS = [
    r"\b(?:eval|exec)\s*\(", r"\bchild_process\.(?:exec|spawn|execSync|spawnSync)\b",
    r"\bsubprocess\.(?:run|Popen|call|check_output)\b", r"\bpickle\.loads?\b", r"\btorch\.load\b",
    r"\bos\.system\b", r"(?i)\bDROP\s+TABLE\b", r"(?i)\bDELETE\s+FROM\b", r"\brmdir\b|\bunlink\b|\bfs\.rmSync\b",
]
# A finding whose rule or message matches is settled once its pattern is gone from the whole file:
# (rule, message, pattern), all as regular expressions; an empty one never matches.
SETTLED = [
    (r"^B201$", r"debug=True", r"debug\s*=\s*True"),
    (r"^B104$", r"0\.0\.0\.0", r"host\s*=\s*['\"]0\.0\.0\.0['\"]"),
    (r"^(?:B102|S102)$|user-exec", r"\bexec\s*\(", r"\bexec\s*\("),
    (r"^(?:B307|S307)$|user-eval", r"\beval\s*\(", r"\beval\s*\("),
    (r"^(?:B608|S608)$|tainted-sql|formatted-sql|sql-injection", r"", r"(?i)f[\"'].*(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE)|\.format\s*\("),
    (r"^B301$|insecure-deserialization", r"", r"pickle\.loads?\s*\("),
    (r"^B403$", r"", r"\bpickle\b"),
    (r"^(?:py-command-injection|B602|S602)$", r"", r"shell\s*=\s*True"),
    (r"production-debug", r"", r"debug\s*=\s*True"),
    (r"^(?:hardcoded-secret|B105|B106)$", r"",
     r"(?i)(?:(?:API|SECRET|AUTH|ACCESS|PRIVATE)[_-]?(?:KEY|TOKEN|SECRET)|(?:DB_|DATABASE_)PASSWORD)\s*[:=]\s*['\"][^'\"]{6,}['\"]"),
]
SUBPROCESS_RULE, SUBPROCESS_IMPORT, SUBPROCESS_NOTE = "B404", "import subprocess", "# noqa: B404"
UNDEFINED_RULES, QUOTED_NAME = ["F821", "undefined-variable"], r"[`'\"]([a-zA-Z_]\w*)[`'\"]"
UNUSED_RULE, UNUSED_NAME = "F401", r"[`'\"]?([a-zA-Z0-9_.]+)[`'\"]?\s+imported but unused"
HEADER_WORDS = r"(?i)(?:helmet|SecurityMiddleware|Talisman|_set_security_headers)"
# --- end of fixed values ------------------------------------------------------


def is_critical_change(file: Column, severity: Column, category: Column, rule: Column, proposed: Column) -> Column:
    """Whether a change touches sensitive files, severe findings or dangerous code."""
    path = F.lower(F.coalesce(file, F.lit("")))
    test = (
        X.contains_any(path, "dockerfile", ".github/workflows", ".env")
        | path.endswith("settings.py") | path.endswith("database.js")
        | F.coalesce(F.upper(severity).isin("BLOCKER", "HIGH"), F.lit(False))
        | F.coalesce(category == "security", F.lit(False))
        | F.coalesce(F.lower(rule).isin(CRITICAL_RULES), F.lit(False)))
    text = F.coalesce(proposed, F.lit(""))
    for pattern in DANGEROUS_SNIPPETS:
        test = test | text.rlike(pattern)
    return test


# ---- applying snippets -------------------------------------------------------

def _plain(text: str) -> str:
    return re.sub(r"[ \t]+$", "", text.replace("\r", ""), flags=re.M)


def apply_snippet(content: str, old: str, new: str, target: int) -> str | None:
    """New content, or None: exact text, else blanks aside near the line, else the
    line itself, else any line that holds the trimmed snippet."""
    if not old:
        return None
    if old in content:
        return content.replace(old, new, 1)
    lines, at = content.split("\n"), max(0, (target or 1) - 1)
    height, wanted = old.count("\n") + 1, _plain(old)
    if wanted in _plain(content):
        for start in sorted(range(at - 5, at + 6), key=lambda n: (abs(n - at), n)):
            if 0 <= start < len(lines) and _plain("\n".join(lines[start:start + height])) == wanted:
                return "\n".join([*lines[:start], *new.split("\n"), *lines[start + height:]])
    core = old.strip()
    if at < len(lines) and (lines[at].strip() == core or core in lines[at]):
        return "\n".join([*lines[:at], *new.split("\n"), *lines[at + 1:]])
    if len(core) > 3:
        for n, line in enumerate(lines):
            if core in line:
                return "\n".join([*lines[:n], line.replace(core, new.strip(), 1), *lines[n + 1:]])
    return None


@F.pandas_udf(T.StructType([
    T.StructField("new_content", T.StringType()), T.StructField("applied", T.IntegerType()), T.StructField("failed", T.IntegerType()),
    T.StructField("applied_ords", T.ArrayType(T.LongType()))]))
def _patched(contents: pd.Series, patches: pd.Series) -> pd.DataFrame:
    """Each text with its patches applied in the given order."""
    out = []
    for content, changes in zip(contents, patches):
        done, failed, ords = 0, 0, []
        for change in changes:
            result = apply_snippet(content, change["old"], change["new"], change["start"])
            if result is None:
                failed += 1
            else:
                if result != content:
                    ords.append(change["ord"])
                content, done = result, done + 1
        out.append((content, done, failed, ords))
    return pd.DataFrame(out, columns=["new_content", "applied", "failed", "applied_ords"])


def apply_patches(files: DataFrame, proposals: DataFrame) -> DataFrame:
    """Patched text of every file with proposals, applied from the last line up.

    The patches of a file become one sorted array on its row; rows then stream
    through tasks in Arrow batches.
    """
    order = F.col("seq") if "seq" in proposals.columns else F.lit(0)
    patch = F.struct(
        (-F.coalesce("line", F.lit(1))).alias("line"), order.cast("long").alias("ord"),
        F.coalesce("start_line", F.lit(1)).cast("int").alias("start"),
        F.col("old_snippet").alias("old"), F.col("new_snippet").alias("new"))
    patches = proposals.groupBy("project_id", F.col("file").alias("path")).agg(
        F.array_sort(F.collect_list(patch)).alias("_patches"))
    # Fresh column ids: both sides may come from one table.
    texts = files.select(*[F.col(c).alias(c) for c in ("project_id", "path", "content")])
    return texts.join(patches, ["project_id", "path"]).select(
        "project_id", "path", _patched("content", "_patches").alias("_p")).select("project_id", "path", "_p.*")


# ---- fixing whole files ------------------------------------------------------

def settled(rule: Column, message: Column, content: Column) -> Column:
    """Whether what a finding is about is gone from its file, as earlier fixes left it."""
    rule, message = F.coalesce(rule, F.lit("")), F.coalesce(message, F.lit(""))
    gone = (rule == SUBPROCESS_RULE) & (~content.contains(SUBPROCESS_IMPORT) | content.contains(SUBPROCESS_NOTE))
    for by_rule, by_message, pattern in SETTLED:
        about = (rule.rlike(by_rule) if by_rule else F.lit(False)) | (message.rlike(by_message) if by_message else F.lit(False))
        gone = gone | (about & ~content.rlike(pattern))
    name = F.regexp_extract(message, QUOTED_NAME, 1)
    defined = F.regexp_like(content, F.concat(
        F.lit(r"\b(?:import\s+"), name, F.lit(r"|from\s+\S+\s+import\s+[^\n]*\b"), name, F.lit(r"\b|"), name, F.lit(r"\s*=|def\s+"), name,
        F.lit(r"\b|class\s+"), name, F.lit(r"\b)")))
    gone = gone | (rule.isin(UNDEFINED_RULES) & F.when(name != "", defined).otherwise(False))
    unused = F.substring_index(F.regexp_extract(message, UNUSED_NAME, 1), ".", -1)
    return gone | ((rule == UNUSED_RULE) & (unused != "") & ~content.contains(unused))


def fix_files(findings: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, outcomes): all findings of all files fixed, later fixes seeing the text as changed so far.

    Round n takes the n-th finding of every line, so there are as many rounds as
    the busiest line has findings.  In a round, findings that are settled by now
    count as applied, the others get a proposal from the current text, and a
    file's proposals are applied from the last line up.  `outcomes` are the
    findings with `outcome`: applied, settled or unresolved.
    """
    names = ["project_id", "file", "line", "rule", "severity", "message"]
    order = [F.col(c) for c in ("seq", "rule", "message") if c in findings.columns]
    ranked = checkpoint(findings.select(*names, *[c for c in ("seq",) if c in findings.columns]).withColumns({
        "_round": F.row_number().over(Window.partitionBy("project_id", "file", "line").orderBy(*order)),
        "_ord": F.monotonically_increasing_id()}))
    rounds = ranked.agg(F.max("_round")).first()[0] or 0
    texts = checkpoint(files.select("project_id", "path", "content"))
    outcomes = ranked.select(*names, F.lit("unresolved").alias("outcome")).limit(0)
    for n in range(1, rounds + 1):
        due = ranked.filter(F.col("_round") == n).select(*names, F.col("_ord").alias("seq"))
        seen = due.join(texts.select("project_id", F.col("path").alias("file"), F.col("content").alias("_content")),
                        ["project_id", "file"], "left")
        now = F.coalesce(settled(F.col("rule"), F.col("message"), F.col("_content")), F.lit(False))
        due = checkpoint(seen.select(*names, "seq", now.alias("_settled")))
        proposals = propose_fixes(due.filter("NOT _settled").drop("_settled"), texts)
        patched = checkpoint(apply_patches(texts, proposals))
        hit = patched.select(F.explode("applied_ords").alias("seq"), F.lit(True).alias("_hit"))
        outcome = F.when(F.col("_settled"), "settled").when(F.col("_hit"), "applied").otherwise("unresolved")
        outcomes = outcomes.unionByName(due.join(hit, "seq", "left").select(*names, outcome.alias("outcome")))
        texts = checkpoint(texts.join(patched.select("project_id", "path", "new_content"), ["project_id", "path"], "left").select(
            "project_id", "path", F.coalesce("new_content", "content").alias("content")))
    return texts, outcomes


# ---- Python files ------------------------------------------------------------

def sort_python_imports(content: Column) -> Column:
    """Sort the leading import block: plain imports, a blank line, from-imports."""
    def build(lines: Column) -> Column:
        rows = F.transform(lines, lambda line, k: F.struct(k.alias("k"), X.js_trim(line).alias("t")))
        is_import = lambda r: X.starts_with_any(r["t"], "import ", "from ")
        first = F.get(F.filter(rows, is_import), F.lit(0))["k"]

        def with_block(block: Column) -> Column:
            plain = F.array_sort(F.array_distinct(F.transform(
                F.filter(block, lambda r: r["t"].startswith("import ")), lambda r: r["t"])))
            pattern = r"^(from\s+\S+\s+import\s+)(.+)$"

            def tidy(t: Column) -> Column:
                names = F.filter(F.transform(F.split(F.regexp_extract(t, pattern, 2), ","), X.js_trim), lambda n: n != "")
                keyed = F.array_sort(F.transform(names, lambda n, k: F.struct(F.lower(n).alias("k"), k.alias("i"), n.alias("n"))))
                text = F.concat(F.regexp_extract(t, pattern, 1), F.array_join(F.transform(keyed, lambda e: e["n"]), ", "))
                return F.when(t.rlike(pattern), text).otherwise(t)

            named = F.array_sort(F.array_distinct(F.transform(
                F.filter(block, lambda r: r["t"].startswith("from ")), lambda r: tidy(r["t"]))))
            middle = F.when(F.size(plain) > 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
            last = F.element_at(block, -1)["k"]
            after = F.slice(lines, last + 2, F.greatest(F.size(lines) - last - 1, F.lit(0)))
            lead = F.coalesce(F.get(F.filter(F.transform(after, lambda line, k: F.when(
                X.js_trim(line) != "", k)), lambda k: k.isNotNull()), F.lit(0)), F.size(after))
            rest = F.slice(after, lead + 1, F.size(after))
            return F.array_join(F.concat(F.slice(lines, 1, first), plain, middle, named, F.array(F.lit("")), rest), "\n")

        stop = F.coalesce(F.get(F.filter(rows, lambda r: (r["k"] > first) & ~is_import(r) & (r["t"] != "")
                                         & ~r["t"].startswith("#")), F.lit(0))["k"], F.size(lines))
        block = F.filter(rows, lambda r: is_import(r) & (r["k"] < stop))
        return F.when(first.isNull(), content).otherwise(X.let(block, with_block))

    return X.let(X.split_lines(content), build)


def _insert_after_app(text: Column, snippet: list[str]) -> Column:
    """Put lines below the application object, or on top if there is none."""
    def build(lines: Column) -> Column:
        at = F.coalesce(F.get(F.filter(F.transform(lines, lambda line, k: F.when(
            line.rlike(FLASK_APP), k + 1)), lambda k: k.isNotNull()), F.lit(0)), F.lit(0))
        added = F.array(*[F.lit(x) for x in ["", *snippet]])
        return F.array_join(F.concat(F.slice(lines, 1, at), added, F.slice(lines, at + 1, F.size(lines))), "\n")

    return X.let(X.split_lines(text), build)


def _drop_import(text: Column, module: str) -> Column:
    unused = text.rlike(rf"(?m)^import\s+{module}\b") & ~text.rlike(rf"\b{module}\.[a-zA-Z]")
    kept = F.array_join(F.filter(X.split_lines(text), lambda line: ~line.rlike(rf"^import\s+{module}\b")), "\n")
    return F.when(unused, kept).otherwise(text)


def postprocess_python(content: Column) -> Column:
    """Clean a patched Python file: stray lines, missing and unused imports, import order."""
    def needs(text: Column, use: str, module: str) -> Column:
        absent = ~text.rlike(rf"(?m)^import\s+{module}\b") & ~text.rlike(rf"(?m)^from\s+{module}\s+import")
        return F.when(text.rlike(use) & absent, F.concat(F.lit(f"import {module}\n"), text)).otherwise(text)

    def send_file(text: Column) -> Column:
        listed = text.rlike(r"(?m)^from\s+flask\s+import\s+") & ~text.rlike(r"\bfrom\s+flask\s+import\s+[^#\n]*\bsend_file\b")
        return F.when(text.rlike(r"\bsend_file\s*\(") & listed, sub_first(
            text, r"(?m:^)(from\s+flask\s+import\s+)([^\n]*[^\s,])[\s,]*?(?m:$)", "$1$2, send_file")).otherwise(text)

    steps = [
        lambda t: F.regexp_replace(
            t, r"(?m)^\s*(?:from\s+\S+\s+import\s+[^#\n]*_BufferCallback[^#\n]*|import\s+[^#\n]*_BufferCallback[^#\n]*)\n?", ""),
        lambda t: F.array_join(F.filter(F.transform(X.split_lines(t), strip_def_tail), lambda x: ~is_stray_words(x)), "\n"),
        lambda t: F.regexp_replace(t, r"\bpickle\.loads?\s*\(", "json.loads("),
        lambda t: needs(t, r"\bos\.environ\b|\bos\.path\b", "os"),
        lambda t: needs(t, r"\bast\.literal_eval\b", "ast"),
        lambda t: needs(t, r"\bjson\.(?:loads|dumps)\b", "json"),
        send_file,
        lambda t: F.when(t.rlike(r"\bdb\.execute\s*\(") & ~t.rlike(r"(?m)^\s*db\s*="), _insert_after_app(t, DB_CLIENT)).otherwise(t),
        lambda t: F.when(t.rlike(FLASK_APP) & ~t.rlike(HEADER_WORDS), _insert_after_app(t, FLASK_HEADERS)).otherwise(t),
        lambda t: _drop_import(t, "subprocess"),
        lambda t: _drop_import(t, "pickle"),
        sort_python_imports,
    ]

    def run(text: Column, left: list) -> Column:
        return X.let(left[0](text), lambda t: run(t, left[1:])) if left else text

    return run(content, steps)


def postprocess_patched(patched: DataFrame) -> DataFrame:
    """`new_content` of Python files cleaned, other files untouched."""
    py = F.col("path").endswith(".py") | F.col("path").endswith(".pyw")
    return patched.withColumn("new_content", F.when(py, postprocess_python(F.col("new_content"))).otherwise(F.col("new_content")))


@F.pandas_udf(T.StructType([
    T.StructField("valid", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("line", T.IntegerType())]))
def python_syntax(texts: pd.Series) -> pd.DataFrame:
    """Whether a text parses as Python, and where it fails."""
    def check(text: str | None) -> tuple:
        try:
            ast.parse(text or "")
            return True, None, None
        except SyntaxError as err:
            return False, f"SyntaxError: {err.msg}", err.lineno
        except (ValueError, RecursionError, MemoryError) as err:
            return False, str(err), None

    return pd.DataFrame([check(t) for t in texts], columns=["valid", "error", "line"]).astype(
        {"line": "Int32"})


def validate_python_syntax(files: DataFrame, content: str = "content") -> DataFrame:
    """Python files with a syntax error: (project_id, path, error, line)."""
    py = files.filter(F.col("path").endswith(".py") | F.col("path").endswith(".pyw"))
    return py.select("project_id", "path", python_syntax(F.col(content)).alias("_s")).filter(~F.col("_s.valid")).select(
        "project_id", "path", "_s.error", "_s.line")


def reject_unbalanced(patched: DataFrame) -> DataFrame:
    """Mark rewrites whose braces no longer pair."""
    return patched.withColumn("balanced", X.braces_balanced(F.col("new_content")))


# ---- alteration report -------------------------------------------------------

def alteration_report(proposals: DataFrame, status: Column | str = "applied", strategy: str = "deterministic",
                      model: Column | None = None, verified: Column | None = None) -> DataFrame:
    """One entry per proposal, with the defaults of a report entry."""
    state = F.upper(F.lit(status) if isinstance(status, str) else status)
    used = model if model is not None else F.lit("deterministic rule" if strategy == "deterministic" else "AI")
    return proposals.select(
        "project_id", F.coalesce("file", F.lit("unknown")).alias("file"), F.coalesce("line", F.lit(1)).alias("line"),
        F.coalesce("rule", F.lit("rule")).alias("rule"), F.coalesce("severity", F.lit("MEDIUM")).alias("severity"),
        F.coalesce("message", F.lit("Issue detected in static analysis")).alias("problem"),
        F.coalesce("explanation", F.lit("Applied automated code repair")).alias("reasoning"),
        F.coalesce("old_snippet", F.lit("")).alias("before"), F.coalesce("new_snippet", F.lit("")).alias("after"),
        F.lit(strategy).alias("strategy"), used.alias("model"),
        ((F.lit(False) if verified is None else verified) | (state == "APPLIED")).alias("verified"), state.alias("status"))


def alteration_summary(entries: DataFrame, keys: list[str] = ("project_id",)) -> DataFrame:
    return entries.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "APPLIED").alias("applied"),
        F.count_if(F.col("status") == "SKIPPED").alias("skipped"), F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.count_if("verified").alias("verified"),
    ).withColumn("unverified", F.col("applied") - F.col("verified"))
