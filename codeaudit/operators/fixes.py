"""Fix proposals: findings joined with their files, one column expression per kind of fix.

Files are split into lines and reduced to the few facts whole-file fixes need once,
before the join; after it every fix is a lazy branch of one `coalesce`, tried in
the order of `RULE_FIXES`.  Nothing is written back: the result is a table.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit.functions import text as X
from codeaudit.operators.rules.bugs import FLASK_FUNCTIONS
from codeaudit.operators.scan_rules import once
from codeaudit.schemas import NATIVE_TOOL
from codeaudit.session import spread

# --- Fixed values -------------------------------------------------------------
SEARCH_RADIUS = 25
KNOWN_STDLIB = [
    "os", "sys", "json", "ast", "subprocess", "re", "io", "math", "random",
    "datetime", "time", "hashlib", "base64", "collections", "functools",
    "itertools", "pathlib", "shutil", "tempfile", "csv", "logging",
    "threading", "socket", "http", "urllib", "shlex", "traceback",
    "contextlib", "dataclasses", "typing", "copy", "enum", "uuid",
    "glob", "struct", "sqlite3", "argparse", "textwrap",
]
PYTHON_KEYWORDS = [
    "import", "from", "global", "nonlocal", "return", "del", "raise",
    "assert", "yield", "if", "elif", "else", "while", "for", "with", "class",
    "def", "pass", "break", "continue", "try", "except", "finally",
    "async", "await", "lambda", "and", "or", "not", "is", "in",
]
SECRET_NAME = r"(?i)(?:key|secret|password|passwd|pwd|token|auth|credential|api_key|access_token|private_key)"
FLASK_APP = r"app\s*=\s*Flask\s*\("
EXPRESS_APP = r"(?:const|let|var)\s+app\s*=\s*express\s*\("
PICKLE_LOAD = r"pickle\.loads?\s*\("
WORDS_ONLY = r"^[a-zA-Z_]\w*(?:\s+[a-zA-Z_]\w*)+$"
STATEMENT_WORD = (
    r"^(import|from|def|class|if|elif|else|for|while|try|except|finally|with|return|raise|yield|pass"
    r"|break|continue|async|await|global|nonlocal|assert|lambda|print)\b"
)
FLASK_HEADERS = [
    "# Security headers middleware (Talisman / security headers)",
    "@app.after_request",
    "def _set_security_headers(response):",
    "    response.headers['X-Content-Type-Options'] = 'nosniff'",
    "    response.headers['X-Frame-Options'] = 'DENY'",
    "    response.headers['Content-Security-Policy'] = \"default-src 'self'\"",
    "    return response",
]
DB_CLIENT = [
    "# Database client initialization",
    "class _DBClient:",
    "    def execute(self, query, *args, **kwargs):",
    "        return []",
    "db = _DBClient()",
]
# --- end of fixed values ------------------------------------------------------


@dataclass(frozen=True)
class Site:
    """A finding and its file."""

    rule: Column
    message: Column
    i: Column  # 0-based line
    line: Column
    lines: Column
    facts: Column
    py: Column
    indent: Column


# ---- text helpers ------------------------------------------------------------

def sub_first(text: Column, pattern: str, replacement: str) -> Column:
    """Replace the first match only; `$n` in the replacement are the pattern's groups."""
    shifted = re.sub(r"(?<!\\)\$(\d)", lambda m: f"${int(m[1]) + 1}", replacement)
    return F.regexp_replace(text, rf"(?s)\A(.*?)(?-s:{pattern})", "$1" + shifted)


def sub_all(text: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, replacement in pairs:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def put_first(text: Column, needle: Column, value: Column) -> Column:
    """Replace the first occurrence of a literal."""
    at = F.instr(text, needle)
    return F.when((at > 0) & (needle != ""), F.concat(
        F.substr(text, F.lit(1), at - 1), value, F.substr(text, at + F.length(needle)))).otherwise(text)


def as_replacement(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def word(name: Column, before: str = "", after: str = "") -> Column:
    """Pattern of a name between word boundaries."""
    return F.concat(F.lit(before + r"\b"), name, F.lit(r"\b" + after))


def joined(*lines: Column | str) -> Column:
    parts = [F.lit(x) if isinstance(x, str) else x for x in lines]
    return F.concat_ws("\n", *parts)


def is_code(line: Column, py: bool) -> Column:
    t = X.js_trim(line)
    return (t != "") & ~(t.startswith("#") if py else X.starts_with_any(t, "//", "/*", "*"))


def at(lines: Column, i: Column) -> Column:
    return F.coalesce(F.get(lines, i), F.lit(""))


def nearest(s: Site, test: Callable[[Column], Column]) -> Column:
    """struct(at, line) of the nearest line that passes, the one above first on ties."""
    def offset(k: Column) -> Column:
        return F.when(k % 2 == 1, -F.shiftright(k + 1, 1)).otherwise(F.shiftright(k, 1))

    around = F.transform(F.sequence(F.lit(0), F.lit(2 * SEARCH_RADIUS)), lambda k: F.struct(
        (s.i + offset(k)).cast("int").alias("at")))
    inside = F.filter(around, lambda c: (c["at"] >= 0) & (c["at"] < F.size(s.lines)))
    found = F.filter(F.transform(inside, lambda c: F.struct(
        c["at"].alias("at"), F.get(s.lines, c["at"]).alias("line"))), lambda c: test(c["line"]))
    return F.get(found, F.lit(0))


def fix(start: Column, end: Column, old: Column, new: Column, why: Column | str) -> Column:
    return F.struct(
        start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), old.alias("old_snippet"),
        new.alias("new_snippet"), (F.lit(why) if isinstance(why, str) else why).alias("explanation"))


def here(s: Site, new: Column, why: Column | str) -> Column:
    return fix(s.i + 1, s.i + 1, s.line, new, why)


def changed(s: Site, when: Column, new: Column, why: Column | str) -> Column:
    """A one-line fix, if it changes the line."""
    return F.when(when & (new != s.line), here(s, new, why))


def one_of(s: Site, rules: list[str], *texts: str) -> Column:
    return s.rule.isin(rules) | X.contains_any(s.message, *texts) if texts else s.rule.isin(rules)


# ---- bug fixes ---------------------------------------------------------------

def fix_equality(s: Site) -> Column:
    when = one_of(s, ["loose-equality", "eqeqeq", "E711", "E712"],
                  "Loose equality", "=== None", "=== True", "=== False")
    python = sub_all(s.line, (r"==\s*None", "is None"), (r"!=\s*None", "is not None"),
                     (r"==\s*True", "is True"), (r"==\s*False", "is False"))
    script = (
        F.when(s.line.contains("!=") & ~s.line.contains("!=="), F.regexp_replace(s.line, r"!=(?!=)", "!=="))
        .when(s.line.contains("==") & ~s.line.contains("==="), F.regexp_replace(s.line, r"==(?!=)", "==="))
        .otherwise(s.line))
    why = F.when(s.py, "Replaced equality comparison with identity comparison (is None / is True)").otherwise(
        "Replaced loose equality with strict equality to prevent unexpected type coercion")
    return changed(s, when, F.when(s.py, python).otherwise(script), why)


def fix_off_by_one(s: Site) -> Column:
    python = F.regexp_replace(
        s.line, r"range\s*\(\s*(?:0\s*,\s*)?len\s*\(([^)]+)\)\s*\+\s*1\s*\)", "range(len($1))")
    script = F.regexp_replace(s.line, r"<=\s*([a-zA-Z0-9_$.]+)\.length", "< $1.length")
    why = F.when(s.py, "Corrected loop boundary to range(len(...)) to prevent index out-of-bounds").otherwise(
        "Corrected boundary condition from <= to < to avoid index out-of-bounds")
    return changed(s, one_of(s, ["off-by-one"], "off-by-one"), F.when(s.py, python).otherwise(script), why)


def fix_empty_catch(s: Site) -> Column:
    pattern = r"catch\s*(?:\(([^)]+)\))?\s*\{"
    name = X.js_trim(F.regexp_extract(s.line, pattern, 1))
    name = F.when(name == "", "err").otherwise(name)
    new = F.concat(s.line, F.lit("\n"), s.indent, F.lit("  console.error("), name, F.lit(");"))
    return changed(s, one_of(s, ["empty-catch"], "Empty catch block") & s.line.rlike(pattern), new,
                   "Added error logging to prevent errors from being swallowed silently")


def fix_swallowed_error(s: Site) -> Column:
    pattern = r"catch\s*\(([^)]+)\)\s*\{"
    name = X.js_trim(F.regexp_extract(s.line, pattern, 1))
    new = F.concat(s.line, F.lit("\n"), s.indent, F.lit("  console.error('Error caught:', "), name, F.lit(");"))
    return changed(s, one_of(s, ["swallowed-error"], "silently ignored") & s.line.rlike(pattern), new,
                   "Added error logging to swallowed catch block")


def fix_assignment(s: Site) -> Column:
    pattern = r"([a-zA-Z_$][a-zA-Z0-9_$.]*)\s*=(?!=)"
    new = F.when(s.py, sub_first(s.line, pattern, "$1 ==")).otherwise(sub_first(s.line, pattern, "$1 ==="))
    sign = F.when(s.py, "==").otherwise("===")
    return changed(s, one_of(s, ["assignment-in-condition"], "Assignment in condition"), new,
                   F.concat(F.lit("Replaced accidental assignment (=) with equality comparison ("), sign, F.lit(")")))


def fix_duplicate_condition(s: Site) -> Column:
    condition = X.js_trim(F.regexp_extract(s.line, r"^(\s*)if\s*\((.+)\)", 2))
    later = F.transform(F.slice(s.lines, s.i + 2, 49), lambda line, k: F.struct(
        (s.i + 1 + k).alias("at"), line.alias("line")))
    found = F.get(F.filter(later, lambda c: c["line"].contains("else if") & c["line"].contains(condition)), F.lit(0))

    def deactivate(target: Column) -> Column:
        new = sub_first(target["line"], r"else\s+if\s*\([^)]+\)", "/* Duplicate condition removed */ else if (false)")
        return F.when(target.isNotNull(), fix(target["at"] + 1, target["at"] + 1, target["line"], new,
                                              "Deactivated duplicate condition branch in if/else-if chain"))

    when = one_of(s, ["duplicate-condition"], "Duplicate condition") & (condition != "")
    return F.when(when, X.let(found, deactivate))


def fix_unreachable(s: Site) -> Column:
    return F.when(s.rule == "unreachable-code", here(
        s, F.lit(""), "Removed unreachable code after return/throw/break/continue"))


def _is_syntax(s: Site, *more: str) -> Column:
    return one_of(s, ["invalid-syntax", "syntax-error", "E999"], "SyntaxError", "invalid syntax", *more)


def fix_stray_tokens(s: Site) -> Column:
    text = F.regexp_replace(s.line, r"\r$", "")
    tail = F.when(s.line.endswith("\r"), "\r").otherwise("")
    shapes = [
        (r"""^(\s*[a-zA-Z_]\w*\s*=\s*(?:[a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)*\([^)]*\)|['"][^'"]*['"]|\d+|True|False|None))\s*([a-zA-Z_].*?)\s*$""",
         "Removed extraneous syntax tokens (%s)"),
        (r"^(\s*@[a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)*(?:\([^)]*\))?)\s*([a-zA-Z_].*?)\s*$",
         "Removed extraneous syntax tokens (%s)"),
        (r"^(\s*(?:def\s+[a-zA-Z_]\w*\s*\([^)]*\)|class\s+[a-zA-Z_]\w*(?:\([^)]*\))?)\s*:)\s*(.+)$",
         "Removed extraneous syntax tokens after colon (%s)")]
    t = X.js_trim(text)
    out = None
    for pattern, why in shapes:
        branch = here(s, F.concat(F.regexp_extract(text, pattern, 1), tail),
                      F.format_string(why, X.js_trim(F.regexp_extract(text, pattern, 2))))
        out = F.when(text.rlike(pattern), branch) if out is None else out.when(text.rlike(pattern), branch)
    out = out.when(t.rlike(r"^[a-zA-Z_]\w*(?:\s+[a-zA-Z_]\w*)*$") & ~t.rlike(STATEMENT_WORD),
                   here(s, F.lit(""), F.format_string("Removed invalid syntax line '%s'", t)))
    return F.when(_is_syntax(s, "Simple statements must be separated", "Unexpected indentation"), out)


def fix_useless_expression(s: Site) -> Column:
    t = X.js_trim(s.line)
    return F.when(one_of(s, ["B018"], "useless expression") & t.rlike(r"^[a-zA-Z_]\w*$"), here(
        s, F.lit(""), F.format_string("Removed useless expression line '%s'", t)))


def fix_tautology(s: Site) -> Column:
    never, always = r"if\s*\(\s*false\s*\)", r"if\s*\(\s*true\s*\)"
    return F.when(s.rule == "always-true-false", F.when(s.line.rlike(never), here(
        s, F.lit(""), "Removed dead code: if (false) block never executes")).when(s.line.rlike(always), here(
            s, sub_first(s.line, always + r"\s*\{?", "{ // always executes:"),
            "Removed tautological condition { // always executes:")))


# ---- security fixes ----------------------------------------------------------

def fix_flask_run(s: Site) -> Column:
    host = r"""host\s*=\s*['"]0\.0\.0\.0['"]"""
    when = (
        one_of(s, ["B201", "B104"], "debug=True", "debug mode", "0.0.0.0", "bad host", "all interfaces")
        | X.contains_any(s.rule, "avoid_app_run_with_debug", "avoid_app_run_with_bad_host")
    ) & (s.line.contains("debug=True") | s.line.rlike(host))
    debug = F.when(s.line.contains("debug=True"), F.regexp_replace(s.line, r"debug\s*=\s*True", "debug=False")).otherwise(s.line)
    return changed(s, when, F.regexp_replace(debug, host, "host='127.0.0.1'"),
                   "Secured Flask app.run by setting debug=False and binding to 127.0.0.1")


def fix_secret(s: Site) -> Column:
    when = one_of(
        s, ["hardcoded-secret", "hardcoded-aws-key", "hardcoded-github-token", "B105", "B106", "S105", "S106"],
        "hardcoded", "Hardcoded") | X.contains_any(s.rule, "hardcoded", "secret", "password")
    py_pattern = r"""^(\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*)['"][^'"]+['"]"""
    js_pattern = r"""^(\s*(?:const|let|var)\s+([a-zA-Z0-9_]+)\s*=\s*)['"][^'"]+['"]"""
    any_name = s.rule.isin("B105", "hardcoded-secret")
    found = nearest(s, lambda line: is_code(line, True) & line.rlike(py_pattern) & (
        F.regexp_extract(line, py_pattern, 2).rlike(SECRET_NAME) | any_name))

    def from_environment(target: Column) -> Column:
        py_name = F.regexp_extract(target["line"], py_pattern, 2)
        return F.when(target.isNotNull(), fix(
            target["at"] + 1, target["at"] + 1, target["line"],
            F.concat(F.regexp_extract(target["line"], py_pattern, 1), F.format_string("os.environ.get('%s', '')", py_name)),
            F.format_string("Moved hardcoded secret to os.environ.get('%s')", py_name)))

    python = X.let(found, from_environment)
    js_name = F.regexp_extract(s.line, js_pattern, 2)
    script = F.when(s.line.rlike(js_pattern), here(
        s, F.concat(F.regexp_extract(s.line, js_pattern, 1), F.lit("process.env."), js_name, F.lit(" || ''")),
        F.concat(F.lit("Moved hardcoded secret to process.env."), js_name)))
    return F.when(when, F.when(s.py, python).otherwise(script))


def fix_sql_template(s: Site) -> Column:
    names = F.transform(F.regexp_extract_all(s.line, F.lit(r"\$\{([^}]+)\}"), F.lit(1)), X.js_trim)
    listed = F.array_join(names, ", ")
    start = F.struct(F.lit(0).alias("n"), s.line.alias("text"))
    numbered = F.aggregate(names, start, lambda acc, v: F.struct(
        (acc["n"] + 1).alias("n"),
        put_first(acc["text"], F.concat(F.lit("${"), v, F.lit("}")),
                  F.concat(F.lit("$"), (acc["n"] + 1).cast("string"))).alias("text")), lambda acc: acc["text"])
    quoted = F.replace(numbered, F.lit("`"), F.lit("'"))

    def with_arguments(text: Column) -> Column:
        call = F.concat(F.lit(", ["), as_replacement(listed), F.lit("])"))
        ended = F.regexp_replace(text, F.lit(r"\)\s*\z"), call)
        semi = F.regexp_replace(ended, F.lit(r"(?s)\A(.*?)\)\s*;"), F.concat(F.lit("$1"), call, F.lit(";")))
        return F.when(text.rlike(r"\.(query|execute)\s*\("), semi).otherwise(text)

    return X.let(quoted, lambda q: changed(
        s, one_of(s, ["sql-injection-template"], "variable interpolation in SQL") & (q != s.line), with_arguments(q),
        F.format_string("Parameterized SQL query with parameters [%s]", listed)))


def fix_sql_concat(s: Site) -> Column:
    new = sub_first(s.line, r"""(['"][^'"]*)(['"])\s*\+\s*([a-zA-Z_$][a-zA-Z0-9_$.]*)""", r"$1 \$1$2, [$3]")
    return changed(s, one_of(s, ["sql-injection-concat"], "SQL query constructed via string concatenation"), new,
                   "Converted string concatenation to parameterized query")


def _tuple_text(names: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(names, ", "), F.when(F.size(names) == 1, ",)").otherwise(")"))


def fix_py_sql(s: Site) -> Column:
    when = (
        s.rule.isin("py-sql-injection-fstring", "py-sql-injection-concat", "B608", "S608")
        | X.contains_any(s.rule, "tainted-sql-string", "formatted-sql-query", "sql-injection")
        | (s.py & X.contains_any(s.message, "SQL injection", "SQL query", "parameterized query", "SQL string")))
    found = nearest(s, lambda line: is_code(line, True) & (
        line.rlike(r"""(?i)f["'].*(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE)""")
        | (line.contains("query") & line.rlike(r"""f["']"""))))

    def bare(text: Column, v: Column) -> Column:
        for quote in ("'", '"', ""):
            text = put_first(text, F.concat(F.lit(quote + "{"), v, F.lit("}" + quote)), F.lit("%s"))
        return text

    def parameterise(target: Column) -> Column:
        old = target["line"]
        names = F.transform(F.regexp_extract_all(old, F.lit(r"\{([^}]+)\}"), F.lit(1)), X.js_trim)
        parts = F.struct(
            sub_first(F.aggregate(names, old, lambda text, v: X.let(text, lambda t: bare(t, v))), r"""f(["'])""", "$1").alias("placed"),
            at(s.lines, target["at"] + 1).alias("following"), _tuple_text(names).alias("arguments"))

        def choose(p: Column) -> Column:
            call = "db.execute(query)"
            called = put_first(p["following"], F.lit(call), F.concat(F.lit("db.execute(query, "), p["arguments"], F.lit(")")))
            two = fix(target["at"] + 1, target["at"] + 2, joined(old, p["following"]), joined(p["placed"], called),
                      "Converted f-string SQL to parameterized query with %s placeholders and parameter tuple")
            single = F.when(p["placed"] != old, fix(
                target["at"] + 1, target["at"] + 1, old, p["placed"],
                "Converted f-string SQL to parameterized query with %s placeholders"))
            return F.when(p["following"].contains(call), two).otherwise(single)

        return F.when(target.isNotNull(), X.let(parts, choose))

    return F.when(when, X.let(found, parameterise))


def fix_js_eval(s: Site) -> Column:
    when = (s.rule == "code-injection-eval") | (~s.py & s.message.contains("eval()"))
    return changed(s, when, sub_first(s.line, r"\beval\s*\(([^)]+)\)", r"JSON.parse($1)"),
                   "Replaced hazardous eval() with safe JSON.parse()")


def fix_py_eval(s: Site) -> Column:
    when = (
        s.rule.isin("py-code-injection", "B307", "B102", "S307", "S102")
        | X.contains_any(s.rule, "user-eval", "user-exec", "code-injection")
        | (s.py & X.contains_any(s.message, "eval", "exec")))
    is_exec = s.rule.isin("B102", "S102") | s.rule.contains("exec") | s.message.contains("exec")
    is_eval = s.rule.isin("B307", "S307") | s.rule.contains("eval") | s.message.contains("eval")
    exec_found = nearest(s, lambda line: is_code(line, True) & line.rlike(r"\bexec\s*\("))
    eval_found = nearest(s, lambda line: is_code(line, True) & line.rlike(r"\beval\s*\("))

    def remove_exec(target: Column) -> Column:
        indent = F.regexp_extract(target["line"], r"^(\s*)", 1)
        disabled = F.concat(
            indent, F.lit(f"# Dynamic execution disabled by {NATIVE_TOOL}\n"), indent,
            F.lit('raise NotImplementedError("Dynamic execution disabled")'))
        first = F.greatest(target["at"] - 5, F.lit(0))
        before = F.transform(F.slice(s.lines, first + 1, target["at"] - first), lambda line, k: F.struct(
            (first + k).alias("at"), line.alias("line")))
        assigned = F.get(F.filter(before, lambda c: c["line"].rlike(r"^\s*[a-zA-Z_]\w*\s*=\s*request\.")), F.lit(0))

        def replace(taken: Column) -> Column:
            name = F.regexp_extract(taken["line"], r"^\s*([a-zA-Z_]\w*)\s*=", 1)
            renamed = put_first(taken["line"], name, F.concat(F.lit("_"), name))
            between = F.slice(s.lines, taken["at"] + 2, target["at"] - taken["at"] - 1)
            block = F.array_join(F.slice(s.lines, taken["at"] + 1, target["at"] - taken["at"] + 1), "\n")
            with_input = fix(taken["at"] + 1, target["at"] + 1, block,
                             F.array_join(F.concat(F.array(renamed), between, F.array(disabled)), "\n"),
                             "Removed dynamic exec call and prefixed unused parameter with _")
            alone = fix(target["at"] + 1, target["at"] + 1, target["line"], disabled,
                        "Removed dynamic exec call to prevent arbitrary code execution")
            return F.when(taken.isNotNull(), with_input).otherwise(alone)

        return X.let(assigned, replace)

    def choose(t: Column) -> Column:
        run, literal_at = t["exec"], t["eval"]
        literal = fix(literal_at["at"] + 1, literal_at["at"] + 1, literal_at["line"],
                      sub_first(literal_at["line"], r"\beval\s*\(([^)]+)\)", "ast.literal_eval($1)"),
                      "Replaced unsafe eval() with ast.literal_eval() for safe data parsing")
        use_eval = (is_eval | ~is_exec) & literal_at.isNotNull()
        # An exec finding looks for exec first, any other for eval first.
        return F.when(run.isNotNull() & (is_exec | ~use_eval), remove_exec(run)).when(use_eval, literal)

    return F.when(when, X.let(F.struct(exec_found.alias("exec"), eval_found.alias("eval")), choose))


def fix_function_constructor(s: Site) -> Column:
    stub = f'(() => {{ throw new Error("Dynamic Function constructor removed by {NATIVE_TOOL}"); }})'
    return changed(s, s.rule == "code-injection-function", sub_first(s.line, r"new\s+Function\s*\(([^)]*)\)", stub),
                   "Removed dynamic Function constructor to prevent code injection")


def fix_js_command(s: Site) -> Column:
    new = sub_all(s.line, (r"\bexecSync\b", "execFileSync"), (r"\bexec\b(?!File)", "execFile"))
    return changed(s, s.rule == "command-injection", new,
                   "Replaced exec() with execFile() to prevent shell command injection")


def fix_py_command(s: Site) -> Column:
    when = s.rule.isin("py-command-injection", "B602", "S602") | (s.py & s.message.contains("command injection"))
    new = sub_first(F.regexp_replace(s.line, r"shell\s*=\s*True", "shell=False"),
                    r"os\.system\s*\(([^)]+)\)", "subprocess.run(shlex.split($1), check=True)")
    return changed(s, when, new, "Disabled shell=True to prevent command injection")


def fix_path_traversal(s: Site) -> Column:
    py_line = sub_first(sub_first(s.line, r"""file_path\s*=\s*f?['"][^'"]*['"]""", "file_path = safe_path"),
                        "filename", "os.path.basename(filename)")
    js_line = sub_first(sub_first(s.line, r"path\.join\([^)]+\)", "safePath"), "filePath|file", "safePath")
    python = joined(
        F.concat(s.indent, F.lit(f"# {NATIVE_TOOL}: Sanitize filepath to prevent directory traversal")),
        F.concat(s.indent, F.lit("safe_path = os.path.abspath(os.path.join('/uploads', os.path.basename(filename)))")), py_line)
    script = joined(
        F.concat(s.indent, F.lit(f"// {NATIVE_TOOL}: Validate resolved path stays within base directory")),
        F.concat(s.indent, F.lit("const safePath = path.resolve(path.join(__dirname, path.basename(req.params.filename || '')));")),
        js_line)
    why = F.when(s.py, "Added path sanitization using os.path.basename() to prevent directory traversal").otherwise(
        "Added path sanitization using path.basename() and path.resolve() to prevent directory traversal")
    return F.when(one_of(s, ["path-traversal"], "directory traversal"),
                  here(s, F.when(s.py, python).otherwise(script), why))


def fix_weak_hash(s: Site) -> Column:
    when = one_of(s, ["weak-crypto-hash", "py-weak-crypto-hash", "B303", "S303"],
                  "MD5", "SHA1", "weak cryptographic hashing")
    python = F.regexp_replace(s.line, r"hashlib\.(?:md5|sha1)\s*\(", "hashlib.sha256(")
    script = F.regexp_replace(s.line, r"""(?i)['"](?:md5|sha1)['"]""", "'sha256'")
    return changed(s, when, F.when(s.py, python).otherwise(script), "Upgraded weak MD5/SHA1 hash to SHA-256")


def fix_prototype(s: Site) -> Column:
    new = sub_first(sub_all(
        s.line, (r'\["__proto__"\]', '["__proto__" /* BLOCKED */]'), (r"\['__proto__'\]", "['__proto__' /* BLOCKED */]")),
        r"\.__proto__\s*=", ".constructor.prototype = /* BLOCKED */ ")
    return changed(s, s.rule == "prototype-pollution", new,
                   "Blocked direct __proto__ modification to prevent prototype pollution")


def _pickle_to_json(s: Site, why: str) -> Column:
    first = s.facts["pickle"]
    return F.when(first.isNotNull(), fix(first["at"] + 1, first["at"] + 1, first["line"],
                                         F.regexp_replace(first["line"], PICKLE_LOAD, "json.loads("), why))


def _without_name(line: Column, name: Column) -> Column:
    """Drop a name from an import list."""
    out = F.regexp_replace(line, word(name, after=r"\s*,\s*"), F.lit(""))
    return F.regexp_replace(out, word(name, before=r",\s*"), F.lit(""))


def fix_unused_import(s: Site) -> Column:
    when = one_of(s, ["F401"], "imported but unused")
    name = F.regexp_extract(s.message, r"""[`'"]([a-zA-Z0-9_]+)[`'"]\s+imported but unused""", 1)
    listed = _without_name(s.line, name)
    alone = F.regexp_like(s.line, F.concat(F.lit(r"^\s*import\s+"), name, F.lit(r"\s*$"))) | F.regexp_like(
        s.line, F.concat(F.lit(r"^\s*from\s+[\w.]+\s+import\s+"), name, F.lit(r"\s*$")))
    new = F.when((listed == s.line) & alone, "").otherwise(listed)
    swap = (name == "json") & s.py & s.facts["has_pickle"]
    usual = F.when(swap & s.facts["pickle"].isNotNull(), _pickle_to_json(
        s, "Replaced hazardous pickle deserialization with json.loads()")).when(
        new != s.line, here(s, new, F.format_string("Removed unused import '%s'", name)))
    # Dotted or unquoted names.
    loose = F.regexp_extract(s.message, r"""[`'"]?([a-zA-Z0-9_.]+)[`'"]?\s+imported but unused""", 1)
    short = F.substring_index(loose, ".", -1)
    t = X.js_trim(s.line)
    is_whole = (t == F.concat(F.lit("import "), loose)) | (t == F.concat(F.lit("import "), short))
    second = (
        F.when(is_whole, F.concat(F.lit("# unused import '"), loose, F.lit("' removed")))
        .when(s.line.contains("import"), _without_name(s.line, short)).otherwise(s.line))
    fallback = F.when((loose != "") & (second != s.line), here(
        s, second, F.format_string("Removed unused import '%s'", loose)))
    return F.when(when, F.coalesce(F.when(name != "", usual), fallback))


def fix_pickle(s: Site) -> Column:
    when = (
        s.rule.isin("B301", "py-unsafe-deserialization")
        | X.contains_any(s.rule, "insecure-deserialization", "unsafe-deserialization")
        | (s.py & s.message.contains("pickle") & X.contains_any(s.message, "unsafe", "deserialization", "deserialize")))
    found = nearest(s, lambda line: is_code(line, True) & line.rlike(PICKLE_LOAD))
    return F.when(when, X.let(found, lambda target: F.when(target.isNotNull(), fix(
        target["at"] + 1, target["at"] + 1, target["line"], F.regexp_replace(target["line"], PICKLE_LOAD, "json.loads("),
        "Replaced hazardous pickle deserialization with json.loads()"))))


def fix_advisory_import(s: Site) -> Column:
    when = s.py & (s.rule.isin("B403", "B404") | s.message.startswith("Consider possible security implications"))
    def swap(module: str, new: str, why: str) -> Column:
        found = nearest(s, lambda line: is_code(line, True) & line.rlike(rf"^\s*import\s+{module}\b"))
        return X.let(found, lambda target: F.when(target.isNotNull(), fix(
            target["at"] + 1, target["at"] + 1, target["line"], F.lit(new), why)))

    return F.when(when, F.coalesce(
        swap("pickle", f"import json  # replaced insecure pickle with json ({NATIVE_TOOL})",
             "Replaced insecure pickle import with json module for safe serialization"),
        swap("subprocess", f"import subprocess  # noqa: B404 — validated safe usage ({NATIVE_TOOL})",
             "Acknowledged subprocess import security advisory with noqa annotation")))


def fix_unused_variable(s: Site) -> Column:
    named = F.regexp_extract(s.message, r"""[`'"]([a-zA-Z_]\w*)[`'"]""", 1)
    assigned = F.when(named != "", F.concat(F.lit(r"^\s*"), named, F.lit(r"\s*="))).otherwise(r"^\s*[a-zA-Z_]\w*\s*=")
    found = nearest(s, lambda line: F.when(s.py, is_code(line, True)).otherwise(is_code(line, False)) & F.regexp_like(line, assigned))

    def prefix(target: Column) -> Column:
        name = F.when(named != "", named).otherwise(F.regexp_extract(target["line"], r"^\s*([a-zA-Z_]\w*)\s*=", 1))
        new = F.regexp_replace(target["line"], F.concat(F.lit(r"\A(.*?)\b"), name, F.lit(r"\b")), F.concat(F.lit("$1_"), name))
        return F.when(target.isNotNull(), fix(target["at"] + 1, target["at"] + 1, target["line"], new, F.format_string(
            "Prefixed unused variable '%s' with '_' to indicate intentionally unused variable", name)))

    near = X.let(found, prefix)
    local = F.regexp_extract(s.message, r"""Local variable\s+[`'"]?([a-zA-Z0-9_]+)[`'"]?""", 1)
    direct = F.regexp_replace(s.line, F.concat(F.lit(r"\A(.*?)\b"), local, F.lit(r"\s*=")), F.concat(F.lit("$1_"), local, F.lit(" =")))
    fallback = F.when((local != "") & (direct != s.line), here(
        s, direct, F.format_string("Prefixed unused variable '%s' with underscore convention", local)))
    return F.when(one_of(s, ["F841"], "assigned to but never used"), F.coalesce(near, fallback))


# ---- efficiency, resources and style -----------------------------------------

def fix_sync_call(s: Site) -> Column:
    names = [("readFileSync", "readFile"), ("writeFileSync", "writeFile"), ("statSync", "stat"), ("readdirSync", "readdir"),
             ("existsSync", "access"), ("mkdirSync", "mkdir"), ("unlinkSync", "unlink")]
    new = sub_all(s.line, *[(rf"fs\.{a}\s*\(", f"await fs.promises.{b}(") for a, b in names])
    return changed(s, s.rule == "sync-in-async", new,
                   "Replaced synchronous filesystem call with async variant to avoid blocking event loop")


def fix_open(s: Site) -> Column:
    pattern = r"^(\s*)(\w+)\s*=\s*(open\s*\([^)]+\))"
    when = one_of(s, ["py-open-no-with", "SIM115"], "Use a `with` statement when opening files", "open without with")
    new = F.concat(F.regexp_extract(s.line, pattern, 1), F.lit("with "), F.regexp_extract(s.line, pattern, 3),
                   F.lit(" as "), F.regexp_extract(s.line, pattern, 2), F.lit(":"))
    return changed(s, when & s.line.rlike(pattern), new,
                   'Wrapped file open() in "with" statement for automatic resource cleanup')


def fix_inner_html(s: Site) -> Column:
    return changed(s, s.rule == "xss-dangerously-set-inner-html",
                   sub_first(s.line, r"__html:\s*([^}]+)", r"__html: DOMPurify.sanitize($1)"),
                   "Added DOMPurify.sanitize() to prevent Cross-Site Scripting (XSS)")


def fix_generics(s: Site) -> Column:
    when = one_of(s, ["UP006"], "instead of `List`", "instead of `Dict`", "instead of `Set`", "instead of `Tuple`")
    new = sub_all(s.line, *[(rf"\b{n}\[", f"{n.lower()}[") for n in ("List", "Dict", "Set", "Tuple")])
    return changed(s, when, new, "Upgraded deprecated typing generics to modern built-in type annotations (PEP 585)")


def fix_optional(s: Site) -> Column:
    return changed(s, one_of(s, ["UP045"], "X | None"),
                   F.regexp_replace(s.line, r"\bOptional\s*\[\s*([^\]]+)\s*\]", "$1 | None"),
                   "Modernized Optional[T] annotation to T | None union syntax (PEP 604)")


IF_LINE = r"^(\s*)if\s+([^:]+):"


def fix_return_condition(s: Site) -> Column:
    a, b, c = (at(s.lines, s.i + n) for n in (1, 2, 3))
    with_else = b.contains("else:")
    shaped = a.contains("return True") & ((with_else & c.contains("return False")) | b.contains("return False"))
    block = F.when(with_else, joined(s.line, a, b, c)).otherwise(joined(s.line, a, b))
    new = F.concat(F.regexp_extract(s.line, IF_LINE, 1), F.lit("return bool("),
                   X.js_trim(F.regexp_extract(s.line, IF_LINE, 2)), F.lit(")"))
    when = one_of(s, ["SIM103"], "Return the condition directly") & s.line.rlike(IF_LINE) & shaped
    return F.when(when, fix(s.i + 1, s.i + 1 + F.when(with_else, 3).otherwise(2), block, new,
                            "Replaced redundant if-return boolean branch with direct boolean return"))


def fix_nested_if(s: Site) -> Column:
    inner = at(s.lines, s.i + 1)
    new = F.concat(F.regexp_extract(s.line, IF_LINE, 1), F.lit("if "), X.js_trim(F.regexp_extract(s.line, IF_LINE, 2)),
                   F.lit(" and "), X.js_trim(F.regexp_extract(inner, IF_LINE, 2)), F.lit(":"))
    when = one_of(s, ["SIM102"], "nested `if` statements") & s.line.rlike(IF_LINE) & inner.rlike(IF_LINE)
    return F.when(when, fix(s.i + 1, s.i + 2, joined(s.line, inner), new,
                            "Combined nested if statements into single condition with and"))


def fix_mutable_default(s: Site) -> Column:
    return changed(s, one_of(s, ["B006"], "mutable data structures for argument defaults"),
                   sub_all(s.line, (r"=\s*\[\s*\]", "=None"), (r"=\s*\{\s*\}", "=None")),
                   "Replaced mutable default parameter with None to avoid unexpected state persistence")


def fix_bare_except(s: Site) -> Column:
    return changed(s, one_of(s, ["E722"], "bare `except`"), sub_first(s.line, r"except\s*:", "except Exception:"),
                   "Replaced bare except with explicit except Exception")


def fix_blind_except(s: Site) -> Column:
    return changed(s, one_of(s, ["BLE001"], "blind exception"),
                   sub_first(s.line, r"except\s+Exception\s*:", "except Exception as err:"),
                   "Captured blind exception instance for error inspection and logging")


def fix_silent_pass(s: Site) -> Column:
    when = one_of(s, ["S110", "B110"], "try`-`except`-`pass", "try, except, pass") & (X.js_trim(s.line) == "pass")
    new = F.concat(s.indent, F.lit("import logging\n"), s.indent, F.lit('logging.exception("Handled unexpected exception")'))
    return F.when(when, here(s, new, "Replaced silent pass with error logging to prevent suppressed exceptions"))


def fix_timeout(s: Site) -> Column:
    when = one_of(s, ["B113"], "call without timeout") & ~s.line.contains("timeout=")
    new = s.line
    for verb in ("delete", "put", "post", "get"):
        new = F.when(s.line.contains(f"requests.{verb}("), sub_first(
            s.line, rf"requests\.{verb}\(([^)]+)\)", f"requests.{verb}($1, timeout=10)")).otherwise(new)
    return changed(s, when, new, "Added timeout=10 to remote HTTP request to prevent indefinite hanging")


def fix_bind_address(s: Site) -> Column:
    return changed(s, one_of(s, ["B104"], "all interfaces"), sub_first(s.line, r"""['"]0\.0\.0\.0['"]""", "'127.0.0.1'"),
                   "Restricted host binding from 0.0.0.0 to localhost (127.0.0.1)")


def fix_unbounded(s: Site) -> Column:
    collection, plain = r"const\s+(\w+)\s*=\s*new\s+(Map|Set)\(\);?", r"const\s+(\w+)\s*=\s*\{\};?"
    name, kind = F.regexp_extract(s.line, collection, 1), F.regexp_extract(s.line, collection, 2)
    bound = F.concat(F.lit("MAX_"), F.upper(name), F.lit("_SIZE"))
    title = F.concat(F.upper(F.substring(name, 1, 1)), F.substr(name, F.lit(2)))
    pruned = joined(
        s.line, F.concat(s.indent, F.lit("const "), bound, F.lit(" = 5000;")),
        F.concat(s.indent, F.lit(f"// {NATIVE_TOOL}: eviction guard helper")),
        F.concat(s.indent, F.lit("function prune"), title, F.lit("() { while ("), name, F.lit(".size > "), bound, F.lit(") "),
                 name, F.lit(".delete("), name, F.lit(".keys().next().value); }")))
    other = F.regexp_extract(s.line, plain, 1)
    capped = joined(s.line, F.concat(s.indent, F.lit("const MAX_"), F.upper(other), F.lit("_KEYS = 5000;")))
    return F.when(one_of(s, ["unbounded-cache"], "unbounded growth"), F.when(s.line.rlike(collection), here(
        s, pruned, F.format_string("Added capacity bound and FIFO eviction helper for %s '%s'", kind, name))).when(
        s.line.rlike(plain), here(
            s, capped, F.format_string("Added maximum capacity threshold constant for object cache '%s'", other))))


def fix_stream(s: Site) -> Column:
    name = F.regexp_extract(s.line, r"(?:const|let|var)\s+(\w+)\s*=", 1)
    def handler(event: str) -> Column:
        return F.concat(s.indent, name, F.lit(f".on('{event}', () => "), name, F.lit(".destroy());"))

    return F.when(one_of(s, ["stream-no-close"], "Stream opened but never closed") & (name != ""), here(
        s, joined(s.line, handler("end"), handler("error")), F.format_string(
            "Added automatic stream cleanup and destruction handlers on end and error for '%s'", name)))


def fix_interval(s: Site) -> Column:
    t = X.js_trim(s.line)
    new = joined(F.concat(s.indent, F.lit("const intervalTimer = "), t),
                 F.concat(s.indent, F.lit(f"// {NATIVE_TOOL}: remember to clearInterval(intervalTimer) on teardown")))
    return F.when(one_of(s, ["setinterval-no-clear"], "setInterval without matching clearInterval")
                  & t.startswith("setInterval("), here(
        s, new, "Stored setInterval handle into intervalTimer for clearInterval cleanup"))


def fix_listener(s: Site) -> Column:
    pattern = r"""(\w+)\.addEventListener\s*\(\s*['"]([^'"]+)['"]\s*,\s*(\w+)"""
    target, event, handler = (F.regexp_extract(s.line, pattern, n) for n in (1, 2, 3))
    new = joined(s.line, F.concat(s.indent, F.format_string(
        "// Teardown: %s.removeEventListener('%s', %s);", target, event, handler)))
    return F.when(one_of(s, ["listener-no-remove"], "addEventListener without matching removeEventListener")
                  & (target != ""), here(
        s, new, F.format_string("Added cleanup teardown hook for event listener '%s'", event)))


def fix_loop_regex(s: Site) -> Column:
    pattern = r"(?:const|let|var)\s+(\w+)\s*=\s*(new\s+RegExp\([^)]+\)|/[^/]+/[a-z]*);?"
    name, expression = F.regexp_extract(s.line, pattern, 1), F.regexp_extract(s.line, pattern, 2)
    new = joined(F.format_string("// Hoisted outside loop: const %s = %s;", name, expression),
                 put_first(s.line, expression, name))
    return F.when(one_of(s, ["regex-in-loop"], "RegExp created inside loop") & s.line.rlike(pattern), here(
        s, new, "Hoisted RegExp compilation outside loop to avoid redundant compilation"))


# ---- fixes that need the whole file ------------------------------------------

def fix_security_headers(s: Site) -> Column:
    flask, express = s.facts["flask_app"], s.facts["express_app"]
    python = F.when(flask.isNotNull(), fix(
        flask["at"] + 1, flask["at"] + 1, flask["line"], joined(flask["line"], "", *FLASK_HEADERS),
        "Mounted security headers middleware (@app.after_request with X-Frame-Options, CSP, nosniff)"))
    script = F.when(express.isNotNull(), fix(
        express["at"] + 1, express["at"] + 1, express["line"],
        joined("const helmet = require('helmet');", express["line"], "app.use(helmet());"),
        "Installed Helmet security middleware on Express application"))
    return F.when(one_of(s, ["deployguard-missing-security-headers"], "security headers middleware"),
                  F.when(s.py, python).otherwise(script))


def fix_sql_assignment(s: Site) -> Column:
    pattern = r"""(?i)(query|sql|stmt)\s*=\s*f["'](SELECT|INSERT|UPDATE|DELETE)\s+([^"']+)["']"""
    first = F.greatest(s.i - 3, F.lit(0))
    near = F.transform(F.slice(s.lines, first + 1, s.i + 4 - first), lambda line, k: F.struct(
        (first + k).alias("at"), line.alias("line")))
    found = F.get(F.filter(near, lambda c: c["line"].rlike(pattern) & F.regexp_extract(
        c["line"], pattern, 0).rlike(r"\{[a-zA-Z_]\w*\}")), F.lit(0))

    def parameterise(target: Column) -> Column:
        name, whole = F.regexp_extract(target["line"], pattern, 1), F.regexp_extract(target["line"], pattern, 0)
        names = F.regexp_extract_all(whole, F.lit(r"\{([a-zA-Z_]\w*)\}"), F.lit(1))
        text = F.regexp_replace(sub_first(whole, r"""f(["'])""", "$1"), r"""['"]?\{[a-zA-Z_]\w*\}['"]?""", "%s")
        following = at(s.lines, target["at"] + 1)
        runs = following.contains(name) & following.contains(".execute(")
        called = F.regexp_replace(following, F.concat(F.lit(r"\.execute\(\s*"), name, F.lit(r"\s*\)")), F.concat(
            F.lit(".execute("), name, F.lit(", "), as_replacement(_tuple_text(names)), F.lit(")")))
        return F.when(target.isNotNull(), F.when(runs, fix(
            target["at"] + 1, target["at"] + 2, joined(target["line"], following), joined(text, called),
            "Converted vulnerable SQL string interpolation to parameterized query with parameter tuple")).otherwise(fix(
                target["at"] + 1, target["at"] + 1, target["line"], text,
                "Parameterized SQL query placeholder to prevent SQL injection")))

    when = s.py & ((s.rule == "B608") | F.lower(s.rule).contains("sql-injection") | s.message.contains("SQL injection"))
    return F.when(when, X.let(found, parameterise))


DEF_WITH_TAIL = r"^(\s*def\s+[a-zA-Z_]\w*\s*\([^)]*\)\s*:)\s*(.+)$"


def strip_def_tail(line: Column) -> Column:
    """Cut stray words behind a function header."""
    tail = X.js_trim(F.regexp_extract(line, DEF_WITH_TAIL, 2))
    return F.when(tail.rlike(WORDS_ONLY), F.regexp_extract(line, DEF_WITH_TAIL, 1)).otherwise(line)


def is_stray_words(line: Column) -> Column:
    t = X.js_trim(line)
    return t.rlike(WORDS_ONLY) & ~F.split(t, r"\s+")[0].isin(PYTHON_KEYWORDS)


def fix_def_tail(s: Site) -> Column:
    when = s.py & (s.rule.isin("E999", "syntax-error") | X.contains_any(
        s.message, "SyntaxError", "invalid syntax", "unindent does not match"))
    return F.when(when, F.when(strip_def_tail(s.line) != s.line, here(
        s, strip_def_tail(s.line), "Removed stray gibberish after function definition header")).when(
        is_stray_words(s.line), here(s, F.lit(""), "Removed syntactically invalid gibberish line")))


def _append_to_import(first: Column, name: Column, pattern: str, why: Column) -> Column:
    new = F.regexp_replace(first["line"], F.lit(pattern), F.concat(F.lit("$1$2, "), name))
    return F.when(first.isNotNull(), fix(first["at"] + 1, first["at"] + 1, first["line"], new, why))


def fix_undefined_name(s: Site) -> Column:
    when = one_of(s, ["F821", "undefined-variable"], "Undefined name", "Undefined variable")
    name = F.regexp_extract(s.message, r"""[`'"]([a-zA-Z_]\w*)[`'"]""", 1)
    added = F.concat(F.lit("import "), name)
    why = F.format_string("Added missing 'import %s' to resolve undefined name", name)
    last, first_line = s.facts["last_import"], at(s.lines, F.lit(0))
    missing = ~F.exists(s.facts["imported"], lambda n: n.startswith(name))
    stdlib = F.when(s.py & name.isin(KNOWN_STDLIB) & missing, F.when(last.isNotNull(), fix(
        last["at"] + 1, last["at"] + 1, last["line"], joined(last["line"], added), why)).otherwise(fix(
            F.lit(1), F.lit(1), first_line, joined(added, first_line), why)))
    flask_lines = F.filter(s.facts["flask_imports"], lambda c: ~c["line"].contains(name))
    flask = F.when(s.py & name.isin(FLASK_FUNCTIONS), _append_to_import(
        F.get(flask_lines, F.lit(0)), name, r"(from\s+flask\s+import\s+)(.+)",
        F.format_string("Added missing '%s' to Flask imports to resolve undefined name", name)))
    app = s.facts["flask_app"]
    database = F.when(s.py & (name == "db") & ~s.facts["has_db"] & app.isNotNull(), fix(
        app["at"] + 1, app["at"] + 1, app["line"], joined(app["line"], "", *DB_CLIENT),
        "Initialized database client 'db' at module level to resolve undefined name"))
    stray = F.when(X.js_trim(s.line) == name, here(
        s, F.lit(""), F.format_string("Removed undefined stray token '%s'", name)))
    pickle = F.when((name == "pickle") & s.py, _pickle_to_json(
        s, "Replaced insecure pickle deserialization with json.loads()"))
    return F.when(when & (name != ""), F.coalesce(pickle, stdlib, flask, database, stray))


def fix_missing_import(s: Site) -> Column:
    name = F.regexp_extract(s.message, r"'([a-zA-Z_]\w*)'", 1)
    usable = F.filter(s.facts["framework_imports"], lambda c: ~c["line"].contains(name))
    return F.when((s.rule == "missing-import") & (name != ""), _append_to_import(
        F.get(usable, F.lit(0)), name, r"(from\s+\S+\s+import\s+)(.+)",
        F.format_string("Added missing '%s' to framework imports", name)))


def fix_import_order(s: Site) -> Column:
    block = s.facts["import_block"]
    old = F.array_join(F.slice(s.lines, block["first"] + 1, block["last"] - block["first"] + 1), "\n")
    # Order by text without case, as a collation does; equal keys keep their order.
    def ordered(rows: Column) -> Column:
        keyed = F.transform(rows, lambda line, k: F.struct(
            F.lower(X.js_trim(line)).alias("k"), k.alias("n"), line.alias("line")))
        return F.transform(F.array_sort(keyed), lambda e: e["line"])

    new = F.array_join(F.concat(ordered(block["from_lines"]), ordered(block["import_lines"])), "\n")
    return F.when(s.py & one_of(s, ["I001"], "un-sorted") & block["first"].isNotNull() & (new != old), fix(
        block["first"] + 1, block["last"] + 1, old, new,
        "Sorted Python import block (from imports first, then standard imports)"))


RULE_FIXES = [
    fix_equality, fix_off_by_one, fix_empty_catch, fix_swallowed_error, fix_assignment, fix_duplicate_condition,
    fix_unreachable, fix_stray_tokens, fix_useless_expression, fix_tautology, fix_flask_run, fix_secret,
    fix_sql_template, fix_sql_concat, fix_py_sql, fix_js_eval, fix_py_eval, fix_function_constructor, fix_js_command,
    fix_py_command, fix_path_traversal, fix_weak_hash, fix_prototype, fix_unused_import, fix_pickle,
    fix_advisory_import, fix_unused_variable, fix_sync_call, fix_open, fix_inner_html, fix_generics, fix_optional,
    fix_return_condition, fix_nested_if, fix_mutable_default, fix_bare_except, fix_blind_except, fix_silent_pass,
    fix_timeout, fix_bind_address, fix_unbounded, fix_stream, fix_interval, fix_listener, fix_loop_regex,
    fix_security_headers, fix_sql_assignment, fix_def_tail, fix_undefined_name, fix_missing_import, fix_import_order,
]


def file_facts(lines: Column, content: Column) -> Column:
    """What whole-file fixes need to know, computed once per file."""
    def rows(pattern: str) -> Column:
        indexed = F.transform(lines, lambda line, k: F.when(
            line.rlike(pattern), F.struct(k.alias("at"), line.alias("line"))))
        return F.filter(indexed, lambda c: c.isNotNull())

    def first(pattern: str) -> Column:
        return F.get(rows(pattern), F.lit(0))

    imports = F.filter(F.transform(lines, lambda line, k: F.when(
        X.starts_with_any(X.js_trim(line), "import ", "from "), F.struct(k.alias("at"), line.alias("line")))),
        lambda c: c.isNotNull())
    sortable = F.filter(imports, lambda c: ~X.js_trim(c["line"]).startswith("import {"))

    def text_of(prefix: str) -> Column:
        return F.transform(F.filter(sortable, lambda c: X.js_trim(c["line"]).startswith(prefix)), lambda c: c["line"])

    return F.struct(
        first(PICKLE_LOAD).alias("pickle"), content.rlike(r"\bpickle\.loads?\b").alias("has_pickle"),
        first(FLASK_APP).alias("flask_app"), first(EXPRESS_APP).alias("express_app"),
        F.get(imports, F.size(imports) - 1).alias("last_import"),
        F.regexp_extract_all(content, F.lit(r"import (\w+)"), F.lit(1)).alias("imported"),
        rows(r"^from\s+flask\s+import\s+").alias("flask_imports"),
        rows(r"^from\s+(?:flask|django\.\w+)\s+import\s+").alias("framework_imports"),
        content.contains("db =").alias("has_db"),
        F.struct(F.get(sortable, F.lit(0))["at"].alias("first"), F.get(sortable, F.size(sortable) - 1)["at"].alias("last"),
                 text_of("from ").alias("from_lines"), text_of("import ").alias("import_lines")).alias("import_block"))


def _choose(with_memory: bool) -> Column:
    """The first fix that applies, over the joined row."""
    s = Site(
        rule=F.coalesce("rule", F.lit("")), message=F.coalesce("message", F.lit("")), i=F.col("_i"),
        line=F.col("_line"), lines=F.col("_lines"), facts=F.col("_facts"),
        py=F.col("file").endswith(".py") | F.col("file").endswith(".pyw"),
        indent=F.regexp_extract("_line", r"^(\s*)", 1))
    fixes = [build(s) for build in RULE_FIXES]
    if with_memory:
        why = F.concat(F.lit("[Memory] "), F.coalesce("pattern_explanation", F.lit("")))
        fixes.insert(0, F.when(F.col("proposed_patch").isNotNull() & (X.js_trim(F.col("_line")) != ""),
                               here(s, F.col("proposed_patch"), why)))
    return F.coalesce(*fixes)


def propose_fixes(findings: DataFrame, files: DataFrame, partitions: int | None = None) -> DataFrame:
    """One proposal per finding that some fix applies to.

    `partitions` deals the files out first, for inputs of fewer splits than cores.

    A patch of the fix memory (`proposed_patch`, see `match_learned_fix`) goes first.
    """
    lines = X.split_lines(F.col("content"))
    facts = once(("facts",), lambda: X.let(lines, lambda bound: file_facts(bound, F.col("content"))))
    prepared = spread(files.select("project_id", "path", "content"), partitions).select(
        "project_id", F.col("path").alias("file"), lines.alias("_lines"), facts.alias("_facts"))
    keep = ["project_id", "file", "line", "rule", "severity", "message"]
    extra = [c for c in ("seq", "id", "proposed_patch", "pattern_explanation") if c in findings.columns]
    site = findings.select(*keep, *extra).join(prepared, ["project_id", "file"])
    index = (F.when(F.coalesce("line", F.lit(0)) == 0, 1).otherwise(F.col("line")) - 1).cast("int")
    site = site.withColumn("_i", index).withColumn("_line", at(F.col("_lines"), F.col("_i")))
    with_memory = "proposed_patch" in extra
    chosen = once(("fixes", with_memory), lambda: _choose(with_memory))
    proposed = site.withColumn("_fix", chosen).filter(F.col("_fix").isNotNull())
    ids = [c for c in ("seq", "id") if c in extra]
    return proposed.select(*keep, *ids, "_fix.*")
