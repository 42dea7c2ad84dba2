"""Bug rules: line rules, context folds and Python name resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeaudit.functions import text as X
from codeaudit.operators.rules.model import (
    FileContext, LineContext, Rule, hit, hits_where, line_group,
)

# --- Fixed values: rule, severity, message, fix -------------------------------
_R = [
    ("empty-catch", "HIGH", "Empty catch block swallows errors silently",
     "Add error handling, logging, or rethrow the error."),
    ("swallowed-error", "MEDIUM", "Error is caught but appears to be silently ignored",
     "Log the error or handle it meaningfully."),
    ("assignment-in-condition", "HIGH",
     "Assignment in condition — likely should be comparison (===)",
     "Use === for comparison, or move assignment outside the condition."),
    ("assignment-in-condition", "HIGH",
     "Assignment in condition — likely should be comparison (==)",
     "Use == for comparison, or move assignment outside the condition."),
    ("E711", "LOW", "Comparison to None", "Use 'is None' or 'is not None' for singleton comparison."),
    ("E712", "LOW", "Comparison to a boolean", ""),
    ("loose-equality", "LOW", "Loose equality (==) used instead of strict equality (===)",
     "Use === or !== for type-safe comparisons."),
    ("off-by-one", "HIGH", "Potential off-by-one loop boundary error",
     "Check loop boundary condition (use < length or range(len(...)))."),
    ("unreachable-code", "MEDIUM", "Code appears to be unreachable after return/throw/break/continue",
     "Remove unreachable code or fix control flow."),
    ("always-true-false", "MEDIUM", "Always-true condition (if (true))", "Review control flow logic."),
    ("always-true-false", "MEDIUM", "Always-false condition (if (false))", "Review control flow logic."),
    ("always-true-false", "MEDIUM", "Infinite loop (while (true)) — verify intentional",
     "Review control flow logic."),
    ("always-true-false", "MEDIUM", "Dead code — while (false) never executes",
     "Review control flow logic."),
    ("duplicate-condition", "MEDIUM", "Duplicate condition in if/else-if chain",
     "Remove or consolidate the duplicate branch."),
    ("undefined-variable", "HIGH", "Undefined variable", "Define it or import it."),
    ("F401", "LOW", "Imported but unused", "Remove the import."),
    ("missing-import", "HIGH", "Used but not imported", "Add the import."),
]
(EMPTY_CATCH, SWALLOWED, ASSIGN_JS, ASSIGN_PY, E711, E712, LOOSE, OFF_BY_ONE, UNREACHABLE,
 IF_TRUE, IF_FALSE, WHILE_TRUE, WHILE_FALSE, DUPLICATE, UNDEFINED, UNUSED, MISSING) = range(17)

# Patterns.
CATCH_OPEN = r"catch\s*(?:\([^)]*\))?\s*\{\s*\z"
SWALLOWED_PATTERNS = [
    r"catch\s*\([^)]*\)\s*\{\s*(?://.*|/\*.*\*/\s*)*\}",
    r"(?i)catch\s*\([^)]*\)\s*\{\s*//\s*(?:ignore|swallow|suppress|silent|noop|do nothing)",
]
ASSIGN_PY_PATTERNS = [r"(?:if|elif|while)\s+[a-zA-Z_]\w*\s*=[^=!<>\n:]+"]
ASSIGN_JS_PATTERNS = [
    r"if\s*\(\s*[a-zA-Z_$][a-zA-Z0-9_$]*\s*=[^=!]",
    r"while\s*\(\s*[a-zA-Z_$][a-zA-Z0-9_$]*\s*=[^=!]",
    r"if\s*\(\s*\([^)]*\b[a-zA-Z_$][a-zA-Z0-9_$]*\s*=[^=!]",
]
SINGLETON_RIGHT = r"\b([a-zA-Z_]\w*)\s*(==|!=)\s*(None|True|False)\b"
SINGLETON_LEFT = r"\b(None|True|False)\s*(==|!=)\s*([a-zA-Z_]\w*)\b"
LOOSE_EQUALITY = r"[^!=<>]==(?!=)"
OFF_BY_ONE_PATTERNS = [
    r"for\s*\([^)]*<=\s*(?:arr|items|data|results|list|elements|values|array)\.length",
    r"for\s*\([^)]*<=\s*(?:str|string|text|input|buffer)\.length",
    r"range\s*\(\s*(?:0\s*,\s*)?len\s*\([^)]+\)\s*\+\s*1\s*\)",
]
ALWAYS_PATTERNS = [
    r"if\s*\(\s*true\s*\)", r"if\s*\(\s*false\s*\)",
    r"while\s*\(\s*true\s*\)", r"while\s*\(\s*false\s*\)",
]
TERMINATOR = r"^(return|throw|break|continue)\b"
DECLARATION = r"^(?:def|class|function)\s+"
IF_CONDITION = r"^if\s*\((.+)\)\s*\{?\z"
ELSE_IF_CONDITION = r"^\}?\s*else\s+if\s*\((.+)\)\s*\{?\z"
PYTHON_BUILTINS = [
    "print", "len", "range", "int", "str", "float", "bool", "list", "dict",
    "set", "tuple", "type", "isinstance", "issubclass", "id", "input", "open",
    "abs", "all", "any", "bin", "chr", "dir", "divmod", "enumerate", "eval",
    "exec", "filter", "format", "frozenset", "getattr", "globals", "hasattr",
    "hash", "help", "hex", "iter", "locals", "map", "max", "min", "next",
    "object", "oct", "ord", "pow", "property", "repr", "reversed", "round",
    "setattr", "slice", "sorted", "staticmethod", "sum", "super", "vars",
    "zip", "True", "False", "None", "NotImplementedError", "Exception",
    "ValueError", "TypeError", "KeyError", "IndexError", "AttributeError",
    "RuntimeError", "ImportError", "OSError", "IOError", "FileNotFoundError",
    "StopIteration", "GeneratorExit", "SystemExit", "BaseException",
    "__name__", "__file__", "__doc__", "__all__", "__init__", "self", "cls",
]
FLASK_FUNCTIONS = [
    "Flask", "request", "jsonify", "send_file", "send_from_directory",
    "redirect", "url_for", "render_template", "abort", "make_response",
    "Response", "Blueprint", "g", "session", "flash", "current_app",
]
DJANGO_FUNCTIONS = [
    "HttpResponse", "JsonResponse", "render", "redirect", "get_object_or_404",
    "get_list_or_404", "reverse", "reverse_lazy",
]
IMPORT_LIST = r"^import\s+(.+)"
FROM_LIST = r"^from\s+\S+\s+import\s+(.+)"
SINGLE_IMPORT = r"^import\s+(\w+)(?:\s+as\s+(\w+))?\z"
NAME_AS = r"(\w+)(?:\s+as\s+(\w+))?"
RECEIVER_CALL = (
    r"(?<!\.)\b([a-zA-Z_]\w*)\.(?:execute|query|run|send|close|commit|rollback|fetchone|fetchall"
    r"|cursor|connect)\s*\("
)
PLAIN_CALL = r"(?<!\.)\b([a-zA-Z_]\w*)\s*\("
# --- end of fixed values ------------------------------------------------------


def _target(c: LineContext) -> Column:
    right = F.regexp_extract(c.trimmed, SINGLETON_RIGHT, 3)
    return F.when(right != "", right).otherwise(F.regexp_extract(c.trimmed, SINGLETON_LEFT, 1))


def _singleton_message(c: LineContext) -> Column:
    right = F.regexp_extract(c.trimmed, SINGLETON_RIGHT, 2)
    op = F.when(right != "", right).otherwise(F.regexp_extract(c.trimmed, SINGLETON_LEFT, 2))
    word = F.when(op == "!=", "is not").otherwise("is")
    return F.format_string("Comparison to %s should use '%s' rather than '%s'", _target(c), word, op)


def _singleton_fix(c: LineContext) -> Column:
    return F.format_string(
        "Use 'is %s' or 'is not %s' for singleton comparison.", _target(c), _target(c))


RULES = [Rule(rule, severity, "bugs", message, fix) for rule, severity, message, fix in _R]
for _i in (E711, E712):
    RULES[_i] = Rule(
        RULES[_i].rule, "LOW", "bugs", RULES[_i].message, RULES[_i].fix,
        message_of=_singleton_message, fix_of=_singleton_fix,
    )


def _any(text: Column, patterns: list[str]) -> Column:
    out = text.rlike(patterns[0])
    for pattern in patterns[1:]:
        out = out | text.rlike(pattern)
    return out


def groups(base: int) -> list:
    """Line groups, by absolute ordinal of the rule."""

    def on(test):
        return lambda c: c.native & test(c)

    def singleton(target_is_none: bool):
        def test(c: LineContext) -> Column:
            found = c.trimmed.rlike(SINGLETON_RIGHT) | c.trimmed.rlike(SINGLETON_LEFT)
            is_none = _target(c) == "None"
            compared = X.contains_any(c.trimmed, "==", "!=")
            return c.py_suffix & compared & found & (is_none if target_is_none else ~is_none)

        return test

    def loose(c: LineContext) -> Column:
        head = F.substring(c.trimmed, 1, 80)
        return (
            ~c.py_suffix & c.trimmed.contains("==") & ~c.trimmed.contains("===")
            & ~c.trimmed.contains("!==") & c.trimmed.rlike(LOOSE_EQUALITY)
            & ~head.contains("//") & ~head.contains("*")
        )

    return [
        line_group((base + SWALLOWED, on(
            lambda c: c.trimmed.contains("catch") & _any(c.trimmed, SWALLOWED_PATTERNS)))),
        line_group(
            (base + ASSIGN_JS, on(
                lambda c: ~c.py_suffix & c.trimmed.contains("=") & c.trimmed.contains("(") & _any(c.trimmed, ASSIGN_JS_PATTERNS))),
            (base + ASSIGN_PY, on(
                lambda c: c.py_suffix & c.trimmed.contains("=") & _any(c.trimmed, ASSIGN_PY_PATTERNS)))),
        line_group((base + E711, on(singleton(True))), (base + E712, on(singleton(False))),
                   (base + LOOSE, on(loose))),
        line_group((base + OFF_BY_ONE, on(
            lambda c: X.contains_any(c.trimmed, "<=", "range") & _any(c.trimmed, OFF_BY_ONE_PATTERNS)))),
        line_group(*[
            (base + IF_TRUE + i, on(lambda c, p=p: X.contains_any(c.trimmed, "true", "false") & c.trimmed.rlike(p)))
            for i, p in enumerate(ALWAYS_PATTERNS)]),
    ]


def empty_catch(f: FileContext, ord_: int) -> Column:
    """Follow the braces of a catch block for nine lines; report if nothing is in it."""

    def closes_empty(i: Column) -> Column:
        start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("body"), F.lit(False).alias("closed"))

        def step(s: Column, line: Column) -> Column:
            depth = s["depth"] + X.brace_delta(line)
            return F.when(s["closed"], s).otherwise(F.struct(
                depth.alias("depth"),
                F.concat(s["body"], F.lit(" "), X.js_trim(line)).alias("body"),
                (depth <= 0).alias("closed"),
            ))

        def verdict(s: Column) -> Column:
            text = F.regexp_replace(s["body"], r"//.*\z", "")
            text = X.js_trim(F.regexp_replace(text, r"/\*[\s\S]*?\*/", ""))
            return F.when(s["closed"] & text.isin("", "}"), F.lit(True)).otherwise(F.lit(False))

        return F.aggregate(F.slice(f.lines, i + 2, 9), start, step, verdict)

    return F.when(f.native & f.content.contains("catch"), hits_where(
        f.lines,
        lambda line, i: F.when(line.rlike(CATCH_OPEN) & closes_empty(i), hit(ord_, i + 1)),
    ))


def unreachable_code(f: FileContext, ord_: int) -> Column:
    """One fold over the file that carries the previous code line and its indent."""
    rows = F.transform(f.lines, lambda line: F.struct(
        X.js_trim(line).alias("t"), X.indent_of(line).alias("indent")))
    start = F.struct(
        F.lit(None).cast("string").alias("prev"), F.lit(0).alias("indent"),
        F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"),
    )

    def step(s: Column, row: Column) -> Column:
        t = row["t"]
        not_code = (t == "") | X.starts_with_any(t, "//", "/*")
        inert = not_code | t.isin("}", "{") | t.startswith("@") | t.rlike(DECLARATION)
        ended = (
            s["prev"].isNotNull() & (row["indent"] >= s["indent"]) & s["prev"].rlike(TERMINATOR)
            & ~s["prev"].endswith("{") & ~s["prev"].endswith(",")
        )
        carried = not_code | t.startswith("*")
        return F.struct(
            F.when(carried, s["prev"]).otherwise(t).alias("prev"),
            F.when(carried, s["indent"]).otherwise(row["indent"]).alias("indent"),
            (s["n"] + 1).alias("n"),
            F.when(~inert & ended, F.array_append(s["at"], s["n"] + 1)).otherwise(s["at"]).alias("at"),
        )

    lines_at = F.aggregate(rows, start, step, lambda s: s["at"])
    return F.when(
        f.native & X.contains_any(f.content, "return", "throw", "break", "continue"),
        F.transform(lines_at, lambda n: hit(ord_, n)),
    )


def duplicate_condition(f: FileContext, ord_: int) -> Column:
    """Look through the else-if chain (99 lines) for the condition of the `if`."""

    def repeated(condition: Column, i: Column) -> Column:
        def step(state: Column, t: Column) -> Column:
            other = X.js_trim(F.regexp_extract(t, ELSE_IF_CONDITION, 1))
            is_else_if = t.rlike(ELSE_IF_CONDITION)
            return (
                F.when(state != 0, state)
                .when(is_else_if & (other == condition), F.lit(1))
                .when(is_else_if, F.lit(0))
                .when((t == "}") | t.startswith("if"), F.lit(2))
                .otherwise(F.lit(0))
            )

        return F.aggregate(F.slice(f.trimmed, i + 2, 99), F.lit(0), step) == 1

    return F.when(f.native & f.content.contains("else"), hits_where(
        f.trimmed,
        lambda t, i: F.when(
            t.rlike(IF_CONDITION)
            & repeated(X.js_trim(F.regexp_extract(t, IF_CONDITION, 1)), i),
            hit(ord_, i + 1)),
    ))


def _listed_names(text: Column, pattern: str, skip_paren: bool = False) -> Column:
    """Names bound by a comma list: the alias where there is one."""
    listing = F.regexp_extract(text, pattern, 1)

    def name(item: Column) -> Column:
        alias = F.regexp_extract(item, NAME_AS, 2)
        return F.when(alias != "", alias).otherwise(F.regexp_extract(item, NAME_AS, 1))

    names = F.transform(F.split(listing, ","), name)
    return F.when(listing.startswith("("), F.array().cast("array<string>")).otherwise(names) \
        if skip_paren else names


def _defined_names(trimmed: Column) -> Column:
    # A line that does not begin as such binds no names: the patterns would find the empty one.
    none = F.array().cast("array<string>")

    def listed(t: Column, word: str, names: Column) -> Column:
        return F.when(t.startswith(word), names).otherwise(none)

    def parameters(t: Column) -> Column:
        raw = F.split(F.regexp_extract(t, r"^def\s+(\w+)\s*\(([^)]*)\)", 2), ",")
        bare = F.transform(raw, lambda p: X.js_trim(F.regexp_replace(
            F.regexp_replace(X.js_trim(p), r"[=:].*\z", ""), r"^\*+", "")))
        return F.when(t.startswith("def"), F.filter(bare, lambda p: p.rlike(r"^\w+\z"))).otherwise(none)

    def assigned(t: Column) -> Column:
        return F.when(X.starts_with_any(t, "if ", "elif ", "while "), "").otherwise(
            F.regexp_extract(t, r"^(\w+)\s*=", 1))

    def of_line(t: Column) -> Column:
        return F.concat(
            listed(t, "import", _listed_names(t, IMPORT_LIST, skip_paren=True)),
            listed(t, "from", _listed_names(t, FROM_LIST)),
            parameters(t),
            F.array(
                F.regexp_extract(t, r"^def\s+(\w+)\s*\(([^)]*)\)", 1),
                F.regexp_extract(t, r"^class\s+(\w+)", 1),
                assigned(t),
                F.regexp_extract(t, r"^for\s+(\w+)\s+in\b", 1),
                F.regexp_extract(t, r"\bas\s+(\w+)\s*:", 1),
                F.regexp_extract(t, r"^@(\w+)", 1),
            ),
        )

    return F.array_distinct(F.flatten(F.transform(trimmed, of_line)))


def undefined_variable(f: FileContext, ord_: int) -> Column:
    """First unknown called name of a line, once per call shape."""
    builtins = F.array(*[F.lit(b) for b in PYTHON_BUILTINS])

    def find(known: Column, pattern: str, sub: int) -> Column:
        def first_unknown(t: Column) -> Column:
            code = F.substring_index(t, "#", 1)
            called = F.regexp_extract_all(code, F.lit(pattern), F.lit(1))
            return F.get(F.filter(called, lambda n: ~F.array_contains(known, n)), F.lit(0))

        def make(t: Column, i: Column) -> Column:
            skipped = (t == "") | X.starts_with_any(t, "#", "import ", "from ", "def ", "class ", "@")
            name = first_unknown(t)
            return F.when(~skipped & t.contains("(") & name.isNotNull(), hit(
                ord_, i + 1, sub=F.lit(sub),
                message=F.format_string(
                    "Undefined variable '%s' — name is not defined in this scope", name),
                fix=F.format_string(
                    "Define '%s' or import it (e.g., from a module or framework).", name),
            ))

        return hits_where(f.trimmed, make)

    known = F.array_union(_defined_names(f.trimmed), builtins)
    return F.when(f.native & f.py_suffix, X.let(
        known, lambda k: F.concat(find(k, RECEIVER_CALL, 0), find(k, PLAIN_CALL, 1))))


def _is_import_line(t: Column) -> Column:
    return X.starts_with_any(t, "import ", "from ")


def unused_import(f: FileContext, ord_: int) -> Column:
    """Anti join of imported names with the words of all other lines."""
    words = F.array_distinct(F.flatten(F.transform(
        F.filter(f.trimmed, lambda t: ~_is_import_line(t)),
        lambda t: F.regexp_extract_all(t, F.lit(r"\w+"), F.lit(0)))))

    def imports(t: Column) -> Column:
        single = F.array(F.struct(
            F.regexp_extract(t, SINGLE_IMPORT, 1).alias("module"),
            F.regexp_extract(t, SINGLE_IMPORT, 2).alias("alias")))
        listed = F.transform(F.split(F.regexp_extract(t, FROM_LIST, 1), ","), lambda item: F.struct(
            F.regexp_extract(item, NAME_AS, 1).alias("module"),
            F.regexp_extract(item, NAME_AS, 2).alias("alias")))
        found = F.when(t.rlike(SINGLE_IMPORT), single).when(t.rlike(FROM_LIST), listed)
        return F.filter(found, lambda m: m["module"] != "")

    def bound(m: Column) -> Column:
        return F.when(m["alias"] != "", m["alias"]).otherwise(m["module"])

    def make(used: Column):
        return lambda t, i: F.transform(
            F.filter(F.when(_is_import_line(t) | t.rlike(r"^(?:import|from)\s"), imports(t)),
                     lambda m: ~F.array_contains(used, bound(m))),
            lambda m, k: hit(
                ord_, i + 1, sub=k,
                message=F.format_string("'%s' imported but unused", m["module"]),
                fix=F.format_string("Remove unused import '%s' or use it in the code.", m["module"])),
        )

    return F.when(f.native & f.py_suffix & f.content.contains("import"), X.let(
        words, lambda used: F.flatten(F.filter(
            F.transform(f.trimmed, make(used)), lambda h: h.isNotNull()))))


def missing_import(f: FileContext, ord_: int) -> Column:
    """Framework functions called but not imported."""
    imported = F.array_distinct(F.flatten(F.transform(f.trimmed, lambda t: F.array_append(
        _listed_names(t, FROM_LIST), F.regexp_extract(t, r"^import\s+(\w+)", 1)))))

    def find(functions: list[str], module: str) -> Column:
        known = F.array(*[F.lit(n) for n in functions])

        def make(have: Column):
            def of_line(t: Column, i: Column) -> Column:
                skipped = (t == "") | X.starts_with_any(t, "#", "import", "from")
                called = F.regexp_extract_all(t, F.lit(r"\b(\w+)\s*\("), F.lit(1))
                absent = F.filter(
                    known, lambda n: F.array_contains(called, n) & ~F.array_contains(have, n))
                return F.when(~skipped & t.contains("("), F.transform(absent, lambda n, k: hit(
                    ord_, i + 1, sub=k,
                    message=F.format_string(
                        f"'%s' is used but not imported from '{module}'", n),
                    fix=F.format_string(
                        f"Add '%s' to the import statement: from {module} import ..., %s", n, n))))

            return of_line

        return X.let(imported, lambda have: F.flatten(F.filter(
            F.transform(f.trimmed, make(have)), lambda h: h.isNotNull())))

    flask = X.contains_any(f.content, "from flask", "import flask")
    django = X.contains_any(f.content, "from django", "import django")
    native = f.native & f.py_suffix
    return F.when(native & flask, find(FLASK_FUNCTIONS, "flask")).when(
        native & django, find(DJANGO_FUNCTIONS, "django.shortcuts"))


CONTEXT = [
    (EMPTY_CATCH, empty_catch), (UNREACHABLE, unreachable_code), (DUPLICATE, duplicate_condition),
    (UNDEFINED, undefined_variable), (UNUSED, unused_import), (MISSING, missing_import),
]
