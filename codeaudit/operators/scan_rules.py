"""The rule scan: one narrow pass over files, whatever the number of rules.

Line rules set one bit each in a per-line mask, so a line without a hit costs no
row beyond the exploded one; context and file rules are array expressions on the
file row itself.  Nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit import schemas as S
from codeaudit.functions import text as X
from codeaudit.functions.findings import build_findings
from codeaudit.operators import discovery as D
from codeaudit.operators.rules import aimodel, bugs, deploy, efficiency, resources, security
from codeaudit.operators.rules.model import FileContext, LineContext, Rule, no_hits
from codeaudit.session import spread

PACKS = {
    "security": security, "bugs": bugs, "efficiency": efficiency,
    "resources": resources, "model": aimodel, "deploy": deploy,
}
JS_EXTENSIONS = ["js", "jsx", "ts", "tsx", "mjs", "cjs"]
# Findings of one file line sort by this key: tool, then rule, then match in the rule.
SEQ_TOOL, SEQ_RULE = 10**12, 1_000
NATIVE_SEQ = 10

Analyzer = Callable[[DataFrame], DataFrame]
_extra_analyzers: dict[str, Analyzer] = {}


def register_analyzer(name: str, analyzer: Analyzer) -> None:
    """Add a DataFrame analyzer: files in, raw finding rows out (see `build_findings`)."""
    if not callable(analyzer):
        raise TypeError("analyzer must be callable")
    _extra_analyzers[name] = analyzer


def rule_table(packs: list[str] | None = None) -> list[Rule]:
    return [rule for name in (packs or PACKS) for rule in PACKS[name].RULES]


def _bases(packs: list[str]) -> dict[str, int]:
    base, out = 0, {}
    for name in packs:
        out[name] = base
        base += len(PACKS[name].RULES)
    return out


def _line_groups(packs: list[str]) -> list:
    bases, out = _bases(packs), []
    for name in packs:
        if name == "security":
            at = {rule.rule: bases[name] + n for n, rule in enumerate(security.RULES)}
            out += [[(at[rule], test) for rule, test in group] for group in security.groups()]
        else:
            out += PACKS[name].groups(bases[name])
    return out


def path_columns(files: DataFrame) -> DataFrame:
    path = F.col("path")
    ext = F.lower(F.substring_index(path, ".", -1))
    return files.select(
        "project_id", "path", "content",
        ext.isin(JS_EXTENSIONS).alias("_js"),
        ext.isin("py", "pyw").alias("_py"),
        (path.endswith(".py") | path.endswith(".pyw")).alias("_pysfx"),
        D.is_ai_relevant(path, F.col("content")).alias("_ai"),
        D.is_analyzable(path).alias("_native"),
        *[v.alias(f"_{k}") for k, v in D.file_roles(path).items()],
    )


RULES_PER_MASK = 62
_built: dict = {}


def once(key: tuple, build: Callable):
    """Column trees name no table, so one tree serves every scan of a session."""
    key = (id(SparkContext._active_spark_context), *key)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def _line_columns(packs: tuple[str, ...]) -> tuple[list[Column], Column, Column, Column] | None:
    """(masks, ordinals of their bits, message, fix) over an exploded line row."""
    groups = _line_groups(list(packs))
    if not groups:
        return None
    rules = rule_table(list(packs))
    bits: list[int | None] = []  # bit position -> rule ordinal
    trimmed = F.col("_row.t")
    ctx = LineContext(
        line=F.col("_row.line"), trimmed=trimmed, is_js=F.col("_js"), is_py=F.col("_py"),
        py_suffix=F.col("_pysfx"), is_ai=F.col("_ai"), native=F.col("_native"),
        code=F.col("_native") & F.col("_row.code"),
    )
    # One long holds 62 rules; further rules go to further longs.
    masks: list[Column] = []
    for group in groups:
        case = None
        if len(bits) + len(group) > RULES_PER_MASK * len(masks):
            bits += [None] * (RULES_PER_MASK * len(masks) - len(bits))
            masks.append(F.lit(0).cast("long"))
        for ord_, test in group:
            bit = F.lit(1 << len(bits) % RULES_PER_MASK).cast("long")
            bits.append(ord_)
            case = F.when(test(ctx), bit) if case is None else case.when(test(ctx), bit)
        masks[-1] = masks[-1] + case.otherwise(F.lit(0).cast("long"))
    ordinals = F.array(*[
        F.when(F.col(f"_mask{n // RULES_PER_MASK}").bitwiseAND(F.lit(1 << n % RULES_PER_MASK).cast("long")) != 0, F.lit(ord_))
        for n, ord_ in enumerate(bits) if ord_ is not None
    ])
    message, fix = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, rule in enumerate(rules):
        if rule.message_of is not None:
            message = F.when(F.col("_ord") == n, rule.message_of(ctx)).otherwise(message)
        if rule.fix_of is not None:
            fix = F.when(F.col("_ord") == n, rule.fix_of(ctx)).otherwise(fix)
    return masks, ordinals, message, fix


def line_columns(packs: list[str]) -> tuple[list[Column], Column, Column, Column] | None:
    return once(("line", *packs), lambda: _line_columns(tuple(packs)))


def line_rows(content: Column) -> Column:
    """The lines of a text as structs of the line, its trimmed text, and whether it is no comment.

    As fields of the exploded row, the optimizer cannot inline them into every rule.
    """
    return F.transform(X.split_lines(content), lambda line: X.let(
        X.js_trim(line), lambda t: F.struct(
            line.alias("line"), t.alias("t"), (~t.startswith("//") & ~t.startswith("#")).alias("code"))))


def _line_hits(files: DataFrame, packs: list[str]) -> DataFrame | None:
    columns = line_columns(packs)
    if columns is None:
        return None
    masks, ordinals, message, fix = columns
    rows = line_rows(F.col("content"))
    lines = files.filter(F.col("_native") | F.col("_ai")).select(
        "project_id", "path", "_js", "_py", "_pysfx", "_ai", "_native",
        F.posexplode(rows).alias("_pos", "_row"),
    )
    hit_lines = (
        lines.filter(F.col("_row.t") != "")
        .withColumns({f"_mask{n}": mask for n, mask in enumerate(masks)})
        .filter(reduce(or_, [F.col(f"_mask{n}") != 0 for n in range(len(masks))]))
    )
    out = hit_lines.select(
        "*", F.explode(F.filter(ordinals, lambda o: o.isNotNull())).alias("_ord"))
    return out.select(
        "project_id", F.col("path").alias("file"), F.col("_ord"), F.lit(0).alias("_sub"),
        (F.col("_pos") + 1).alias("line"), F.lit(None).cast("int").alias("_column"),
        message.alias("_message"), fix.alias("_fix"),
    )


def has_file_rules() -> Column:
    return F.col("_native") | F.col("_ai") | F.col("_docker") | F.col("_ci") | F.col("_config") | F.col("_env")


def file_hits(packs: list[str]) -> Column | None:
    """Hits of the context and file rules, as an array on the file row."""
    bases = _bases(packs)
    if not any(PACKS[name].CONTEXT for name in packs) and "deploy" not in packs:
        return None

    def all_hits(lines: Column, trimmed: Column) -> Column:
        ctx = FileContext(
            path=F.col("path"), content=F.col("content"), lines=lines, trimmed=trimmed,
            py_suffix=F.col("_pysfx"), is_ai=F.col("_ai"), native=F.col("_native"),
            roles={r: F.col(f"_{r}") for r in ("docker", "ci", "config", "env")},
        )
        parts = [
            F.coalesce(build(ctx, bases[name] + n), no_hits())
            for name in packs for n, build in PACKS[name].CONTEXT
        ]
        if "deploy" in packs:
            parts.append(deploy.file_rules(ctx, bases["deploy"]))
        return F.concat(*parts)

    return once(("file", *packs), lambda: X.let(X.split_lines(F.col("content")), lambda lines: X.let(
        F.transform(lines, X.js_trim), lambda trimmed: all_hits(lines, trimmed))))


def _file_hits(files: DataFrame, packs: list[str]) -> DataFrame | None:
    hits = file_hits(packs)
    if hits is None:
        return None
    return (
        files.filter(has_file_rules())
        .select("project_id", F.col("path").alias("file"), F.explode(hits).alias("_h"))
        .select(
            "project_id", "file", F.col("_h.ord").alias("_ord"), F.col("_h.sub").alias("_sub"),
            F.col("_h.line").alias("line"), F.col("_h.column").alias("_column"),
            F.col("_h.message").alias("_message"), F.col("_h.fix").alias("_fix"),
        )
    )


def scan_rules(
    source_files: DataFrame, packs: list[str] | None = None, tool: str | None = S.NATIVE_TOOL,
    partitions: int | None = None,
) -> DataFrame:
    """Scan files with the rule packs and return findings.

    `partitions` deals the files out first, for inputs of fewer splits than cores.

    `tool=None` keeps the name of the sub-analyzer (modelshield, deployguard);
    by default all built-in findings carry the native tool name.
    """
    packs = list(packs or PACKS)
    files = path_columns(spread(source_files.select("project_id", "path", "content"), partitions))
    parts = [p for p in (_line_hits(files, packs), _file_hits(files, packs)) if p is not None]
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    return findings_of(hits, source_files, packs, tool)


def findings_of(hits: DataFrame, source_files: DataFrame, packs: list[str], tool: str | None) -> DataFrame:
    """Findings from rule hits and from the analyzers that were added."""
    rules = rule_table(packs)

    def of_rule(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_ord") + 1)

    if tool is None:
        names = {"model": "modelshield", "deploy": "deployguard"}
        tools = [names.get(p, S.NATIVE_TOOL) for p in packs for _ in PACKS[p].RULES]
        tool_column = of_rule(tools)
    else:
        tool_column = F.lit(tool)
    fix = F.coalesce(F.col("_fix"), of_rule([r.fix for r in rules]))
    raw = hits.select(
        "project_id", "file", "line",
        (F.lit(NATIVE_SEQ * SEQ_TOOL) + F.col("_ord") * SEQ_RULE + F.col("_sub")).cast("long").alias("seq"),
        tool_column.alias("tool"),
        of_rule([r.category for r in rules]).alias("category"),
        of_rule([r.severity for r in rules]).alias("severity"),
        F.coalesce(F.col("_column"), of_rule([r.column for r in rules]).cast("int")).alias("column"),
        of_rule([r.rule for r in rules]).alias("rule"),
        F.coalesce(F.col("_message"), of_rule([r.message for r in rules])).alias("message"),
        fix.alias("suggestedFix"),
    )
    for analyze in _extra_analyzers.values():
        raw = raw.unionByName(analyze(source_files).select(raw.columns))
    return build_findings(raw)
