"""Corpus filters: languages, skipped folders, ignore patterns, path roles."""

from __future__ import annotations

import re

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeaudit.functions import text as X

# --- Fixed values -------------------------------------------------------------
LANGUAGE_BY_EXTENSION = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".py": "python", ".pyw": "python",
}
ANALYZABLE_EXTENSIONS = [".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".py", ".pyw"]
MODEL_RULE_EXTENSIONS = [".js", ".ts", ".py", ".jsx", ".tsx"]
SKIP_DIRS = [
    ".git", ".svn", ".hg", "node_modules", "vendor", "dist", "build", "out", ".next", ".nuxt",
    "__pycache__", ".venv", "venv", ".env", "coverage", ".nyc_output", ".cache", ".temp", ".tmp",
]
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg",
    ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".flv", ".webm",
    ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar",
    ".exe", ".dll", ".so", ".dylib",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".woff", ".woff2", ".ttf", ".eot",
    ".sqlite", ".db",
]
DEFAULT_IGNORE_PATTERNS = [
    "node_modules", ".git", "dist", "build", "__pycache__", ".venv", "venv", "coverage",
    ".next", ".nuxt", "vendor", ".cache", ".nyc_output",
]
MAX_DEPTH = 10
NON_PRODUCTION_PATH = (
    r"(?i)(^|/)(tests?|__tests__|fixtures|__fixtures__|spec|__specs__|node_modules)(/|$)"
    r"|\.(test|spec)\.[^/]+$"
)
SERVER_OR_CONFIG = r"(?i)(server|app|index|config|settings)\.(js|ts|py)$"
AI_KEYWORDS = (
    r"(?i)(openai|anthropic|openrouter|langchain|llamaindex|huggingface|transformers|torch"
    r"|pytorch|sklearn|embedding|completion|chat|agent|prompt)"
)
# --- end of fixed values ------------------------------------------------------


def _ext(path: Column) -> Column:
    return F.lower(X.extname(path))


def with_language(df: DataFrame, path: str = "path") -> DataFrame:
    """Add `language`; null where the extension is not a supported one."""
    return df.withColumn("language", X.literal_map(LANGUAGE_BY_EXTENSION)[_ext(F.col(path))])


def filter_skip_dirs(df: DataFrame, path: str = "path", max_depth: int = MAX_DEPTH) -> DataFrame:
    """Drop files below a skipped or dot-prefixed folder, or nested too deep."""
    folders = F.slice(F.split(F.col(path), "/"), 1, F.size(F.split(F.col(path), "/")) - 1)
    skipped = F.array(*[F.lit(d) for d in SKIP_DIRS])
    return df.filter(
        (F.size(folders) <= max_depth)
        & ~F.arrays_overlap(folders, skipped)
        & ~F.exists(folders, lambda d: d.startswith("."))
    )


def filter_binary_ext(df: DataFrame, path: str = "path") -> DataFrame:
    return df.filter(~_ext(F.col(path)).isin(BINARY_EXTENSIONS))


def ignore_lines(text: str) -> list[str]:
    """Patterns of an ignore file: blanks and `#` comments dropped."""
    stripped = (line.strip() for line in text.split("\n"))
    return [line for line in stripped if line and not line.startswith("#")]


def ignore_pattern_regex(pattern: str) -> str:
    """One pattern as a regex over the '/'-separated relative path.

    Patterns with `*` match the whole path; others match a run of whole segments.
    """
    unix = pattern.replace("\\", "/")
    if "*" in unix:
        return X.glob_to_regex(unix)
    return "(^|/)" + re.escape(unix.rstrip("/")) + "(/|$)"


def is_ignored(path: Column, patterns: list[str]) -> Column:
    unix = F.replace(path, F.lit("\\"), F.lit("/"))
    return unix.rlike("|".join(f"(?:{ignore_pattern_regex(p)})" for p in patterns))


@F.pandas_udf(T.BooleanType())
def bad_regex(patterns: pd.Series) -> pd.Series:
    """Whether a pattern does not compile; one project's mistake must not end the job for all."""
    def bad(pattern: str) -> bool:
        try:
            re.compile(pattern)
        except re.error:
            return True
        return False

    return patterns.map(bad)


def rejected_ignore_patterns(per_project: DataFrame) -> DataFrame:
    """(project_id, pattern) of starred patterns that are no valid expression; `filter_ignored` leaves them out."""
    unix = F.replace(F.regexp_replace(X.js_trim(F.col("pattern")), r"\\", "/"), F.lit("*"), F.lit("[^/]*"))
    return per_project.filter(F.col("pattern").contains("*") & bad_regex(unix)).select("project_id", "pattern")


def filter_ignored(
    df: DataFrame,
    patterns: list[str] | None = None,
    per_project: DataFrame | None = None,
    path: str = "path",
) -> DataFrame:
    """Drop ignored files.

    `patterns` (added to the defaults) compile to one alternation.  `per_project`
    (project_id, pattern) is folded to one alternation per project, so the corpus
    meets it in an equi join and never in a cross product of files and patterns.
    """
    kept = df.filter(~is_ignored(F.col(path), DEFAULT_IGNORE_PATTERNS + (patterns or [])))
    if per_project is None:
        return kept
    unix = F.regexp_replace("pattern", r"\\", "/")
    literal = F.concat(
        F.lit("(^|/)"),
        F.regexp_replace(F.regexp_replace(unix, "/+$", ""), r"([.+?^$()|\[\]{}\\])", r"\\$1"),
        F.lit("(/|$)"),
    )
    starred = F.replace(F.regexp_replace(unix, r"\.", r"\\."), F.lit("**"), F.lit("\0"))
    starred = F.replace(
        F.replace(starred, F.lit("*"), F.lit("[^/]*")), F.lit("\0"), F.lit(".*"))
    regex = F.when(unix.contains("*"), F.concat(F.lit("^"), starred, F.lit("$"))).otherwise(literal)
    usable = (F.col("pattern") != "") & ~F.col("pattern").startswith("#")
    folded = (
        per_project.withColumn("pattern", X.js_trim(F.col("pattern")))
        .filter(usable)
        .select("project_id", regex.alias("_rx"))
        .filter(~bad_regex(F.col("_rx")))
        .groupBy("project_id")
        .agg(F.array_join(F.collect_set("_rx"), "|").alias("_ignore"))
    )
    joined = kept.join(folded, "project_id", "left")
    path_unix = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    test = F.coalesce(F.regexp_like(path_unix, F.col("_ignore")), F.lit(False))
    return joined.filter(~test).drop("_ignore")


def is_analyzable(path: Column) -> Column:
    return _ext(path).isin(ANALYZABLE_EXTENSIONS)


def is_blank_or_comment(line: Column) -> Column:
    """Lines the security rules skip."""
    trimmed = X.js_trim(line)
    return (trimmed == "") | trimmed.startswith("//") | trimmed.startswith("#")


def is_production_path(path: Column) -> Column:
    return ~path.rlike(NON_PRODUCTION_PATH)


def is_ai_relevant(path: Column, content: Column) -> Column:
    return _ext(path).isin(MODEL_RULE_EXTENSIONS) & content.rlike(AI_KEYWORDS)


def file_roles(path: Column) -> dict[str, Column]:
    """Roles the deployment rules select files by."""
    base = F.lower(X.basename(path))
    return {
        "docker": (base == "dockerfile") | base.endswith(".dockerfile") | base.contains("containerfile"),
        "ci": path.contains(".github/workflows") | path.contains(".gitlab-ci"),
        "config": base.rlike(SERVER_OR_CONFIG),
        "env": (base == ".env")
        | (base.startswith(".env.") & ~base.contains("example") & ~base.contains("sample")),
    }


def with_file_roles(df: DataFrame, path: str = "path") -> DataFrame:
    return df.withColumns({f"is_{k}": v for k, v in file_roles(F.col(path)).items()})


def canonicalise_path(df: DataFrame, root: str | Column | None = None, file: str = "file") -> DataFrame:
    """Make finding paths relative to the project root, with forward slashes."""
    col = F.col(file)
    if root is not None:
        base = F.lit(root.rstrip("/")) if isinstance(root, str) else F.rtrim(root, F.lit("/"))
        below = F.substr(col, F.length(base) + 2)
        col = F.when(col == base, X.basename(col)).when(
            col.startswith(F.concat(base, F.lit("/"))), below).otherwise(col)
    return df.withColumn(
        file, F.replace(F.regexp_replace(col, r"^[./\\]+", ""), F.lit("\\"), F.lit("/")))


def language_profile(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Files per project and language."""
    return (
        with_language(df)
        .filter(F.col("language").isNotNull())
        .groupBy(*(keys or ["project_id"]), "language")
        .agg(F.count("*").alias("files"))
    )


def discover(df: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """The files a scan looks at, with their language."""
    kept = filter_ignored(filter_binary_ext(filter_skip_dirs(df)), patterns)
    return with_language(kept).filter(F.col("language").isNotNull())
