"""Text helpers with ECMAScript semantics, as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the code points ECMAScript `trim` strips.
JS_WHITESPACE = "".join(map(chr, [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
]))


def js_trim(text: Column) -> Column:
    """Strip all ECMAScript white space (Spark's one-argument trim strips blanks only)."""
    return F.trim(text, F.lit(JS_WHITESPACE))


def js_ltrim(text: Column) -> Column:
    return F.ltrim(text, F.lit(JS_WHITESPACE))


def indent_of(text: Column) -> Column:
    """Leading white-space characters."""
    return F.length(text) - F.length(js_ltrim(text))


def split_lines(content: Column) -> Column:
    """Lines as the analyzers see them: cut at every line feed, nothing dropped."""
    return F.split(content, "\n", -1)


def snippet_lines(content: Column) -> Column:
    """Lines as reports show them: a carriage return before the feed is dropped."""
    return F.split(content, "\r?\n", -1)


def count_of(text: Column, char: str) -> Column:
    """Occurrences of one character."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def brace_delta(text: Column) -> Column:
    return count_of(text, "{") - count_of(text, "}")


def braces_balanced(text: Column, tolerance: int = 5) -> Column:
    """A rewrite whose braces differ by more than `tolerance` is rejected."""
    return F.abs(brace_delta(text)) <= tolerance


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Directory part; '.' where the path names a file of the root."""
    cut = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(~path.contains("/"), F.lit(".")).otherwise(cut)


def extname(path: Column) -> Column:
    """Last dot and what follows, in the base name; '' for none or for a dot file."""
    return F.regexp_extract(basename(path), r"^.+?(\.[^.]*)$", 1)


def starts_with_any(text: Column, *prefixes: str) -> Column:
    test = text.startswith(prefixes[0])
    for prefix in prefixes[1:]:
        test = test | text.startswith(prefix)
    return test


def contains_any(text: Column, *needles: str) -> Column:
    test = text.contains(needles[0])
    for needle in needles[1:]:
        test = test | text.contains(needle)
    return test


def match_column(text: Column, pattern: str) -> Column:
    """1-based position of the first match, as the analyzers report columns."""
    return F.regexp_instr(text, F.lit(pattern))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once for `body`; keeps it from being recomputed inside lambdas."""
    return F.transform(F.array(value), body)[0]


def literal_map(mapping: dict) -> Column:
    flat = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.create_map(*flat)


def glob_to_regex(pattern: str) -> str:
    """`**` spans directories, `*` stays in one; only dots are escaped."""
    out = pattern.replace(".", r"\.").replace("**", "\0").replace("*", "[^/]*")
    return "^" + out.replace("\0", ".*") + "$"


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# Fixed value: RFC 3339 UTC timestamps with milliseconds.
TIMESTAMP_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"


def is_iso_millis(text: Column) -> Column:
    return text.rlike(TIMESTAMP_PATTERN) & F.try_to_timestamp(text).isNotNull()
