"""Building blocks of rule packs.

A rule is data (severity, message, fix).  How it fires is one of three shapes:

* line groups: boolean columns over one line, first match wins in a group;
* context rules: an array expression over all lines of a file (still narrow,
  because a file is one row);
* file rules: a boolean column over the whole content, reported at line 1.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeaudit.schemas import NATIVE_TOOL

HIT = "struct<ord:int,sub:int,line:int,column:int,message:string,fix:string>"


@dataclass(frozen=True)
class LineContext:
    """One exploded line and what is known of its file."""

    line: Column
    trimmed: Column
    is_js: Column
    is_py: Column  # by lower-cased extension (security rules)
    py_suffix: Column  # by literal suffix (all other rules)
    is_ai: Column
    native: Column  # file the built-in packs look at
    code: Column  # not blank, not a comment line


@dataclass(frozen=True)
class FileContext:
    """One file row: `lines` and `trimmed` are arrays bound once."""

    path: Column
    content: Column
    lines: Column
    trimmed: Column
    py_suffix: Column
    is_ai: Column
    native: Column
    roles: dict[str, Column]


@dataclass(frozen=True)
class Rule:
    rule: str
    severity: str
    category: str
    message: str
    fix: str
    tool: str = NATIVE_TOOL
    column: int | None = None
    # Message and fix that depend on the matched line.
    message_of: Callable[[LineContext], Column] | None = None
    fix_of: Callable[[LineContext], Column] | None = None


@dataclass(frozen=True)
class Pack:
    name: str
    rules: list[Rule]
    line_groups: list = field(default_factory=list)
    context_rules: list = field(default_factory=list)
    file_rules: list = field(default_factory=list)


def line_group(*branches: tuple[str, Callable[[LineContext], Column]]) -> list:
    return list(branches)


def hit(
    ord_: int,
    line: Column,
    column: Column | None = None,
    message: Column | None = None,
    fix: Column | None = None,
    sub: Column | None = None,
) -> Column:
    def text(c: Column | None) -> Column:
        return F.lit(None).cast("string") if c is None else c

    return F.struct(
        F.lit(ord_).alias("ord"),
        (F.lit(0) if sub is None else sub).cast("int").alias("sub"),
        line.cast("int").alias("line"),
        (F.lit(None) if column is None else column).cast("int").alias("column"),
        text(message).alias("message"),
        text(fix).alias("fix"),
    )


def no_hits() -> Column:
    return F.array().cast(f"array<{HIT}>")


def hits_where(lines: Column, make: Callable[[Column, Column], Column]) -> Column:
    """Non-null results of `make(line, 0-based index)`; `make` should be a lazy `when`."""
    return F.filter(F.transform(lines, make), lambda h: h.isNotNull())
