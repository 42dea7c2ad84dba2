"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.session import checkpoint, shared_folder  # noqa: F401  (shared_folder for the operators)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
# Largest side that `join_checked` broadcasts, in rows.
BROADCAST_ROWS = 200_000
SALTS = 16
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder."""
    return checkpoint(df)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII takes the fast path, where both are the same."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def join_checked(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner",
                 most_rows: int = BROADCAST_ROWS, nulls_match: bool = True) -> DataFrame:
    """Join rows of any skew with a stored side.

    A side of at most `most_rows` rows is broadcast.  A larger one is joined by a
    shuffle in which each of its rows is repeated for SALTS salts and the rows of
    a hot key are dealt out over them.  Null keys match unless `nulls_match` is
    off.  The two sides share no column names but the keys.
    """
    renamed = side.select(*[F.col(k).alias(f"__right_{k}") for k in keys], *[c for c in side.columns if c not in keys])
    same = (lambda a, b: a.eqNullSafe(b)) if nulls_match else (lambda a, b: a == b)
    on = [same(rows[k], F.col(f"__right_{k}")) for k in keys]
    if side.count() <= most_rows:
        renamed = F.broadcast(renamed)
    else:
        rows = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        renamed = renamed.withColumn("__right___salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = [same(F.col(k), F.col(f"__right_{k}")) for k in keys] + [F.col("__salt") == F.col("__right___salt")]
    return rows.join(renamed, reduce(and_, on), how).drop("__salt", "__right___salt", *[f"__right_{k}" for k in keys])


def row_mark(docs: DataFrame) -> Column:
    """128 bits that tell rows of different id or text apart."""
    known = [F.struct(docs[c]) for c in ("doc_id", "text")]
    return F.struct(F.xxhash64(*known).alias("a"), F.xxhash64(F.lit(1), *known).alias("b"))


def rows_without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose mark is not in the stored gone(mark)."""
    rows = docs.select(row_mark(docs).alias("mark"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return join_checked(rows, gone, ["mark"], "left_anti").select("row.*")


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A long text in pieces that end at white space, so that no word is cut."""
    at = 0
    while len(text) - at > size:
        found = _SPACE.search(text, at + size)
        if not found:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:] if at else text

