"""Ordered operators that do not put a whole key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_lag(
    df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column, out: str
) -> DataFrame:
    """`lag(value)` over (keys order by order) where a key may hold most of the rows.

    `bucket` must not decrease with the order (a time slice, a run of line
    numbers).  Rows are windowed inside (keys, bucket); only the last value of
    each bucket crosses bucket borders, in a second window over those tails.
    `value` should be a non-null struct so that "no predecessor" is null.
    """
    marked = df.withColumn("_bucket", bucket).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    tails = marked.groupBy(*keys, "_bucket").agg(
        F.max_by("_value", F.struct(*order)).alias("_tail"))
    between = Window.partitionBy(*keys).orderBy("_bucket")
    carried = tails.select(
        *keys, "_bucket", F.lag("_tail").over(between).alias("_carry")
    ).filter(F.col("_carry").isNotNull())
    return (
        marked.withColumn("_local", F.lag("_value").over(inside))
        .join(carried, [*keys, "_bucket"], "left")
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_bucket", "_value", "_local", "_carry")
    )


def first_n(df: DataFrame, n: int, keys: list[str], order: list, rank: str | None = None) -> DataFrame:
    """First `n` rows per key.  Spark limits each task to `n` rows per key before it
    shuffles, so a hot key moves at most n rows per task."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = out.filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def cap_per_rule(
    df: DataFrame, n: int = 100, keys: list[str] = ("project_id", "list", "rule"),
    order: list | None = None, message: str = "message",
) -> DataFrame:
    """First `n` findings per rule, and one row that tells how many were left out."""
    keys = list(keys)
    kept = first_n(df, n, keys, order or ["seq"]).withColumn("truncated", F.lit(False))
    rest = (
        df.groupBy(*keys).agg(F.count("*").alias("_all"), F.first("severity").alias("severity"))
        .filter(F.col("_all") > n)
        .select(
            *keys, "severity",
            F.format_string("%d additional %s finding(s) omitted", F.col("_all") - n, F.col("rule"))
            .alias(message),
            F.lit(True).alias("truncated"))
    )
    return kept.unionByName(rest, allowMissingColumns=True)
