"""Registration: one column list drives the casts on both sides of a comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SPARK_TYPES = {"s": "string", "l": "bigint", "d": "double", "b": "boolean"}
SQL_TYPES = {"s": "VARCHAR", "l": "BIGINT", "d": "DOUBLE", "b": "BOOLEAN"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, columns: str, oracle: str | None = None):
    """Register `fn(spark, sf_dir)`; `columns` is 'name type, …' with types s, l, d, b."""
    spec = [part.split() for part in columns.split(",")]

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(tune(spark), sf_dir)
            return df.select(*[F.col(f"`{n}`").cast(SPARK_TYPES[t]).alias(n) for n, t in spec])

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            casts = ", ".join(f'CAST("{n}" AS {SQL_TYPES[t]}) AS "{n}"' for n, t in spec)
            ORACLES[name] = f"SELECT {casts} FROM (\n{oracle.strip()}\n) AS result"
        return run

    return wrap
