"""Result tables on disk."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = "project_id string, ts timestamp, seq long, score int, grade string, findingsCount long"


def write_findings(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", buckets: int = 64) -> None:
    """Findings in folders by a hash of the project, so one folder never holds one file per project.

    Rows are spread by project, file and line: a project with most findings is
    written by many tasks.
    """
    out = df.withColumn("bucket", F.pmod(F.hash("project_id"), F.lit(buckets)))
    out.repartition("bucket", "file", F.floor(F.coalesce("line", F.lit(0)) / 1000)).write.mode(mode).partitionBy(
        "bucket").format(fmt).save(path)


def write_scan_result(tables: dict[str, DataFrame], path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Every result table of a scan below one folder."""
    for name, df in tables.items():
        df.write.mode(mode).format(fmt).save(f"{path}/{name}")


def append_history(df: DataFrame, path: str) -> None:
    """Add the scans of df that the history does not hold yet; a repeated append adds nothing.

    A scan is known by (project_id, ts, seq); only these columns of the history are read.
    """
    keys = ["project_id", "ts", "seq"]
    new = df.select(*[c.split()[0] for c in HISTORY.split(", ")]).dropDuplicates(keys)
    try:
        known = read_history(df.sparkSession, path).select(*[F.col(k).alias(f"_{k}") for k in keys])
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        known = None
    if known is not None:
        new = new.join(known, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_anti")
    new.write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).parquet(path)
