"""A table that a stream keeps up to date: one row for each key, the best one so far.

Rows live in buckets of the key's hash, as Parquet below `<folder>/rows`.  A
micro-batch is combined by key in one shuffle and appended as a generation of its
own; old rows are not read for it.  A bucket with `FAN` generations of one level has
them merged into one of the next level, so a row is written once for each
level, the logarithm of the number of batches, and readers combine a bounded number
of generations.  One small commit then names the generations that are current.  A batch
that is run again after a failure starts from the commit before it and overwrites what it
wrote, so nothing counts twice and readers see whole batches.  Nothing is held in the
driver but the list of generations, and no streaming state is needed: the table is it.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from codeaudit.functions.findings import severity_index
from codeaudit.operators.ordered import first_n

BUCKETS = 64
FAN = 8
COMMITS = "bucket int, generation string, level int"


class UpsertTable:
    """`order` tells which row of a key is best: the smallest; it must not leave ties between different rows."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str], order: list[Column], buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.keys, self.order, self.buckets = spark, folder, schema, keys, order, buckets
        self._write_commits(spark.createDataFrame([], COMMITS), -1)

    def _write_commits(self, rows: DataFrame, batch: int) -> None:
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/batch={batch}")

    def _current(self, before: int | None = None) -> list[tuple[int, str, int]]:
        """(bucket, generation, level) of all that the last commit names; at most FAN of a level in a bucket."""
        commits = self.spark.read.schema(COMMITS + ", batch long").parquet(f"{self.folder}/commits")
        if before is not None:
            commits = commits.filter(F.col("batch") < before)
        last = commits.agg(F.max("batch")).first()[0]
        return [] if last is None else [(r["bucket"], r["generation"], r["level"]) for r in commits.filter(F.col("batch") == last).collect()]

    def _read(self, current: list[tuple[int, str, int]]) -> DataFrame:
        paths = [f"{self.folder}/rows/generation={g}/bucket={b}" for b, g, _ in current]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _append(self, rows: DataFrame, generation: str, level: int) -> list[tuple[int, str, int]]:
        """Write the best row of every key as a generation; its entries for a commit."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        best = first_n(rows.withColumn("bucket", bucket), 1, ["bucket", *self.keys], self.order)
        folder = f"{self.folder}/rows/generation={generation}"
        best.write.mode("overwrite").partitionBy("bucket").parquet(folder)
        written = self.spark.read.schema(best.schema).parquet(folder).select("bucket").distinct()
        return [(r["bucket"], generation, level) for r in written.collect()]

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Take the rows of one micro-batch in."""
        current = self._current(before=batch_id) + self._append(batch, f"{batch_id}", 0)
        level = 0
        while any(entry[2] >= level for entry in current):
            held = Counter(b for b, _, at in current if at == level)
            full = [entry for entry in current if entry[2] == level and held[entry[0]] >= FAN]
            if full:
                merged = self._append(self._read(full), f"{batch_id}-{level + 1}", level + 1)
                current = [entry for entry in current if entry not in full] + merged
            level += 1
        self._write_commits(self.spark.createDataFrame(current, COMMITS), batch_id)

    def read(self) -> DataFrame:
        current = self._current()
        rows = self._read(current)
        return rows if len({b for b, _, _ in current}) == len(current) else first_n(rows, 1, self.keys, self.order)

    def keep_up(self, stream: DataFrame, mode: str = "append", **trigger) -> StreamingQuery:
        """Start a query that merges all that arrives; its own progress is kept in the same folder."""
        return (stream.writeStream.outputMode(mode).foreachBatch(self.merge)
                .option("checkpointLocation", f"{self.folder}/progress").trigger(**(trigger or {"availableNow": True})).start())


def best_findings(spark: SparkSession, folder: str, schema: StructType, buckets: int = BUCKETS) -> UpsertTable:
    """The table of the most severe finding of every (project, fingerprint), ties by seq: a live `dedupe_findings`."""
    return UpsertTable(spark, folder, schema, ["project_id", "fingerprint"], [severity_index(F.col("severity")), F.col("seq")], buckets)


def windowed_best(findings: DataFrame, ts: str, span: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Most severe finding of every fingerprint and time span, in update mode, with state that ends at the watermark.

    For busy streams in front of `best_findings`: the table then meets one row for
    each fingerprint that a trigger changed.  Rows later than `delay` are lost, as with any watermark.
    """
    best = F.min_by(F.struct(*findings.columns), F.struct(severity_index(F.col("severity")), F.col("seq")))
    return (findings.withWatermark(ts, delay).groupBy(F.window(ts, span), "project_id", "fingerprint")
            .agg(best.alias("_best")).select("_best.*"))
