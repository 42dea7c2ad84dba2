"""Streaming runs over the shipped tables, driven to the end, and incremental rescans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.operators.scan_rules import scan_rules
from codeaudit.queries import inputs as I
from codeaudit.queries.q_rules import security_sql
from codeaudit.queries.registry import query, table
from codeaudit.session import shared_folder
from codeaudit.streaming import incremental as T
from codeaudit.streaming.log_check import stream_check_log
from codeaudit.streaming.upsert import best_findings

REPLAYED = "sha256:" + "5" * 64


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A shipped table as a file stream."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parquet*")


def drain(df: DataFrame) -> DataFrame:
    """Run a stream over all that is there into a file sink in the shared folder and return its output as a table."""
    spark = df.sparkSession
    folder = shared_folder(spark, "stream")
    run = df.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def in_batches(spark: SparkSession, sf: str, name: str, order: str, columns: list[str], batches: int = 4, files: int = 8) -> DataFrame:
    """A shipped table as a stream of several micro-batches of several files, all its rows dealt out by ranges of a key.

    Which range comes in which batch follows the files' times, not the key: what
    reads this must not depend on the order.  Longer tables come in more files a batch,
    and only the columns that the streams read are stored again.
    """
    rows = table(spark, sf, name).select(*columns)
    files = max(files, -(-rows.count() // (batches * I.DEALT_ROWS)))
    folder = shared_folder(spark, "batches")
    rows.repartitionByRange(batches * files, order).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


# Tables that come in several micro-batches: the key they are dealt out by, and the columns that streams read.
BATCHED = {"events": ("event_id", ["event_id"]), "lineitem": ("l_shipdate", ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"])}


class _Streamed:
    """Stands in for a session whose tables are read as streams."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf, self.read = spark, sf, self

    def parquet(self, path: str) -> DataFrame:
        name = path.rsplit("/", 1)[1].removesuffix(".parquet")
        if name in BATCHED:
            return in_batches(self.spark, self.sf, name, *BATCHED[name])
        # One file is one task, unless its rows are dealt out.
        return stream(self.spark, self.sf, name).repartition(self.spark.sparkContext.defaultParallelism)


@query("stream_scan", "project_id s, file s, line l, rule s", security_sql(I.DOCUMENT_FILES_SQL))
def stream_scan(spark, sf):
    return drain(T.stream_scan(I.document_files(_Streamed(spark, sf), sf), ["security"]))


@query("stream_chain", "store_id s, line_no l, rule s, message s", f"""WITH {I.LOG_SQL},
p AS (SELECT *, lag(record_hash) OVER w AS ph, lag(malformed) OVER w AS pm FROM log_lines WINDOW w AS (PARTITION BY store_id ORDER BY line_no))
SELECT store_id, line_no, 'VG-PROV-001' AS rule, 'line ' || line_no || CASE WHEN malformed THEN ' is invalid' ELSE ' prev_record_hash does not match the previous record' END AS message
FROM p WHERE malformed OR ((line_no = 1 AND prev_record_hash IS NOT NULL) OR (line_no > 1 AND NOT pm AND prev_record_hash IS DISTINCT FROM ph))""")
def stream_chain(spark, sf):
    return drain(T.stream_verify_chain(_live_lines(spark, sf)))


def _live_lines(spark: SparkSession, sf: str) -> DataFrame:
    return I.log_lines(_Streamed(spark, sf), sf).select(
        "store_id", "line_no", F.col("record.record_hash").alias("record_hash"), F.col("record.prev_record_hash").alias("prev_record_hash"),
        F.col("problem").isNull().alias("valid"))


@query("stream_log_check", "store_id s, line_no l, rule s, message s", f"""WITH {I.LOG_SQL},
h AS (SELECT store_id, line_no, malformed, CASE WHEN event_id % 53 = 0 THEN '{REPLAYED}' ELSE record_hash END AS record_hash, prev_record_hash FROM log_lines),
p AS (SELECT *, lag(record_hash) OVER w AS ph, lag(malformed) OVER w AS pm FROM h WINDOW w AS (PARTITION BY store_id ORDER BY line_no)),
f AS (SELECT store_id, record_hash, min(line_no) AS first_line FROM h WHERE NOT malformed GROUP BY store_id, record_hash)
SELECT store_id, line_no, 'VG-PROV-001' AS rule, 'line ' || line_no || CASE WHEN malformed THEN ' is invalid' ELSE ' prev_record_hash does not match the previous record' END AS message
FROM p WHERE malformed OR ((line_no = 1 AND prev_record_hash IS NOT NULL) OR (line_no > 1 AND NOT pm AND prev_record_hash IS DISTINCT FROM ph))
UNION ALL
SELECT h.store_id, h.line_no, 'VG-PROV-006', 'record ' || h.record_hash || ' appears more than once (replay)'
FROM h JOIN f USING (store_id, record_hash) WHERE NOT h.malformed AND h.line_no <> f.first_line""")
def stream_log_check(spark, sf):
    """Links and replays of the log; one line in 53 carries a hash that others of its store carry too."""
    n = (F.regexp_extract("store_id", r"(\d+)$", 1).cast("long") * I.LINES + F.col("line_no") - 1)
    lines = _live_lines(spark, sf).withColumn("record_hash", F.when((n % 53 == 0) & F.col("valid"), REPLAYED).otherwise(F.col("record_hash")))
    # Small runs and few shards, so that links cross runs and hashes share shards.
    return drain(stream_check_log(lines, bucket=64, shards=4))


@query("stream_dedupe_best", "project_id s, fingerprint s, severity s, seq l", f"WITH {I.DEDUPED_SQL} SELECT project_id, fingerprint, severity, seq FROM deduped")
def stream_dedupe_best(spark, sf):
    found = I.findings(_Streamed(spark, sf), sf)
    kept = best_findings(spark, shared_folder(spark, "best"), found.schema)
    kept.keep_up(found).awaitTermination()
    return kept.read()


@query("stream_dedupe_first", "project_id s, fingerprint s",
       "SELECT DISTINCT 'proj' || (user_id % 5) AS project_id, sha256('f' || (event_id % 50)) AS fingerprint FROM events")
def stream_dedupe_first(spark, sf):
    events = stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    findings = events.select("ts", I.text("proj", F.col("user_id") % 5).alias("project_id"), I.sha(I.text("f", F.col("event_id") % 50)).alias("fingerprint"))
    return drain(T.stream_dedupe_first(findings)).select("project_id", "fingerprint")


@query("incremental_scan", "project_id s, file s, line l, rule s", security_sql(I.CODE_FILES_SQL))
def incremental_scan(spark, sf):
    """Two thirds of the files are unchanged: their findings are reused, and the result is the full scan."""
    files = I.code_files(spark, sf).withColumn("mtime", F.lit("2024-01-02 00:00:00").cast("timestamp"))
    before = F.lit("2024-01-01 00:00:00").cast("timestamp")
    snapshot = files.withColumn("mtime", F.when(F.length("content") % 3 == 0, before).otherwise(F.col("mtime")))
    return T.incremental_scan(files, snapshot, scan_rules(snapshot, ["security"]), ["security"])
