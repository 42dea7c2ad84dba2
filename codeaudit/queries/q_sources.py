"""Sources and sinks driven over the shipped tables, added normalizers and analyzers, and records by kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeaudit.functions.refs import key_id
from codeaudit.operators import normalise as N
from codeaudit.operators import recording, scan_rules
from codeaudit.operators.scan_rules import register_analyzer
from codeaudit.queries import inputs as I
from codeaudit.queries.registry import query, table
from codeaudit.session import shared_folder
from codeaudit.sources.provenance import read_provenance_log
from codeaudit.sources.sinks import append_history, read_history, write_findings

FS = "WITH " + I.FINDINGS_SQL


@query("log_lines_from_files", "store_id s, line_no l, raw s", f"""SELECT 'store' || (event_id // {I.LINES}) AS store_id, event_id % {I.LINES} + 1 AS line_no,
  CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE '{{"n":' || event_id || '}}' END AS raw FROM events""")
def log_lines_from_files(spark, sf):
    """Logs are written as text, one file a store, and read back in parts of any size; a fifth of the lines is blank."""
    n = F.col("event_id")
    raw = F.when(n % 5 == 0, "").when(n % 5 == 1, " ").otherwise(I.text('{"n":', n, "}"))
    lines = table(spark, sf, "events").select(I.text("store", I.div(n, I.LINES)).alias("store"), raw.alias("value"), n)
    folder = shared_folder(spark, "logs")
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines.repartition(count, "store").sortWithinPartitions("store", "event_id").drop("event_id").write.partitionBy("store").text(folder)
    return read_provenance_log(spark, folder, F.regexp_extract("file", r"store=([^/]+)/", 1))


@query("findings_sink", "project_id s, findings l, seqs l", f"{FS} SELECT project_id, count(*) AS findings, sum(seq) AS seqs FROM findings GROUP BY project_id")
def findings_sink(spark, sf):
    """Findings written into their folders and read back."""
    folder = shared_folder(spark, "findings")
    write_findings(I.findings(spark, sf), folder)
    return spark.read.parquet(folder).groupBy("project_id").agg(F.count("*").alias("findings"), F.sum("seq").alias("seqs"))


@query("history_sink", "project_id s, seq l, score l, grade s", """SELECT 'proj' || (user_id % 5) AS project_id, event_id AS seq, CAST(event_id % 101 AS INTEGER) AS score, 'B' AS grade FROM events""")
def history_sink(spark, sf):
    """A history to which overlapping parts are appended twice holds every scan once."""
    n = F.col("event_id")
    rows = table(spark, sf, "events").select(
        I.text("proj", F.col("user_id") % 5).alias("project_id"), F.timestamp_seconds(n).alias("ts"), n.alias("seq"), (n % 101).cast("int").alias("score"),
        F.lit("B").alias("grade"), F.lit(0).cast("long").alias("findingsCount"))
    folder = shared_folder(spark, "history")
    for part in ("seq % 3 <> 0", "seq % 3 <> 1", "seq % 2 = 0"):
        append_history(rows.filter(part), folder)
    return read_history(spark, folder)


@query("normalize_direct", "project_id s, id s, fingerprint s, tool s, severity s", f"{FS} SELECT project_id, id, fingerprint, tool, severity FROM findings")
def normalize_direct(spark, sf):
    """Complete findings pass an added normalizer untouched, raw rows are completed: half of the findings each way."""
    found = I.findings(spark, sf)
    N.register_normalizer("complete", N.normalize_direct)
    even = F.col("seq") % 2 == 0
    raw = I.raw_findings(spark, sf).filter(even)
    return N.union_findings(N.normalize("complete", found.filter(~even)), N.normalize("deployguard", raw).select(found.columns))


@query("added_analyzer", "project_id s, file s, line l, rule s, severity s",
       "SELECT 'proj' || (p_partkey // 20) AS project_id, 'p' || p_partkey || '/requirements.txt' AS file, 1 AS line, 'pinned-note' AS rule, 'INFO' AS severity FROM part")
def added_analyzer(spark, sf):
    """An analyzer of the user's own runs with the rule packs; its findings among theirs."""
    from codeaudit.queries.q_graph import manifests

    def notes(files):
        return files.filter(F.col("content").startswith("# pinned")).select(
            "project_id", F.col("path").alias("file"), F.lit(1).alias("line"), F.lit(7).cast("long").alias("seq"), F.lit("own").alias("tool"),
            F.lit("bugs").alias("category"), F.lit("INFO").alias("severity"), F.lit(None).cast("int").alias("column"),
            F.lit("pinned-note").alias("rule"), F.lit("a note").alias("message"), F.lit("").alias("suggestedFix"))

    register_analyzer("pinned-note", notes)
    try:
        return scan_rules.scan_rules(manifests(spark, sf), ["security"])
    finally:
        del scan_rules._extra_analyzers["pinned-note"]


@query("key_ids", "doc_id l, key_id s", "SELECT doc_id, substr(sha256(encode(text)), 1, 32) AS key_id FROM documents")
def key_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", key_id(F.base64(F.encode("text", "UTF-8"))).alias("key_id"))


_DEEP = '{"a":{"b":{"c":{"d":{"e":{"f":{"g":1}}}}}}}'


def _artifacts(spark, sf):
    n = F.col("event_id")
    return table(spark, sf, "events").select(
        I.text("store", I.div(n, I.LINES)).alias("store_id"), n.alias("seq"), F.lit("2024-01-01T00:00:00.000Z").alias("timestamp"), F.lit("ann").alias("contributor"),
        F.when(n % 11 == 0, "").otherwise("k").alias("key_id"), F.when(n % 7 != 0, F.array(F.struct(
            I.text("dataset/d", n % 7, "@1").alias("artifact"), I.sha(I.text("d", n)).alias("sha256")))).alias("outputs"),
        F.when(n % 3 == 0, '{"n":1}').when((n % 3 == 1) & (n % 5 == 0), _DEEP).alias("metadata"))


_REASON = """CASE WHEN event_id % 11 = 0 THEN 'actor.key_id must be null or a non-empty string of at most 128 characters'
  WHEN event_id % 3 = 1 AND event_id % 5 = 0 THEN 'metadata nesting depth 7 exceeds the limit of 6'
  WHEN event_id % 7 = 0 THEN 'artifact_registered requires at least one output' END"""


@query("rejected_records", "store_id s, seq l, problem s", f"""SELECT 'store' || (event_id // {I.LINES}) AS store_id, event_id AS seq, {_REASON} AS problem FROM events WHERE {_REASON} IS NOT NULL""")
def rejected_records(spark, sf):
    return recording.record_artifacts(_artifacts(spark, sf))[1]


@query("recorded_artifacts", "store_id s, line_no l, kind s, record_hash s, prev_record_hash s", f"""WITH RECURSIVE
lines AS (SELECT 'store' || (event_id // {I.LINES}) AS store_id, event_id AS n, row_number() OVER (PARTITION BY event_id // {I.LINES} ORDER BY event_id) AS line_no,
  '{{"actor":{{"contributor":"ann","key_id":"k"}},"inputs":[],"kind":"artifact_registered",' || CASE WHEN event_id % 3 = 0 THEN '"metadata":{{"n":1}},' ELSE '' END ||
  '"outputs":[{{"artifact":"dataset/d' || (event_id % 7) || '@1","sha256":"' || sha256('d' || event_id) || '"}}],"parent_record_hashes":[],"prev_record_hash":' AS head,
  ',"schema_version":"1.0","timestamp":"2024-01-01T00:00:00.000Z"}}' AS tail FROM events WHERE {_REASON} IS NULL),
chain AS (
  SELECT store_id, line_no, CAST(NULL AS VARCHAR) AS prev_record_hash, 'sha256:' || sha256(head || 'null' || tail) AS record_hash FROM lines WHERE line_no = 1
  UNION ALL
  SELECT l.store_id, l.line_no, c.record_hash, 'sha256:' || sha256(l.head || '"' || c.record_hash || '"' || l.tail) FROM chain c JOIN lines l ON l.store_id = c.store_id AND l.line_no = c.line_no + 1)
SELECT *, 'artifact_registered' AS kind FROM chain""")
def recorded_artifacts(spark, sf):
    return recording.record_artifacts(_artifacts(spark, sf))[0]
