"""Provenance log checks over a log derived from events, 500 lines per store."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeaudit.operators import provenance as P
from codeaudit.queries import inputs as I
from codeaudit.queries.registry import query, table

W = "WITH " + I.LOG_SQL
FINDING = "store_id s, rule s, severity s, line_no l, message s"


@query("chain_verify", FINDING, f"""{W},
p AS (SELECT *, lag(record_hash) OVER w AS ph, lag(malformed) OVER w AS pm FROM log_lines WINDOW w AS (PARTITION BY store_id ORDER BY line_no))
SELECT store_id, 'VG-PROV-001' AS rule, 'BLOCKER' AS severity, line_no, 'line ' || line_no || CASE WHEN malformed THEN ' is empty' ELSE ' prev_record_hash does not match the previous record' END AS message
FROM p WHERE malformed OR ((line_no = 1 AND prev_record_hash IS NOT NULL) OR (line_no > 1 AND NOT pm AND prev_record_hash IS DISTINCT FROM ph))""")
def chain_verify(spark, sf):
    return P.verify_chain(I.log_lines(spark, sf))


@query("replay_check", FINDING, f"""{W}, f AS (SELECT *, min(line_no) OVER (PARTITION BY store_id, record_hash) AS first FROM records)
SELECT store_id, 'VG-PROV-006' AS rule, 'BLOCKER' AS severity, line_no, 'record ' || record_hash || ' appears more than once (replay)' AS message FROM f WHERE line_no <> first""")
def replay_check(spark, sf):
    return P.check_replay(I.log_records(spark, sf))


_PARENTS = """firsts AS (SELECT store_id, record_hash, min(line_no) AS first, arg_min(epoch, line_no) AS epoch FROM records GROUP BY ALL),
links AS (SELECT r.*, f.first, f.epoch AS parent_epoch FROM records r LEFT JOIN firsts f ON f.store_id = r.store_id AND f.record_hash = r.parent WHERE r.parent IS NOT NULL)"""


@query("parent_check", FINDING, f"""{W}, {_PARENTS}
SELECT store_id, CASE WHEN parent = record_hash THEN 'VG-PROV-007' WHEN first IS NULL THEN 'VG-PROV-005' ELSE 'VG-PROV-007' END AS rule, 'BLOCKER' AS severity, line_no,
  'line ' || line_no || CASE WHEN parent = record_hash THEN ' is its own parent' WHEN first IS NULL THEN ' references a missing parent' ELSE ' references a later record as parent' END AS message
FROM links WHERE parent = record_hash OR first IS NULL OR first > line_no""")
def parent_check(spark, sf):
    return P.check_parents(I.log_records(spark, sf))


@query("parent_time_check", FINDING, f"""{W}, {_PARENTS}
SELECT store_id, 'VG-PROV-W001' AS rule, 'WARN' AS severity, line_no, 'line ' || line_no || ' timestamp is earlier than a parent timestamp' AS message FROM links WHERE first < line_no AND epoch < parent_epoch""")
def parent_time_check(spark, sf):
    return P.check_parent_time(I.log_records(spark, sf))


_SIGNERS = """pins AS (SELECT DISTINCT store_id, contributor, key_id FROM records WHERE kind = 'contributor_registered'),
s AS (SELECT r.*, k.status, k.der, k.operations, k.store_id IS NOT NULL AS known,
    EXISTS (SELECT 1 FROM pins p WHERE p.store_id = r.store_id AND p.contributor = r.contributor) AS registered,
    EXISTS (SELECT 1 FROM pins p WHERE p.store_id = r.store_id AND p.contributor = r.contributor AND p.key_id = r.key_id) AS pinned
  FROM records r LEFT JOIN public_keys k ON k.store_id = r.store_id AND k.contributor = r.contributor AND k.key_id = r.key_id WHERE signed),
j AS (SELECT *, CASE WHEN NOT known THEN 'VG-PROV-003| signer is not trusted: no such public key' WHEN registered AND NOT pinned THEN 'VG-PROV-003| key is not pinned by a contributor_registered record'
    WHEN status = 'revoked' THEN 'VG-PROV-004| signed by a revoked key' WHEN NOT signature_ok THEN 'VG-PROV-002| signature does not verify'
    WHEN kind = 'operation_recorded' AND NOT contains(operations, op) THEN 'VG-PROV-004| operation "' || op || '" is not authorized for this key'
    WHEN kind = 'contributor_registered' AND 'der' || (event_id % 2) <> der THEN 'VG-PROV-003| registered public key does not match the key registry' END AS f FROM s)"""


@query("signer_check", FINDING, f"""{W}, {_SIGNERS},
m AS (SELECT store_id, line_no, f FROM j WHERE f IS NOT NULL
  UNION ALL SELECT store_id, line_no, 'VG-PROV-W003| registered operations differ from the key registry' FROM j WHERE f IS NULL AND kind = 'contributor_registered' AND 'train,' || op <> operations
  UNION ALL SELECT store_id, line_no, 'VG-PROV-W004| signed by "' || contributor || '" with no contributor_registered record' FROM j WHERE f IS NULL AND NOT registered)
SELECT store_id, split_part(f, '|', 1) AS rule, CASE WHEN contains(f, '-W') THEN 'WARN' ELSE 'BLOCKER' END AS severity, line_no, 'line ' || line_no || split_part(f, '|', 2) AS message FROM m""")
def signer_check(spark, sf):
    return P.check_signers(I.log_records(spark, sf), I.public_keys(spark, sf))


_REFS = """typed AS (SELECT r.*, g.hash FROM refs r LEFT JOIN registered g ON g.store_id = r.store_id AND g.ref = r.artifact WHERE regexp_matches(r.artifact, '^(dataset|model|pipeline)/[^@]+@'))"""


@query("artifact_ref_check", FINDING, f"""{W}, {_REFS}
SELECT store_id, CASE WHEN hash IS NULL THEN 'VG-PROV-W002' ELSE 'VG-PROV-011' END AS rule, CASE WHEN hash IS NULL THEN 'WARN' ELSE 'BLOCKER' END AS severity, line_no,
  'line ' || line_no || CASE WHEN hash IS NULL THEN ' references unverifiable artifact "' || artifact || '": not registered' ELSE ' hash for "' || artifact || '" does not match its registration' END AS message
FROM typed WHERE hash IS NULL OR hash <> sha256""")
def artifact_ref_check(spark, sf):
    return P.check_artifact_refs(I.log_records(spark, sf), I.registered(spark, sf))


@query("conflicting_registrations", "store_id s, ref s, sha256 s, first_line l, lines l", f"""{W},
h AS (SELECT store_id, artifact AS ref, sha256, min(line_no) AS first_line, count(*) AS lines FROM refs WHERE side = 'out' AND kind = 'artifact_registered' GROUP BY ALL)
SELECT * FROM h QUALIFY count(*) OVER (PARTITION BY store_id, ref) > 1""")
def conflicting_registrations(spark, sf):
    return P.conflicting_hashes(I.log_records(spark, sf))


@query("conflict_findings", FINDING, f"""{W},
h AS (SELECT store_id, artifact AS ref, count(DISTINCT sha256) AS n FROM refs WHERE side = 'out' AND kind = 'artifact_registered' GROUP BY ALL)
SELECT store_id, 'VG-PROV-010' AS rule, 'BLOCKER' AS severity, NULL AS line_no, 'artifact "' || ref || '" has conflicting registered hashes' AS message FROM h WHERE n > 1""")
def conflict_findings(spark, sf):
    return P.conflicting_registrations(I.log_records(spark, sf))


_SUMMARY = """summary AS (SELECT store_id, count(*) FILTER (NOT malformed) AS record_count, count(*) FILTER (malformed) AS malformed_count, count(*) FILTER (NOT malformed AND NOT signed) AS unsigned_count,
  arg_max(record_hash, line_no) FILTER (NOT malformed) AS head FROM log_lines GROUP BY ALL),
people AS (SELECT store_id, string_agg(contributor, ',' ORDER BY contributor) AS contributors FROM (SELECT DISTINCT store_id, contributor FROM records) GROUP BY ALL)"""


@query("provenance_summary", "store_id s, record_count l, malformed_count l, unsigned_count l, head s, contributors s", f"""{W}, {_SUMMARY}
SELECT summary.*, contributors FROM summary JOIN people USING (store_id)""")
def provenance_summary(spark, sf):
    return P.provenance_summary(I.log_lines(spark, sf)).withColumn("contributors", F.array_join("contributors", ","))


@query("provenance_status", "store_id s, anchored b, status s, rules s", f"""{W}, {_SUMMARY}
SELECT store_id, CASE WHEN store_no % 3 = 0 THEN NULL ELSE store_no % 3 = 1 END AS anchored, CASE WHEN store_no % 3 = 2 OR store_no % 4 = 3 THEN 'FAIL' ELSE 'UNSIGNED' END AS status,
  CASE WHEN store_no % 3 = 2 THEN 'VG-PROV-008,VG-PROV-009' ELSE 'VG-PROV-009' END AS rules
FROM summary JOIN (SELECT DISTINCT store_id, store_no FROM log_lines) USING (store_id)""")
def provenance_status(spark, sf):
    lines = I.log_lines(spark, sf)
    summary = P.provenance_summary(lines)
    n = F.substr(F.col("store_id"), F.lit(6)).cast("long")
    anchors = summary.select("store_id", F.when(n % 3 == 1, F.concat(F.lit(" "), F.col("head"))).when(n % 3 == 2, "sha256:other").alias("expected_head"))
    blockers = summary.filter(n % 4 == 3).select("store_id", F.lit("BLOCKER").alias("severity"))
    status, extra = P.provenance_status(summary, blockers, anchors)
    rules = extra.groupBy("store_id").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))
    return status.join(rules, "store_id", "left")


@query("verify_provenance", "store_id s, list s, rule s, findings l", f"""{W}, {_PARENTS}, {_SIGNERS}, {_REFS},
chain AS (SELECT *, lag(record_hash) OVER w AS ph, lag(malformed) OVER w AS pm FROM log_lines WINDOW w AS (PARTITION BY store_id ORDER BY line_no)),
found AS (
  SELECT store_id, 'VG-PROV-001' AS rule FROM chain WHERE malformed OR ((line_no = 1 AND prev_record_hash IS NOT NULL) OR (line_no > 1 AND NOT pm AND prev_record_hash IS DISTINCT FROM ph))
  UNION ALL SELECT store_id, 'VG-PROV-006' FROM (SELECT store_id, line_no, min(line_no) OVER (PARTITION BY store_id, record_hash) AS first FROM records) WHERE line_no <> first
  UNION ALL SELECT store_id, CASE WHEN parent <> record_hash AND first IS NULL THEN 'VG-PROV-005' ELSE 'VG-PROV-007' END FROM links WHERE parent = record_hash OR first IS NULL OR first > line_no
  UNION ALL SELECT store_id, split_part(f, '|', 1) FROM j WHERE f IS NOT NULL
  UNION ALL SELECT store_id, 'VG-PROV-W003' FROM j WHERE f IS NULL AND kind = 'contributor_registered' AND 'train,' || op <> operations
  UNION ALL SELECT store_id, 'VG-PROV-W004' FROM j WHERE f IS NULL AND NOT registered
  UNION ALL SELECT store_id, CASE WHEN hash IS NULL THEN 'VG-PROV-W002' ELSE 'VG-PROV-011' END FROM typed WHERE hash IS NULL OR hash <> sha256
  UNION ALL SELECT store_id, 'VG-PROV-010' FROM refs WHERE side = 'out' AND kind = 'artifact_registered' GROUP BY store_id, artifact HAVING count(DISTINCT sha256) > 1
  UNION ALL SELECT store_id, 'VG-PROV-W001' FROM links WHERE first < line_no AND epoch < parent_epoch
  UNION ALL SELECT store_id, 'VG-PROV-009' FROM records WHERE NOT signed GROUP BY store_id)
SELECT store_id, CASE WHEN contains(rule, '-W') THEN 'warnings' ELSE 'findings' END AS list, rule, count(*) AS findings FROM found GROUP BY ALL""")
def verify_provenance(spark, sf):
    lines = I.log_lines(spark, sf)
    findings, _ = P.verify_provenance(lines, I.public_keys(spark, sf), I.registered(spark, sf), parsed=lines)
    return findings.groupBy("store_id", "list", "rule").agg(F.count("*").alias("findings"))


# ---- raw log lines: canonical text and its hash, built by both engines --------
_ENVELOPE = ('{"actor":{"contributor":"', '","key_id":null},"inputs":[],"kind":"artifact_registered","metadata":{"n":', '},"outputs":[{"artifact":"dataset/d@1","sha256":"',
             '"}],"parent_record_hashes":[],"prev_record_hash":null', ',"schema_version":"1.0","timestamp":"2024-01-01T00:00:00.000Z"}')


def raw_log(spark, sf):
    """Log lines as JSON text; some are blank, broken, altered or miss a field."""
    n = F.col("event_id")
    a, b, c, d, e = _ENVELOPE
    body = I.text(a, "c", n % 4, b, n, c, I.sha(I.text("x", n)), d, e)
    digest = I.text("sha256:", I.sha(body))
    full = I.text(a, "c", n % 4, b, F.when(n % 7 == 6, n + 1).otherwise(n), c, I.sha(I.text("x", n)), d, ',"record_hash":"', digest, '","record_id":"', digest, '"', e)
    raw = F.when(n % 7 == 1, "  ").when(n % 7 == 2, "{not json").when(n % 7 == 3, F.replace(full, F.lit('"kind":"artifact_registered"'), F.lit('"kind":"other"'))).when(
        n % 7 == 4, F.replace(full, F.lit('"metadata":{'), F.lit('"metadata":{"f":1.5,'))).when(n % 7 == 5, F.replace(full, F.lit('"inputs":[],'), F.lit('"extra":1,"inputs":[],'))).otherwise(full)
    return table(spark, sf, "events").select(I.text("store", I.div(n, I.LINES)).alias("store_id"), (n % I.LINES + 1).alias("line_no"), raw.alias("raw"), n.alias("n"))


@query("parse_log", "store_id s, line_no l, problem s, record_hash s", f"""WITH b AS (SELECT event_id AS n, '{_ENVELOPE[0]}c' || (event_id % 4) || '{_ENVELOPE[1]}' || event_id || '{_ENVELOPE[2]}' || sha256('x' || event_id) || '{_ENVELOPE[3]}{_ENVELOPE[4]}' AS body FROM events)
SELECT 'store' || (n // {I.LINES}) AS store_id, n % {I.LINES} + 1 AS line_no, CASE n % 7 WHEN 1 THEN 'is empty' WHEN 2 THEN 'is not valid canonical JSON' WHEN 3 THEN 'is invalid: kind is not a record kind'
  WHEN 4 THEN 'is not valid canonical JSON' WHEN 5 THEN 'is invalid: unknown field' WHEN 6 THEN 'is invalid: record_hash mismatch' END AS problem, CASE WHEN n % 7 = 0 THEN 'sha256:' || sha256(body) END AS record_hash FROM b""")
def parse_log(spark, sf):
    parsed = P.parse_log(raw_log(spark, sf))
    short = F.when(F.col("problem").startswith("is not valid"), "is not valid canonical JSON").otherwise(F.col("problem"))
    return parsed.select("store_id", "line_no", short.alias("problem"), F.col("record.record_hash").alias("record_hash"))


@query("build_records", "store_id s, line_no l, kind s, record_hash s, prev_record_hash s", f"""WITH RECURSIVE
lines AS (SELECT 'store' || (event_id // {I.LINES}) AS store_id, event_id AS n, row_number() OVER (PARTITION BY event_id // {I.LINES} ORDER BY event_id) AS line_no FROM events),
chain AS (
  SELECT store_id, line_no, CAST(NULL AS VARCHAR) AS prev_record_hash,
    'sha256:' || sha256('{{"kind":"artifact_registered","metadata":{{"n":' || n || '}},"prev_record_hash":null,"schema_version":"1.0"}}') AS record_hash FROM lines WHERE line_no = 1
  UNION ALL
  SELECT l.store_id, l.line_no, c.record_hash,
    'sha256:' || sha256('{{"kind":"artifact_registered","metadata":{{"n":' || l.n || '}},"prev_record_hash":"' || c.record_hash || '","schema_version":"1.0"}}')
  FROM chain c JOIN lines l ON l.store_id = c.store_id AND l.line_no = c.line_no + 1)
SELECT *, 'artifact_registered' AS kind FROM chain""")
def build_records(spark, sf):
    n = F.col("event_id")
    body = I.text('{"kind":"artifact_registered","metadata":{"n":', n, '},"schema_version":"1.0"}')
    return P.build_records(table(spark, sf, "events").select(I.text("store", I.div(n, I.LINES)).alias("store_id"), n.alias("seq"), body.alias("body")))


# ---- lineage -----------------------------------------------------------------

@query("lineage", "store_id s, artifact s, line_no l", f"""WITH RECURSIVE {I.LOG_SQL},
last AS (SELECT store_id, record_hash, max(line_no) AS line_no FROM records GROUP BY ALL),
start AS (SELECT DISTINCT r.store_id, r.artifact, l.record_hash FROM refs r JOIN records l ON l.store_id = r.store_id AND l.line_no = r.line_no WHERE r.side = 'out' AND r.artifact IN ('model/m1@1', 'dataset/d2@1')),
walk AS (SELECT store_id, artifact, record_hash FROM start
  UNION SELECT w.store_id, w.artifact, p.record_hash FROM walk w JOIN records c ON c.store_id = w.store_id AND c.record_hash = w.record_hash JOIN last p ON p.store_id = c.store_id AND p.record_hash = c.parent)
SELECT DISTINCT w.store_id, w.artifact, l.line_no FROM walk w JOIN last l USING (store_id, record_hash)""")
def lineage(spark, sf):
    records = I.log_records(spark, sf)
    wanted = records.select("store_id").distinct().select("store_id", F.explode(F.array(F.lit("model/m1@1"), F.lit("dataset/d2@1"))).alias("artifact"))
    return P.lineage(records, wanted)


@query("latest_inference", "store_id s, target s, line_no l, record_id s", f"""{W}
SELECT store_id, artifact AS target, max(line_no) AS line_no, (SELECT l.record_hash FROM records l WHERE l.store_id = r.store_id AND l.line_no = max(r.line_no)) AS record_id
FROM refs r WHERE side = 'out' AND kind = 'inference_recorded' GROUP BY store_id, artifact""")
def latest_inference(spark, sf):
    records = I.log_records(spark, sf)
    targets = P.artifact_refs(records.filter("kind = 'inference_recorded'")).filter("side = 'out'").select("store_id", F.col("artifact").alias("target"))
    return P.latest_inference(records, targets)
