"""Models, preprocessing identities, inferences and the assurance roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeaudit.operators import assurance as AS
from codeaudit.operators import identity as ID
from codeaudit.operators import inference as INF
from codeaudit.operators import models as MO
from codeaudit.operators import scoring as A
from codeaudit.queries import inputs as I
from codeaudit.queries.registry import query, table

FORMATS = ["safetensors", "onnx", "pt", "pth", "other"]
HEADS = ["02000000000000007B7D", "0800", "504B0304", "8002", "746578740A74657874"]


def model_tables(spark, sf):
    """One model manifest and (mostly) one file per part, with six kinds of state."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    state, fmt = I.div(k, 5) % 6, I.pick(FORMATS, k % 5)
    owner = I.text("store", I.div(k, 100)).alias("store_id")
    digest = I.sha(I.text("model", k))
    models = p.select(owner, I.text("m", k).alias("id"), F.lit("1").alias("version"), fmt.alias("format"), (k + 1000).alias("size"),
                      digest.alias("sha256"), F.lit("alice").alias("contributor"))
    head = F.when(state == 2, F.unhex(F.lit("00"))).otherwise(F.unhex(I.pick(HEADS, k % 5)))
    files = p.select(owner, F.concat(I.text("models/m", k, "."), fmt).alias("path"), F.when(state == 4, 0).otherwise(k + 1000).alias("size"),
                     F.when(state == 1, I.sha(I.text("other", k))).otherwise(digest).alias("sha256"), head.alias("head"),
                     F.when(state == 5, "symlink").otherwise("file").alias("file_type"), state.alias("state"))
    return models, files.filter("state <> 3").drop("state")


@query("model_verify", "store_id s, id s, status s, rules s", """WITH m AS (SELECT 'store' || (p_partkey // 100) AS store_id, 'm' || p_partkey AS id, p_partkey % 5 AS f, p_partkey // 5 % 6 AS s FROM part)
SELECT store_id, id, CASE WHEN s IN (1, 3, 4, 5) OR (s = 2 AND f <> 4) THEN 'FAIL' ELSE 'PASS' END AS status,
  CASE WHEN s = 4 THEN 'VG-MODEL-003' WHEN s IN (3, 5) THEN 'VG-MODEL-001' WHEN s = 2 AND f <> 4 THEN 'VG-MODEL-002' WHEN s = 1 AND f = 3 THEN 'VG-MODEL-001,VG-MODEL-005' WHEN s = 1 THEN 'VG-MODEL-001'
    WHEN s = 0 AND f = 3 THEN 'VG-MODEL-005' ELSE '' END AS rules FROM m""")
def model_verify(spark, sf):
    findings, statuses = MO.verify_models(*model_tables(spark, sf))
    rules = findings.groupBy("store_id", "id").agg(F.array_join(F.array_sort(F.collect_list("rule")), ",").alias("rules"))
    return statuses.join(rules, ["store_id", "id"], "left").fillna("", ["rules"])


@query("model_sniff", "key l, detected s, magic_ok b, pickle_based b, detail s", """SELECT p_partkey AS key, (['safetensors','onnx','pt','pth','other'])[p_partkey % 5 + 1] AS detected, TRUE AS magic_ok, p_partkey % 5 = 3 AS pickle_based,
  (['safetensors header observed','onnx protobuf header observed','zip container header observed','python pickle protocol header observed','safetensors header length exceeds 100 MiB'])[p_partkey % 5 + 1] AS detail FROM part""")
def model_sniff(spark, sf):
    k = F.col("p_partkey")
    name = F.concat(F.lit("m."), I.pick(FORMATS, k % 5))
    s = MO.sniff_format(F.unhex(I.pick(HEADS, k % 5)), k + 1000, name)
    return table(spark, sf, "part").select(k.alias("key"), s.alias("s")).select("key", "s.*")


@query("newest_version", "id s, newest_version s", """WITH v AS (SELECT DISTINCT 'm' || (p_partkey // 40) AS id, (p_size % 12) || '.' || CASE WHEN p_partkey % 5 = 0 THEN 'rc' ELSE CAST(p_partkey % 13 AS VARCHAR) END AS version FROM part)
SELECT id, version AS newest_version FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY CAST(split_part(version, '.', 1) AS INTEGER) DESC, CASE WHEN split_part(version, '.', 2) = 'rc' THEN -1 ELSE CAST(split_part(version, '.', 2) AS INTEGER) END DESC) = 1""")
def newest_version(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    version = F.concat(I.text(size % 12, "."), F.when(k % 5 == 0, "rc").otherwise((k % 13).cast("string")))
    return INF.newest_versions(table(spark, sf, "part").select(I.text("m", I.div(k, 40)).alias("id"), version.alias("version")), ["id"])


@query("register_models", "store_id s, id s, detected_format s, record_hash s", """WITH m AS (SELECT p_partkey AS k, 'store' || (p_partkey // 100) AS store_id, 'm' || p_partkey AS id, (['safetensors','onnx','pt','pth','other'])[p_partkey % 5 + 1] AS f FROM part)
SELECT store_id, id, f AS detected_format, 'sha256:' || sha256('{"actor":{"contributor":"alice","key_id":null},"created_at":"2024-01-01T00:00:00.000Z","detected_format":"' || f || '","format":"' || f || '","id":"' || id ||
  '","kind":"model_manifest","metadata":{"a":1,"k":' || k || '},"schema_version":"1.0","sha256":"' || sha256('model' || k) || '","size":' || (k + 1000) || ',"version":"1"}') AS record_hash FROM m""")
def register_models(spark, sf):
    k = F.col("p_partkey")
    fmt = I.pick(FORMATS, k % 5)
    files = table(spark, sf, "part").select(
        I.text("store", I.div(k, 100)).alias("store_id"), I.text("m", k).alias("id"), F.lit("1").alias("version"), fmt.alias("format"),
        F.concat(F.lit("x."), fmt).alias("path"), (k + 1000).alias("size"), I.sha(I.text("model", k)).alias("sha256"), F.unhex(I.pick(HEADS, k % 5)).alias("head"),
        F.lit("alice").alias("contributor"), F.lit(None).cast("string").alias("key_id"), I.text('{"k": ', k, ', "a": 1.0}').alias("metadata"))
    return MO.register_models(files, F.lit("2024-01-01 00:00:00").cast("timestamp"))[0]


# ---- identities --------------------------------------------------------------
_ID = ('{"code":{"files":[{"path":"src/a', '.py","sha256":"', '"}],"git_commit":null},"dependency_lock":null,"kind":"pipeline_identity","parameters":{"n":',
       '},"preprocess_config":{"path":"cfg/', '.json","sha256":"', '"},"runtime":{"language":"node","libraries":[{"name":"a","version":"1"}],"version":"v1"},"schema_version":"1.0"}')


def identity_tables(spark, sf):
    k = F.col("p_partkey")
    code, conf = I.sha(I.text("code", k)), I.sha(I.text("conf", k))
    body = I.text(_ID[0], k, _ID[1], code, _ID[2], k, _ID[3], k, _ID[4], conf, _ID[5])
    p = table(spark, sf, "part")
    owner = I.text("store", I.div(k, 100)).alias("store_id")
    manifests = p.select(owner, I.text("p", k).alias("name"), F.lit("1").alias("version"), body.alias("identity"),
                         F.when(k % 4 == 3, I.text("sha256:", I.sha(I.text("x", k)))).otherwise(I.text("sha256:", I.sha(body))).alias("pipeline_id"))
    files = p.select(owner, k.alias("k"), F.explode(F.array(
        F.struct(I.text("src/a", k, ".py").alias("path"), F.when(k % 4 == 1, I.sha(I.text("new", k))).otherwise(code).alias("sha256")),
        F.struct(I.text("cfg/", k, ".json").alias("path"), F.when(k % 4 != 2, conf).alias("sha256")))).alias("f")).select("store_id", "f.*")
    return manifests, files.filter("sha256 IS NOT NULL")


@query("identity_verify", "store_id s, name s, status s, detail s", """SELECT 'store' || (p_partkey // 100) AS store_id, 'p' || p_partkey AS name, CASE WHEN p_partkey % 4 = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
  CASE p_partkey % 4 WHEN 1 THEN 'recomputed pipeline identity does not match the registered identity' WHEN 2 THEN 'cannot recompute the pipeline identity: file not found cfg/' || p_partkey || '.json'
    WHEN 3 THEN 'pipeline manifest is invalid: pipeline_id does not match the identity' END AS detail FROM part""")
def identity_verify(spark, sf):
    findings, statuses = ID.verify_identities(*identity_tables(spark, sf))
    return statuses.join(findings.select("store_id", "name", "detail"), ["store_id", "name"], "left")


@query("register_identities", "store_id s, name s, pipeline_id s", f"""SELECT 'store' || (p_partkey // 100) AS store_id, 'p' || p_partkey AS name, 'sha256:' || sha256('{_ID[0]}' || p_partkey || '{_ID[1]}' || sha256('code' || p_partkey) || '{_ID[2]}' || p_partkey || '{_ID[3]}' ||
  p_partkey || '{_ID[4]}' || sha256('conf' || p_partkey) || '{_ID[5]}') AS pipeline_id FROM part""")
def register_identities(spark, sf):
    k = F.col("p_partkey")
    one = F.struct(I.text("src/a", k, ".py").alias("path"), I.sha(I.text("code", k)).alias("sha256"))
    conf = F.struct(I.text("cfg/", k, ".json").alias("path"), I.sha(I.text("conf", k)).alias("sha256"))
    lock = F.lit('{"packages":{"":{"version":"9"},"node_modules/a":{"version":"1"},"node_modules/b":{}}}')
    specs = table(spark, sf, "part").select(
        I.text("store", I.div(k, 100)).alias("store_id"), I.text("p", k).alias("name"), F.lit("1").alias("version"), F.lit("alice").alias("contributor"),
        conf.alias("preprocess_config"), F.lit(None).cast("string").alias("git_commit"), F.array(one).alias("code_files"),
        F.lit(None).cast("struct<path:string,sha256:string>").alias("dependency_lock"), I.text('{ "n": ', k, " }").alias("parameters"),
        F.lit("node").alias("language"), F.lit("v1").alias("runtime_version"), ID.runtime_libraries(lock, F.lit("{}")).alias("libraries"))
    return ID.register_identities(specs, F.lit("2024-01-01 00:00:00").cast("timestamp"))


# ---- inferences --------------------------------------------------------------

def inference_tables(spark, sf):
    reg = I.registered(spark, sf)
    name = F.substring_index(F.substring_index("ref", "/", -1), "@", 1)
    base = reg.filter("type = 'model'").select("store_id", name.alias("id"), F.lit("1").alias("version"), F.col("hash").alias("sha256"))
    newer = base.filter("id = 'm1'").withColumns({"version": F.lit("1.2"), "sha256": I.sha(F.col("store_id"))})
    setups = reg.filter("type = 'pipeline'").select("store_id", name.alias("name"), F.lit("1").alias("version"), I.text("sha256:", F.col("hash")).alias("pipeline_id"))
    n = F.col("event_id")
    out = F.when(n % 25 == 2, I.sha(I.text("out", n - 3))).when(n % 26 == 2, I.sha(I.text("zzz", n))).otherwise(I.sha(I.text("out", n)))
    found = table(spark, sf, "events").select(I.text("store", I.div(n, I.LINES)).alias("store_id"), F.explode(F.array(
        F.struct(I.text("in/", n).alias("path"), F.when(n % 21 == 2, I.sha(I.text("bad", n))).otherwise(I.sha(I.text("in", n))).alias("sha256")),
        F.struct(I.text("out/", n).alias("path"), F.when(n % 27 != 2, out).alias("sha256")))).alias("f")).select("store_id", "f.*").filter("sha256 IS NOT NULL")
    return base.unionByName(newer), setups, found


_INFER = f"""
r AS (SELECT * FROM records WHERE kind = 'inference_recorded'),
lasts AS (SELECT store_id, record_hash, max(line_no) AS last FROM records GROUP BY ALL),
outs AS (SELECT DISTINCT store_id, sha256 FROM refs WHERE side = 'out' AND kind IN ('inference_recorded', 'artifact_registered')),
e AS (SELECT r.*, event_id % 5 AS m, event_id // 3 % 3 AS p, l.last, parent IS NOT NULL AND (l.last IS NULL OR l.last >= r.line_no) AS late,
   CASE WHEN event_id % 27 = 2 THEN 'VG-OUT-002' WHEN event_id % 25 = 2 THEN CASE WHEN EXISTS (SELECT 1 FROM outs o WHERE o.store_id = r.store_id AND o.sha256 = sha256('out' || (event_id - 3))) THEN 'VG-OUT-003' ELSE 'VG-OUT-001' END
        WHEN event_id % 26 = 2 THEN 'VG-OUT-001' END AS out_rule
   FROM r LEFT JOIN lasts l ON l.store_id = r.store_id AND l.record_hash = r.parent),
rules AS (SELECT store_id, line_no, unnest([
   CASE WHEN m = 4 OR event_id % 11 = 0 THEN 'VG-INFER-003' END, CASE WHEN m = 1 THEN 'VG-INFER-003' END, CASE WHEN p = 2 OR event_id % 11 = 0 THEN 'VG-PIPE-001' END,
   CASE WHEN event_id % 21 = 2 THEN 'VG-INFER-001' END, CASE WHEN late THEN 'VG-INFER-002' END, out_rule]) AS rule FROM e)"""


@query("inference_verify", "store_id s, line_no l, status s, output_status s, rules s", f"""WITH {I.LOG_SQL}, {_INFER}
SELECT e.store_id, e.line_no, CASE WHEN bool_or(coalesce(rule LIKE 'VG-INFER%' OR rule LIKE 'VG-PIPE%', FALSE)) THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN any_value(out_rule) IS NULL THEN 'PASS' ELSE 'FAIL' END AS output_status,
  coalesce(string_agg(rule, ',' ORDER BY rule), '') AS rules FROM e JOIN rules USING (store_id, line_no) GROUP BY e.store_id, e.line_no""")
def inference_verify(spark, sf):
    models, setups, found = inference_tables(spark, sf)
    findings, statuses = INF.verify_inferences(I.log_records(spark, sf), models, setups, found)
    rules = findings.groupBy("store_id", "line_no").agg(F.array_join(F.array_sort(F.collect_list("rule")), ",").alias("rules"))
    return statuses.join(rules, ["store_id", "line_no"], "left").fillna("", ["rules"])


@query("recorded_outputs", "store_id s, sha256 s", f"""WITH {I.LOG_SQL} SELECT DISTINCT store_id, sha256 FROM refs WHERE side = 'out' AND kind IN ('inference_recorded', 'artifact_registered')""")
def recorded_outputs(spark, sf):
    return INF.recorded_outputs(I.log_records(spark, sf))


# ---- roll-up -----------------------------------------------------------------
DIMS = AS.DIMENSIONS
STATES = ["PASS", "UNSIGNED", "UNANCHORED", "NOT_CHECKED", "FAIL"]


def dimension_entries(spark, sf):
    """Statuses of many entries per store and dimension; whole stores pass or have none."""
    n = F.col("event_id")
    store = I.div(n, 50)
    status = F.when(store % 4 == 0, "PASS").when(store % 4 == 1, I.pick(STATES, (n + store) % 4)).otherwise(I.pick(STATES, (n * 7 + store) % 5))
    return table(spark, sf, "events").select(I.text("store", store).alias("store_id"), I.pick(DIMS, n % F.when(store % 4 == 3, 5).otherwise(6)).alias("dimension"),
                                             status.alias("status"), n.alias("ord"))


_DIMS = """d AS (SELECT event_id AS ord, event_id // 50 AS s, CASE WHEN event_id // 50 % 4 = 0 THEN 'PASS' WHEN event_id // 50 % 4 = 1 THEN (['PASS','UNSIGNED','UNANCHORED','NOT_CHECKED'])[(event_id + event_id // 50) % 4 + 1]
    ELSE (['PASS','UNSIGNED','UNANCHORED','NOT_CHECKED','FAIL'])[(event_id * 7 + event_id // 50) % 5 + 1] END AS status,
  (['dataset','model','pipeline','inference','output','provenance'])[event_id % (CASE WHEN event_id // 50 % 4 = 3 THEN 5 ELSE 6 END) + 1] AS dimension FROM events),
w AS (SELECT 'store' || s AS store_id, dimension, status FROM d QUALIFY row_number() OVER (PARTITION BY s, dimension ORDER BY CASE status WHEN 'FAIL' THEN 3 WHEN 'UNSIGNED' THEN 2 WHEN 'UNANCHORED' THEN 2 WHEN 'NOT_CHECKED' THEN 1 ELSE 0 END DESC, ord) = 1)"""


@query("dimension_status", "store_id s, dimension s, status s", f"WITH {_DIMS} SELECT * FROM w")
def dimension_status(spark, sf):
    return AS.dimension_status(dimension_entries(spark, sf))


@query("overall_verdict", "store_id s, overall s, failed_dimensions s, assurance_exit l", f"""WITH {_DIMS},
o AS (SELECT store_id, CASE WHEN bool_or(status = 'FAIL') THEN 'INTEGRITY VIOLATION' WHEN count(*) < 6 OR bool_or(status <> 'PASS') THEN 'INCOMPLETE' ELSE 'VERIFIED' END AS overall,
  coalesce(string_agg(dimension, ', ' ORDER BY list_position(['dataset','model','pipeline','inference','output','provenance'], dimension)) FILTER (status = 'FAIL'), '') AS failed_dimensions FROM w GROUP BY ALL)
SELECT *, CASE WHEN overall = 'VERIFIED' THEN 0 ELSE 1 END AS assurance_exit FROM o""")
def overall_verdict(spark, sf):
    verdicts = AS.overall_verdict(AS.dimension_status(dimension_entries(spark, sf)))
    return verdicts.join(AS.assurance_exit(verdicts, require_verified=True), "store_id")


@query("dataset_signed_binding", "store_id s, name s", f"""WITH {I.LOG_SQL}
SELECT DISTINCT g.store_id, split_part(split_part(g.ref, '/', 2), '@', 1) AS name FROM registered g JOIN refs f ON f.store_id = g.store_id AND f.artifact = g.ref AND f.sha256 = g.hash AND f.side = 'out'
JOIN records r ON r.store_id = f.store_id AND r.line_no = f.line_no JOIN public_keys k ON k.store_id = r.store_id AND k.contributor = r.contributor AND k.key_id = r.key_id
WHERE g.type = 'dataset' AND r.signed AND r.signature_ok AND k.status <> 'revoked'""")
def dataset_signed_binding(spark, sf):
    reg = I.registered(spark, sf).filter("type = 'dataset'")
    headers = reg.select("store_id", F.substring_index(F.substring_index("ref", "/", -1), "@", 1).alias("name"), F.lit("1").alias("version"), I.text("sha256:", F.col("hash")).alias("merkle_root"))
    return AS.dataset_signed_binding(headers, I.log_records(spark, sf), I.public_keys(spark, sf))


@query("provenance_graph", "store_id s, part s, a s, b s", f"""WITH {I.LOG_SQL},
people AS (SELECT store_id, contributor, key_id FROM records UNION SELECT store_id, contributor, NULL FROM registered)
SELECT store_id, 'artifact' AS part, ref AS a, type AS b FROM (SELECT store_id, ref, type FROM registered UNION SELECT store_id, artifact, CASE WHEN regexp_matches(artifact, '^(dataset|model|pipeline)/[^@]+@') THEN split_part(artifact, '/', 1) ELSE 'file' END FROM refs)
UNION ALL SELECT store_id, 'contributor', contributor, coalesce(string_agg(key_id, ',' ORDER BY key_id), '') FROM people GROUP BY ALL
UNION ALL SELECT DISTINCT store_id, 'trust', contributor, ref FROM (SELECT store_id, contributor, ref FROM registered UNION SELECT r.store_id, r.contributor, f.artifact FROM records r JOIN refs f USING (store_id, line_no) WHERE f.side = 'out')
UNION ALL SELECT DISTINCT o.store_id, 'derived', o.artifact, i.artifact FROM refs o JOIN refs i ON o.store_id = i.store_id AND o.line_no = i.line_no AND o.side = 'out' AND i.side = 'in' WHERE o.kind IN ('operation_recorded', 'inference_recorded') AND o.artifact <> i.artifact""")
def provenance_graph(spark, sf):
    g = AS.provenance_graph(I.log_records(spark, sf), I.registered(spark, sf))

    def part(df, name, a, b):
        return df.select("store_id", F.lit(name).alias("part"), F.col(a).alias("a"), b.alias("b"))

    return (part(g["artifacts"], "artifact", "ref", F.col("type"))
            .unionByName(part(g["contributors"], "contributor", "contributor", F.array_join("key_ids", ",")))
            .unionByName(part(g["trusts"], "trust", "contributor", F.col("ref")))
            .unionByName(part(g["derived_from"], "derived", "from", F.col("to"))))


@query("merge_into_scan", "project_id s, total l, score l, verdict s, overall s", f"""WITH {I.DEDUPED_SQL},
rep AS (SELECT 'proj' || (p_partkey // 50) AS project_id, 'VG-DATA-00' || (p_partkey % 5 + 1) AS rule, (['BLOCKER','HIGH','WARN','ODD'])[p_partkey % 4 + 1] AS sev, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'd' || p_partkey % 9 END AS path, p_partkey AS seq FROM part),
one AS (SELECT * FROM rep QUALIFY row_number() OVER (PARTITION BY project_id, rule, path ORDER BY seq) = 1),
merged AS (SELECT project_id, severity FROM deduped UNION ALL SELECT project_id, CASE sev WHEN 'WARN' THEN 'INFO' WHEN 'ODD' THEN 'MEDIUM' ELSE sev END FROM one),
c AS (SELECT project_id, count(*) AS total, 10 * count(*) FILTER (severity = 'BLOCKER') + 5 * count(*) FILTER (severity = 'HIGH') + 2 * count(*) FILTER (severity = 'MEDIUM') + count(*) FILTER (severity = 'LOW') AS p FROM merged GROUP BY ALL),
s AS (SELECT project_id, total, floor(100 - p / (total * 10.0) * 100 + 0.5) AS score, CAST(substr(project_id, 5) AS INTEGER) % 2 = 0 AS bad FROM c)
SELECT project_id, total, score, CASE WHEN bad THEN 'FAIL' WHEN score >= 80 THEN 'PASS' WHEN score >= 50 THEN 'WARN' ELSE 'FAIL' END AS verdict, CASE WHEN bad THEN 'INTEGRITY VIOLATION' ELSE 'VERIFIED' END AS overall FROM s""")
def merge_into_scan(spark, sf):
    k = F.col("p_partkey")
    report = table(spark, sf, "part").select(
        I.text("proj", I.div(k, 50)).alias("project_id"), k.alias("seq"), I.text("VG-DATA-00", k % 5 + 1).alias("rule"), I.pick(["BLOCKER", "HIGH", "WARN", "ODD"], k % 4).alias("severity"),
        F.when(k % 3 != 0, I.text("d", k % 9)).alias("path"), I.text("detail ", k).alias("detail"))
    verdicts = report.select(F.col("project_id").alias("store_id")).distinct().withColumn("overall", F.when(
        F.substr(F.col("store_id"), F.lit(5)).cast("int") % 2 == 0, AS.VIOLATION).otherwise(AS.VERIFIED)).withColumn("failed_dimensions", F.lit("dataset"))
    return AS.merge_into_scan(A.dedupe_findings(I.findings(spark, sf)), report, verdicts)[1]
