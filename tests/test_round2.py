"""Faults of the first round, each with the case that showed it."""

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from codeaudit.functions import canonical as C
from codeaudit.functions.canonical import json_string
from codeaudit.operators import assurance as A
from codeaudit.operators import discovery, identity, inference, scoring
from codeaudit.operators import manifests as M
from codeaudit.operators import models as MO
from codeaudit.operators.dependency_audit import audit_dependencies
from codeaudit.operators.merkle import merkle_roots
from codeaudit.plans.verify import verify_all
from codeaudit.session import checkpoint
from codeaudit.sources.dependencies import read_dependency_manifests
from test_assurance import chained, keypair, record, sha, sign

def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def test_control_characters_are_written_as_in_canonical_text(spark):
    texts = ["a" + chr(c) + chr(c) + "\\" + chr(c) for c in range(32)] + ["\\u001F", "\\\\u001F\x1f", "\x7f é🙂", '"']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", json_string(F.col("t")).alias("j")).collect()
    assert [r.j for r in rows] == [C.dumps(r.t) for r in rows]


def test_ignore_table_per_project(spark):
    files = spark.createDataFrame([(p, f) for p in ("a", "b", "c") for f in ("gen/x.js", "src/y.gen.ts", "src/z.ts")], "project_id string, path string")
    ignored = spark.createDataFrame([("a", "gen/"), ("a", "# note"), ("b", "src/*.gen.ts"), ("b", "a(*"), ("b", "")], "project_id string, pattern string")
    got = {(r.project_id, r.path) for r in discovery.filter_ignored(files, None, ignored).collect()}
    assert got == {("a", "src/y.gen.ts"), ("a", "src/z.ts"), ("b", "gen/x.js"), ("b", "src/z.ts"),
                   *[("c", f) for f in ("gen/x.js", "src/y.gen.ts", "src/z.ts")]}
    assert [tuple(r) for r in discovery.rejected_ignore_patterns(ignored).collect()] == [("b", "a(*")]


def test_dependency_findings_of_one_line_keep_the_first_listed(spark):
    text = '{"dependencies":{"zeta":"1.0.0","alpha":"1.0.0"}}'
    files = spark.createDataFrame([("p", "package.json", text)], "project_id string, path string, content string")
    advisories = spark.createDataFrame(
        [("npm", n, i, ["*"], f"CVE-{n}", "HIGH", "bad", "2.0.0") for i, n in enumerate(("alpha", "zeta"))],
        "ecosystem string, name string, ord int, affected array<string>, cve string, severity string, summary string, fixed string")
    found = audit_dependencies(read_dependency_manifests(files), advisories)
    for order in ("rule", F.col("rule").desc()):
        assert [r.rule for r in scoring.dedupe_findings(found.orderBy(order).coalesce(1)).collect()] == ["CVE-zeta"]


def test_files_listed_twice_fail_their_own_store_only(spark):
    files = spark.createDataFrame([("s", "a", "1"), ("s", "a", "1"), ("s", "b", "1"), ("s", "b", "2")], "store_id string, path string, sha256 string")
    got = {r.path: (r.sha256, r.read_error) for r in identity.one_row_per_file(files).collect()}
    assert got == {"a": ("1", None), "b": (None, "listed with different contents")}
    specs = spark.createDataFrame([(s, "p", "1", "a", {"path": "a", "sha256": "1"}, None, [], None, "{}", "python", "3", []) for s in ("s", "t")],
                                  "store_id string, name string, version string, contributor string, preprocess_config struct<path:string,sha256:string>, "
                                  "git_commit string, code_files array<struct<path:string,sha256:string>>, dependency_lock struct<path:string,sha256:string>, "
                                  "parameters string, language string, runtime_version string, libraries array<struct<name:string,version:string>>")
    setups = checkpoint(identity.register_identities(specs, now()))  # manifests are read from storage
    twice = spark.createDataFrame([("s", "a", "1"), ("s", "a", "2"), ("t", "a", "1"), ("t", "a", "1")], "store_id string, path string, sha256 string")
    assert {r.store_id: r.status for r in identity.verify_identities(setups, twice)[1].collect()} == {"s": "FAIL", "t": "PASS"}


def test_merkle_rounds_follow_the_longest_list(spark):
    df = spark.createDataFrame([("d", "a", 1, sha("x"))], "ds string, path string, size long, sha256 string")
    assert merkle_roots(df, ["ds"]).first().leaves == 1 and merkle_roots(df.limit(0), ["ds"]).count() == 0


# ---- whole verification, from raw signed logs ---------------------------------

KEY = keypair(b"one" * 11)
DER = base64.b64encode(KEY[2]).decode()
KEY_ID = hashlib.sha256(KEY[2]).hexdigest()[:32]
DATA = [("images/1.png", 3, sha("1")), ("labels.json", 5, sha("l"))]
HEAD = b"\x08\x01model"


@pytest.fixture(scope="module")
def verified(spark):
    """One store per case; all are verified in one job."""
    cases = ["good", "unanchored", "unsigned", "wrong root", "forged", "moved", "gone", "metadata", "unreadable", "tampered output"]
    as_df = spark.createDataFrame
    file_columns = "store_id string, name string, version string, path string, size long, sha256 string"
    headers, entries, _ = M.register_datasets(as_df([(c, "d", "1", *f) for c in cases for f in DATA], file_columns), now(), F.lit("a"))
    models, rejects = MO.register_models(as_df(
        [(c, "m", "1", "onnx", "m.onnx", len(HEAD), hashlib.sha256(HEAD).hexdigest(), HEAD, "a", None, "{}") for c in cases],
        "store_id string, id string, version string, format string, path string, size long, sha256 string, head binary, contributor string, "
        "key_id string, metadata string"), now())
    assert rejects.count() == 0
    config = {"path": "prep.json", "sha256": sha("prep")}
    models, headers, entries = checkpoint(models), checkpoint(headers), checkpoint(entries)
    setups = identity.register_identities(as_df(
        [(c, "p", "1", "a", config, None, [], None, "{}", "python", "3", []) for c in cases],
        "store_id string, name string, version string, contributor string, preprocess_config struct<path:string,sha256:string>, git_commit string, "
        "code_files array<struct<path:string,sha256:string>>, dependency_lock struct<path:string,sha256:string>, parameters string, "
        "language string, runtime_version string, libraries array<struct<name:string,version:string>>"), now())
    setups = checkpoint(setups)
    root = headers.first().merkle_root.removeprefix("sha256:")
    setup = setups.first().pipeline_id.removeprefix("sha256:")
    model = hashlib.sha256(HEAD).hexdigest()
    actor = {"contributor": "a", "key_id": KEY_ID}

    def log(case):
        registered = {"artifact": "dataset/d@1", "sha256": sha("other") if case == "wrong root" else root}
        lines = [
            record(0, kind="contributor_registered", actor=actor, outputs=[], contributor="a", key_id=KEY_ID,
                   operations=["train", "infer"], public_key_der_b64=DER),
            record(1, actor=actor, outputs=[registered]),
            record(2, actor=actor, outputs=[{"artifact": "model/m@1", "sha256": model}]),
            record(3, actor=actor, outputs=[{"artifact": "pipeline/p@1", "sha256": setup}]),
            record(4, kind="inference_recorded", actor=actor, inputs=[
                {"artifact": "model/m@1", "sha256": model}, {"artifact": "pipeline/p@1", "sha256": setup}, {"artifact": "in.txt", "sha256": sha("in")}],
                outputs=[{"artifact": "out.txt", "sha256": sha("out")}])]
        done = [json.loads(line) for line in chained(lines)[0]]
        for n, line in enumerate(done):
            if not (case == "unsigned" and n == 1):
                line["signature"] = sign(keypair(b"two" * 11) if case == "forged" and n == 1 else KEY, line["record_hash"])
        return [C.dumps(line) for line in done]

    logs = {c: log(c) for c in cases}
    lines = as_df([(c, n + 1, line) for c in cases for n, line in enumerate(logs[c])], "store_id string, line_no long, raw string")
    keys = as_df([(c, "a", KEY_ID, DER, ["train", "infer"], "active") for c in cases],
                 "store_id string, contributor string, key_id string, public_key_der_b64 string, operations array<string>, status string")
    anchors = as_df([(c, json.loads(logs[c][-1])["record_hash"]) for c in cases if c != "unanchored"], "store_id string, expected_head string")
    files = []
    for c in cases:
        base = {"moved": "deep/below/", "gone": None}.get(c, "data/")
        files += [(c, base + p, s, h, b"") for p, s, h in DATA] if base is not None else []
        files += [(c, "m.onnx", len(HEAD), model, HEAD), (c, "prep.json", 4, sha("prep"), b""), (c, "in.txt", 2, sha("in"), b""),
                  (c, "out.txt", 3, sha("changed" if c == "tampered output" else "out"), b"")]
    stored = as_df(files, "store_id string, path string, size long, sha256 string, head binary")
    unreadable = as_df([("unreadable", "e", "1", "not JSON")], "store_id string, name string, version string, error string")
    metadata = as_df([("metadata", "bad version")], "store_id string, error string")
    findings, verdicts = verify_all(lines, keys, headers, entries, None, models, setups, stored, anchors,
                                    unreadable=unreadable, metadata_errors=metadata)
    rules = {c: set() for c in cases}
    for r in findings.collect():
        rules[r.store_id].add(r.rule)
    return rules, {r.store_id: r for r in verdicts.collect()}


def test_a_raw_signed_log_reaches_every_verdict(verified):
    rules, verdicts = verified
    assert verdicts["good"].asDict() == {"store_id": "good", **dict.fromkeys(A.DIMENSIONS, "PASS"), "overall": A.VERIFIED, "failed_dimensions": ""}, rules["good"]
    assert rules["good"] == set()
    overall = {c: v.overall for c, v in verdicts.items()}
    assert overall == {"good": A.VERIFIED, "moved": A.VERIFIED, "unanchored": A.INCOMPLETE, "unsigned": A.INCOMPLETE,
                       **dict.fromkeys(["wrong root", "forged", "gone", "metadata", "unreadable", "tampered output"], A.VIOLATION)}


def test_each_fault_has_its_finding(verified):
    rules, verdicts = verified
    assert "VG-DATA-002" in rules["gone"] and verdicts["gone"].dataset == "FAIL"
    assert "VG-DATA-007" in rules["unreadable"] and verdicts["unreadable"].dataset == "FAIL"
    assert "VG-PROV-001" in rules["metadata"] and verdicts["metadata"].provenance == "FAIL"
    assert "VG-PROV-002" in rules["forged"] and verdicts["forged"].dataset == "UNANCHORED"
    assert "VG-PROV-009" in rules["unsigned"] and verdicts["unsigned"].dataset == "UNANCHORED"
    assert "VG-OUT-001" in rules["tampered output"] and verdicts["tampered output"].output == "FAIL"


def test_more_rules_than_bits_of_one_long(spark, monkeypatch):
    from codeaudit.operators import scan_rules as SR

    files = spark.createDataFrame([("p", "src/a.js", "eval(x)\nif (a == b) {}\ncrypto.createHash('md5')\nobj['__proto__'] = x;\n")],
                                  "project_id string, path string, content string")
    whole = sorted(map(tuple, SR.scan_rules(files).select("line", "rule").collect()))
    assert len(whole) >= 4
    for bits in (12, 20, 33):
        monkeypatch.setattr(SR, "RULES_PER_MASK", bits)
        monkeypatch.setattr(SR, "_built", {})
        assert sorted(map(tuple, SR.scan_rules(files).select("line", "rule").collect())) == whole


def test_registration_has_no_limit_unless_asked_for(spark):
    files = spark.range(3000).selectExpr("'s' AS store_id", "'d' AS name", "'1' AS version", "concat('f', id) AS path", "id AS size", "sha2(string(id), 256) AS sha256")
    one = spark.createDataFrame([("t", "d", "1", "a", 1, None)], "store_id string, name string, version string, path string, size long, sha256 string")
    headers, _, rejects = M.register_datasets(files.unionByName(one), now(), F.lit("a"))
    got = {r.store_id: (r.file_count, r.record_hash) for r in headers.collect()}
    names = sorted((f"f{i}" for i in range(3000)), key=lambda p: p.encode("utf-16-be"))
    entries = [{"path": p, "sha256": sha(p[1:]), "size": int(p[1:])} for p in names]
    body = {"actor": {"contributor": "a", "key_id": None}, "created_at": "2024-01-01T00:00:00.000Z", "file_count": 3000, "files": entries,
            "hash_algorithm": "sha256", "kind": "dataset_manifest", "merkle_root": headers.filter("store_id = 's'").first().merkle_root, "name": "d",
            "policy": {"allowSymlinks": False, "extensions": ["*"], "maxFileSize": None}, "policy_findings": [], "schema_version": "1.0",
            "total_bytes": sum(range(3000)), "version": "1"}
    assert got == {"s": (3000, C.record_digest(body)), "t": (1, None)} and rejects.count() == 0
    limited = M.register_datasets(files, now(), F.lit("a"), max_files=2999)
    assert limited[0].count() == 0 and "exceeds the limit of 2999" in limited[2].first().error


def test_fixes_see_the_text_as_changed_so_far(spark):
    from codeaudit.operators.patches import fix_files

    app = "import os\n\napp.run(debug=True, host='0.0.0.0')\nif x == None:\n    pass\n"
    files = spark.createDataFrame([("p", "a.py", app), ("p", "b.js", "if (a == b && c == d) { go(); }\n"), ("p", "clean.py", "x = 1\n")],
                                  "project_id string, path string, content string")
    rows = [("p", "a.py", 3, "B201", "HIGH", "A Flask app appears to be run with debug=True", 1),
            ("p", "a.py", 3, "B104", "MEDIUM", "Possible binding to all interfaces 0.0.0.0", 2),
            ("p", "a.py", 3, "deployguard-production-debug", "HIGH", "debug mode", 3),
            ("p", "a.py", 4, "E711", "LOW", "Comparison to None", 4),
            ("p", "b.js", 1, "loose-equality", "LOW", "Loose equality (==) used", 5),
            ("p", "a.py", 5, "no-such-rule", "LOW", "nothing known", 6)]
    texts, outcomes = fix_files(spark.createDataFrame(
        rows, "project_id string, file string, line int, rule string, severity string, message string, seq long"), files)
    got = {r.path: r.content for r in texts.collect()}
    assert "debug=False" in got["a.py"] and "0.0.0.0" not in got["a.py"] and "is None" in got["a.py"], got["a.py"]
    assert "===" in got["b.js"] and got["clean.py"] == "x = 1\n"
    said = {r.rule: r.outcome for r in outcomes.collect()}
    assert said["E711"] == said["loose-equality"] == "applied" and said["no-such-rule"] == "unresolved"
    assert said["deployguard-production-debug"] == "settled"
    assert {said["B201"], said["B104"]} <= {"applied", "settled"}
    none, nothing = fix_files(spark.createDataFrame(
        rows, "project_id string, file string, line int, rule string, severity string, message string, seq long").limit(0), files)
    assert none.count() == 3 and nothing.count() == 0


def test_byte_limits_of_texts(spark):
    rows = [("s", "metadata", 4096), ("t", "metadata", 4097), ("s", "manifest", 1 << 25), ("t", "manifest", (1 << 25) + 1),
            ("t", "manifest", 5), ("s", "log", 1 << 29), ("t", "log", (1 << 29) + 1), ("t", "other", 1 << 40)]
    texts = spark.createDataFrame(rows, "store_id string, kind string, size long")
    got = {tuple(r) for r in M.check_text_limits(texts).collect()}
    assert got == {("t", "maxMetadataBytes", 4097, 4096), ("t", "maxManifestBytes", (1 << 25) + 1, 1 << 25), ("t", "maxLogBytes", (1 << 29) + 1, 1 << 29)}
    assert M.check_text_limits(texts, limits={"maxLogBytes": 1}).filter("limit = 'maxLogBytes'").count() == 2


def test_datasets_meet_only_files_below_their_own_folder(spark):
    """Two datasets of one store under like-named folders, one at the root of another store; a file counts where its base is."""
    from codeaudit.operators.assurance import verified_datasets
    from codeaudit.operators.merkle import merkle_roots

    keys = ["store_id", "name", "version"]
    listed = [("s", "a", "1", "x.csv", 1, "a" * 64), ("s", "a", "1", "sub/y.csv", 2, "b" * 64), ("s", "b", "1", "x.csv", 1, "a" * 64),
              ("s", "b", "1", "z.csv", 3, "c" * 64), ("t", "c", "1", "k/x.csv", 1, "d" * 64)]
    files = [("s", "data/a/x.csv", 1, "a" * 64), ("s", "data/a/sub/y.csv", 2, "b" * 64), ("s", "data/ab/x.csv", 1, "a" * 64), ("s", "data/ab/z.csv", 3, "f" * 64),
             ("t", "k/x.csv", 1, "d" * 64), ("t", "k/extra.csv", 9, "e" * 64)]
    columns = "store_id string, name string, version string, path string, size long, sha256 string"
    manifest = spark.createDataFrame(listed, columns)
    headers = manifest.groupBy(*keys).agg(F.count("*").alias("file_count"), F.sum("size").alias("total_bytes")).join(
        merkle_roots(manifest, keys).select(*keys, "merkle_root"), keys)
    found, statuses = verified_datasets(headers, manifest, None, spark.createDataFrame(files, "store_id string, path string, size long, sha256 string"))
    assert {(r.store_id, r.name, r.path) for r in found.collect()} == {("s", "b", "z.csv"), ("t", "c", "k/extra.csv")}
    assert {(r.name, r.status) for r in statuses.collect() if r.name == "a"} == {("a", "UNANCHORED")}
