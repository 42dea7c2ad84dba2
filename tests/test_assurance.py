import hashlib
import json

import pytest
from pyspark.sql import functions as F

from codeaudit.functions import canonical as C
from codeaudit.functions.signatures import verify_ed25519
from codeaudit.operators import manifests as M
from codeaudit.operators import provenance as P
from codeaudit.operators.merkle import EMPTY_ROOT, merkle_roots

FILES = "store_id string, name string, version string, path string, size long, sha256 string"
KEYS = ["store_id", "name", "version"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_root(files):
    files = sorted(files, key=lambda f: f[0].encode("utf-16-be"))
    level = [hashlib.sha256(b"\0" + json.dumps({"path": p, "sha256": h, "size": s}, ensure_ascii=False, separators=(",", ":")).encode()).digest()
             for p, s, h in files]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else hashlib.sha256(b"\2" + level[i]).digest()
                 for i in range(0, len(level), 2)]
    return "sha256:" + level[0].hex()


def test_merkle_roots_of_many_sizes(spark):
    sizes, rows, want = [1, 2, 3, 4, 5, 7, 4095, 4096, 4097, 8193], [], {}
    for n in sizes:
        files = [(f"dé/{i}.png", i, sha(f"{n}-{i}")) for i in range(n)]
        want[str(n)] = plain_root(files)
        rows += [(str(n), *f) for f in files]
    df = spark.createDataFrame(rows, "ds string, path string, size long, sha256 string")
    got = {r.ds: (r.merkle_root, r.leaves) for r in merkle_roots(df, ["ds"], partitions=5).collect()}
    assert got == {k: (v, int(k)) for k, v in want.items()}


def test_merkle_rejects_repeated_paths(spark):
    df = spark.createDataFrame([("d", "a", 1, sha("x")), ("d", "a", 1, sha("x"))], "ds string, path string, size long, sha256 string")
    row = merkle_roots(df, ["ds"]).first()
    assert row.merkle_root is None and row.duplicate_paths == 1


def test_renames_pair_copies_in_path_order(spark):
    """All removed and added files share one content: the n-th pairs with the n-th."""
    one = sha("copy")
    old = [("s", "d", "1", f"old/{n:04d}", 1, one) for n in range(300)]
    new = [("s", "d", "1", f"new/{n:04d}", 1, one) for n in range(200)]
    diff = M.diff_manifest(spark.createDataFrame(old, FILES), spark.createDataFrame(new, FILES))
    pairs = {(r["from"], r.to) for r in M.pair_renames(diff).collect()}
    assert pairs == {(f"old/{n:04d}", f"new/{n:04d}") for n in range(200)}


def test_dataset_tampering(spark):
    good = [("images/1.png", 3, sha("1")), ("images/2.png", 4, sha("2")), ("labels.json", 5, sha("l"))]
    stores = {
        "clean": good, "modified": [good[0], ("images/2.png", 4, sha("x")), good[2]], "deleted": good[:2],
        "added": good + [("new.txt", 1, sha("n"))], "renamed": [good[0], ("images/3.png", 4, sha("2")), good[2]]}
    expected = spark.createDataFrame([(s, "d", "1", *f) for s in stores for f in good], FILES)
    headers = spark.createDataFrame([(s, "d", "1", 3, 12, plain_root(good)) for s in stores],
                                    "store_id string, name string, version string, file_count long, total_bytes long, merkle_root string")
    listing = spark.createDataFrame([(s, "d", "1", *f) for s, files in stores.items() for f in files], FILES).withColumns(
        {"file_type": F.lit("file"), "read_error": F.lit(None).cast("string")})
    findings, statuses = M.verify_datasets(headers, expected, listing)
    rules = {r.store_id: r.rules for r in findings.groupBy("store_id").agg(F.sort_array(F.collect_list("rule")).alias("rules")).collect()}
    assert rules == {"modified": ["VG-DATA-001"], "deleted": ["VG-DATA-002"], "added": ["VG-DATA-003"], "renamed": ["VG-DATA-004"]}
    assert {r.store_id: r.status for r in statuses.collect()} == {s: "UNANCHORED" if s == "clean" else "FAIL" for s in stores}


def test_empty_dataset_root_and_registration_hash(spark):
    headers = spark.createDataFrame([("s", "e", "1", 0, 0, EMPTY_ROOT)], "store_id string, name string, version string, file_count long, total_bytes long, merkle_root string")
    none = spark.createDataFrame([], FILES)
    assert M.manifest_consistency(headers, none).first().consistent
    files = [("b/ü.txt", 2, sha("b")), ("a.txt", 1, sha("a"))]
    built, _, rejects = M.register_datasets(spark.createDataFrame([("s", "d", "1", *f) for f in files], FILES),
                                            F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("alice"))
    row = built.first()
    body = {
        "schema_version": "1.0", "kind": "dataset_manifest", "name": "d", "version": "1", "created_at": "2024-01-01T00:00:00.000Z",
        "actor": {"contributor": "alice", "key_id": None}, "hash_algorithm": "sha256", "file_count": 2, "total_bytes": 3,
        "merkle_root": plain_root(files), "files": [{"path": p, "size": s, "sha256": h} for p, s, h in sorted(files)],
        "policy": {"extensions": ["*"], "allowSymlinks": False, "maxFileSize": None}, "policy_findings": []}
    assert row.record_hash == C.record_digest(body) and rejects.count() == 0
    small = M.register_datasets(spark.createDataFrame([("s", "d", "1", *f) for f in files], FILES), F.current_timestamp(), F.lit("a"), max_files=1)
    assert small[0].count() == 0 and small[2].count() == 1


@pytest.mark.parametrize("text, want", [
    ('{"b":1.0,"a":[true,null,"é\\n"]}', '{"a":[true,null,"é\\n"],"b":1}'), ('{"n":-0,"m":1e3}', '{"m":1000,"n":0}')])
def test_canonical_text(text, want):
    assert C.dumps(C.parse(text)) == want


@pytest.mark.parametrize("text", ['{"a":1.5}', '{"a":9007199254740992}', '{"a":NaN}', '{"__proto__":1}', '{"a":"\\ud800"}', "[" * 40 + "]" * 40, "{"])
def test_canonical_rejects(text):
    with pytest.raises(C.CanonicalError):
        C.parse(text)


def test_ed25519_vectors():
    """RFC 8032, section 7.1, tests 1 and 2."""
    prefix = bytes.fromhex("302a300506032b6570032100")
    vectors = [
        ("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "",
         "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72",
         "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00")]
    for key, message, signature in vectors:
        der, sig = prefix + bytes.fromhex(key), bytes.fromhex(signature)
        assert verify_ed25519(der, bytes.fromhex(message), sig)
        assert not verify_ed25519(der, bytes.fromhex(message) + b"x", sig)


# ---- provenance tampering: one damaged store per row, all verified in one job ----

def record(n, **more):
    body = {"schema_version": "1.0", "kind": "artifact_registered", "timestamp": f"2024-01-01T00:00:{n:02d}.000Z",
            "actor": {"contributor": "a", "key_id": None}, "inputs": [], "outputs": [{"artifact": f"note/n{n}@1", "sha256": sha(str(n))}],
            "parent_record_hashes": [], "metadata": {}}
    return {**body, **more}


def chained(records):
    previous, lines = None, []
    for r in records:
        r = {**r, "prev_record_hash": previous}
        digest = C.record_digest(r)
        lines.append(C.dumps({**r, "record_hash": digest, "record_id": digest}))
        previous = digest
    return lines, previous


def test_tamper_matrix(spark):
    clean, head = chained([record(n) for n in range(5)])
    first = json.loads(clean[0])["record_hash"]
    later, _ = chained([record(n, parent_record_hashes=["sha256:" + sha("no")] if n == 2 else []) for n in range(4)])
    conflict, _ = chained([record(1), record(2, outputs=[{"artifact": "note/n1@1", "sha256": sha("other")}])])
    early, _ = chained([record(9)])
    parent = json.loads(early[0])["record_hash"]
    early, _ = chained([record(9), record(1, parent_record_hashes=[parent])])
    stores = {
        "clean": (clean, set()), "altered": ([clean[0], clean[1].replace("note/n1", "note/nX"), *clean[2:]], {"VG-PROV-001"}),
        "deleted": ([clean[0], *clean[2:]], {"VG-PROV-001"}), "swapped": ([clean[0], clean[2], clean[1], *clean[3:]], {"VG-PROV-001"}),
        "replayed": ([*clean, clean[4]], {"VG-PROV-001", "VG-PROV-006"}), "blank": ([clean[0], "", *clean[1:]], {"VG-PROV-001"}),
        "orphan": (later, {"VG-PROV-005"}), "conflict": (conflict, {"VG-PROV-010"}), "early": (early, {"VG-PROV-W001"}), "truncated": (clean[:3], {"VG-PROV-008"})}
    log = spark.createDataFrame([(s, n + 1, line) for s, (lines, _) in stores.items() for n, line in enumerate(lines)], "store_id string, line_no long, raw string")
    keys = spark.createDataFrame([], "store_id string, contributor string, key_id string, public_key_der_b64 string, operations array<string>, status string")
    manifests = spark.createDataFrame([], "store_id string, ref string, type string, hash string, contributor string")
    anchors = spark.createDataFrame([("truncated", head), ("clean", head)], "store_id string, expected_head string")
    findings, status = P.verify_provenance(log, keys, manifests, anchors)
    got = {}
    for r in findings.collect():
        got.setdefault(r.store_id, set()).add(r.rule)
    assert {s: got[s] - {"VG-PROV-009"} for s in stores} == {s: rules for s, (_, rules) in stores.items()}
    state = {r.store_id: (r.status, r.anchored) for r in status.collect()}
    assert state["clean"] == ("UNSIGNED", True) and state["truncated"] == ("FAIL", False) and state["early"] == ("UNSIGNED", None)
    assert first


def test_build_records_makes_a_valid_chain(spark):
    rows = [(s, n, json.dumps(record(n))) for s in ("s1", "s2") for n in range(6)]
    built = P.build_records(spark.createDataFrame(rows, "store_id string, seq long, body string"))
    parsed = P.parse_log(built.select("store_id", "line_no", "raw"))
    assert parsed.filter("problem IS NOT NULL").count() == 0 and P.verify_chain(parsed).count() == 0
    assert P.provenance_summary(parsed).filter("record_count = 6").count() == 2


def test_chain_over_buckets(spark, monkeypatch):
    """Runs of lines are windowed apart and still linked across their borders."""
    monkeypatch.setattr(P, "LINES_PER_BUCKET", 7)
    lines, _ = chained([record(n % 60) for n in range(40)])
    df = spark.createDataFrame([("s", n + 1, line) for n, line in enumerate(lines) if n != 20], "store_id string, line_no long, raw string")
    df = df.withColumn("line_no", F.when(F.col("line_no") > 20, F.col("line_no") - 1).otherwise(F.col("line_no")))
    assert [r.line_no for r in P.verify_chain(P.parse_log(df)).collect()] == [21]


# ---- signatures: signed chains, verified with the registry --------------------

def keypair(seed):
    """(secret scalar, prefix, DER of the public key) after RFC 8032."""
    from codeaudit.functions import signatures as E

    digest = hashlib.sha512(seed).digest()
    scalar = (int.from_bytes(digest[:32], "little") & ((1 << 254) - 8)) | (1 << 254)
    return scalar, digest[32:], E.SPKI_PREFIX + packed(E._times(scalar, E.BASE))


def packed(point):
    from codeaudit.functions.signatures import P as prime

    z = pow(point[2], prime - 2, prime)
    x, y = point[0] * z % prime, point[1] * z % prime
    return (y | (x & 1) << 255).to_bytes(32, "little")


def sign(key, text):
    import base64

    from codeaudit.functions import signatures as E

    scalar, prefix, der = key
    r = int.from_bytes(hashlib.sha512(prefix + text.encode()).digest(), "little") % E.ORDER
    point = packed(E._times(r, E.BASE))
    k = int.from_bytes(hashlib.sha512(point + der[12:] + text.encode()).digest(), "little") % E.ORDER
    return base64.b64encode(point + ((r + k * scalar) % E.ORDER).to_bytes(32, "little")).decode()


def test_signed_stores(spark):
    import base64

    key, other = keypair(b"one" * 11), keypair(b"two" * 11)
    der = base64.b64encode(key[2]).decode()
    key_id = hashlib.sha256(key[2]).hexdigest()[:32]
    actor = {"contributor": "a", "key_id": key_id}

    def store(signer=key, operation="train", who=actor):
        first = record(0, kind="contributor_registered", actor=actor, outputs=[], contributor="a", key_id=key_id,
                       operations=["train"], public_key_der_b64=der)
        second = record(1, kind="operation_recorded", actor=who, operation=operation, inputs=[{"artifact": "note/x@1", "sha256": sha("x")}])
        lines = [json.loads(line) for line in chained([first, second])[0]]
        for n, line in enumerate(lines):
            line["signature"] = sign(key if n == 0 else signer, line["record_hash"])
        return [C.dumps(line) for line in lines]

    stores = {
        "good": (store(), "active", set()), "forged": (store(signer=other), "active", {"VG-PROV-002"}),
        "unknown": (store(who={"contributor": "a", "key_id": "zz"}), "active", {"VG-PROV-003"}),
        "revoked": (store(), "revoked", {"VG-PROV-004"}), "denied": (store(operation="infer"), "active", {"VG-PROV-004"})}
    log = spark.createDataFrame([(s, n + 1, line) for s, (lines, _, _) in stores.items() for n, line in enumerate(lines)], "store_id string, line_no long, raw string")
    keys = spark.createDataFrame([(s, "a", key_id, der, ["train"], state) for s, (_, state, _) in stores.items()],
                                 "store_id string, contributor string, key_id string, public_key_der_b64 string, operations array<string>, status string")
    manifests = spark.createDataFrame([], "store_id string, ref string, type string, hash string, contributor string")
    heads = spark.createDataFrame([(s, json.loads(lines[-1])["record_hash"]) for s, (lines, _, _) in stores.items()], "store_id string, expected_head string")
    findings, status = P.verify_provenance(log, keys, manifests, heads)
    got = {s: set() for s in stores}
    for r in findings.collect():
        got[r.store_id].add(r.rule)
    assert got == {s: rules for s, (_, _, rules) in stores.items()}
    assert {r.store_id: r.status for r in status.collect()} == {s: "PASS" if s == "good" else "FAIL" for s in stores}
