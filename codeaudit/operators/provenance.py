"""Verification of hash-chained provenance logs; all stores in one job."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit import schemas as S
from codeaudit.functions import text as X
from codeaudit.functions.canonical import chain_parts, inspect_record, metadata_error
from codeaudit.functions.refs import (
    BASE64, RECORD_HASH, SHA256_HEX, is_ref, ref_type, strip_hash,
)
from codeaudit.operators.ordered import bucketed_lag, cap_per_rule
from codeaudit.operators.graph import reachable
from codeaudit.session import checkpoint

# --- Fixed values -------------------------------------------------------------
RECORD_KINDS = ["contributor_registered", "artifact_registered", "operation_recorded", "inference_recorded"]
OPERATIONS = ["curate_dataset", "preprocess", "train", "export_model", "infer"]
ENVELOPE_KEYS = [
    "schema_version", "record_id", "kind", "timestamp", "actor", "inputs", "outputs",
    "parent_record_hashes", "prev_record_hash", "metadata", "record_hash", "signature",
]
KIND_KEYS = {
    "contributor_registered": ["contributor", "key_id", "operations", "public_key_der_b64"],
    "artifact_registered": [], "operation_recorded": ["operation"], "inference_recorded": [],
}
PROV_SEVERITY = {
    "VG-PROV-001": "BLOCKER", "VG-PROV-002": "BLOCKER", "VG-PROV-003": "BLOCKER",
    "VG-PROV-004": "BLOCKER", "VG-PROV-005": "BLOCKER", "VG-PROV-006": "BLOCKER",
    "VG-PROV-007": "BLOCKER", "VG-PROV-008": "BLOCKER", "VG-PROV-009": "HIGH",
    "VG-PROV-010": "BLOCKER", "VG-PROV-011": "BLOCKER",
}
MAX_REFS = 4096
MAX_ARTIFACT_LENGTH = 512
MAX_FINDINGS_PER_RULE = 100
# --- end of fixed values ------------------------------------------------------
LINES_PER_BUCKET = 1 << 16


def _finding(rule: str | Column, message: Column, line: Column | None = None) -> list[Column]:
    r = F.lit(rule) if isinstance(rule, str) else rule
    return [
        F.col("store_id"),
        F.when(r.contains("-W"), "warnings").otherwise("findings").alias("list"),
        r.alias("rule"),
        F.coalesce(X.literal_map(PROV_SEVERITY)[r], F.when(r.contains("-W"), "WARN").otherwise("BLOCKER"))
        .alias("severity"),
        (F.lit(None).cast("long") if line is None else line.cast("long")).alias("line_no"),
        message.alias("message"),
    ]


def _line_text(template: str, *args: Column) -> Column:
    return F.format_string("line %d " + template, F.col("line_no"), *args)


# ---- parsing and validation --------------------------------------------------

def record_error(r: Column, keys: Column, depth: Column, size: Column) -> Column:
    """First schema violation of a parsed record, or null."""
    def bad_refs(name: str) -> Column:
        items = r[name]
        return (
            items.isNull() | (F.size(items) > MAX_REFS)
            | F.exists(items, lambda e: F.coalesce(
                (F.length(e["artifact"]) == 0) | (F.length(e["artifact"]) > MAX_ARTIFACT_LENGTH)
                | e["artifact"].rlike(r"[\x00-\x1f\x7f]") | ~e["sha256"].rlike(SHA256_HEX), F.lit(True))))

    def hash_like(c: Column) -> Column:
        return F.coalesce(c.rlike(RECORD_HASH), F.lit(False))

    major = F.substring_index(r["schema_version"], ".", 1)
    known = F.lit(False)
    for kind, extra in KIND_KEYS.items():
        allowed = F.array(*[F.lit(k) for k in ENVELOPE_KEYS + extra])
        known = F.when(r["kind"] == kind, F.size(F.array_except(keys, allowed)) == 0).otherwise(known)
    contributor = r["actor"]["contributor"]
    actor_key = r["actor"]["key_id"]
    refs = F.transform(r["inputs"], lambda e: ref_type(e["artifact"]))
    kind = r["kind"]
    n_in, n_out = F.size(r["inputs"]), F.size(r["outputs"])
    op_ok = r["operation"].isin(OPERATIONS)
    ops = r["operations"]
    common = (
        F.when(r.isNull() | r["schema_version"].isNull(), "schema_version must be a string")
        .when(~major.rlike(r"^\d+$"), "unrecognized schema_version")
        .when(major != "1", "unsupported schema major version")
        .when(~F.coalesce(kind.isin(RECORD_KINDS), F.lit(False)), "kind is not a record kind")
        .when(~known, "unknown field")
        .when(~F.coalesce(r["timestamp"].rlike(X.TIMESTAMP_PATTERN), F.lit(False)),
              "timestamp must be an RFC 3339 UTC timestamp with milliseconds")
        .when(F.coalesce((X.js_trim(contributor) == "") | (F.length(contributor) > 128), F.lit(True)),
              "actor.contributor must be a non-empty string of at most 128 characters")
        .when(F.coalesce((actor_key == "") | (F.length(actor_key) > 128), F.lit(False)),
              "actor.key_id must be null or a non-empty string of at most 128 characters")
        .when(bad_refs("inputs"), "inputs must be an array of references")
        .when(bad_refs("outputs"), "outputs must be an array of references")
        .when(r["parent_record_hashes"].isNull() | (F.size(r["parent_record_hashes"]) > MAX_REFS)
              | F.exists(r["parent_record_hashes"], lambda h: ~hash_like(h)),
              "parent_record_hashes must be sha256: hex digests")
        .when(r["prev_record_hash"].isNotNull() & ~hash_like(r["prev_record_hash"]),
              "prev_record_hash must be null or a sha256: hex digest")
        .when(metadata_error(depth, size).isNotNull(), metadata_error(depth, size))
        .when(~hash_like(r["record_hash"]), "record_hash must be a sha256: hex digest")
        .when(~F.coalesce(r["record_id"] == r["record_hash"], F.lit(False)), "record_id must equal record_hash")
        .when(r["signature"].isNotNull() & ~r["signature"].rlike(BASE64), "signature must be base64 or null")
        .when(r["signature"].isNotNull() & actor_key.isNull(), "signed records must carry actor.key_id"))
    contributor_rules = (
        F.when((n_in != 0) | (n_out != 0), "contributor_registered must have empty inputs and outputs")
        .when(~F.coalesce(r["contributor"] == contributor, F.lit(False)), "contributor must match actor.contributor")
        .when(~F.coalesce(r["key_id"] == actor_key, F.lit(False)), "key_id must match actor.key_id")
        .when(ops.isNull(), "operations must be an array")
        .when(F.exists(ops, lambda o: ~o.isin(OPERATIONS)), "unsupported operation")
        .when(F.size(F.array_distinct(ops)) != F.size(ops), "duplicate operation")
        .when(~F.coalesce(r["public_key_der_b64"].rlike(BASE64), F.lit(False)), "public_key_der_b64 must be base64")
        .when(F.coalesce(
            (F.length(F.unbase64(r["public_key_der_b64"])) != 44)
            | ~F.hex(F.unbase64(r["public_key_der_b64"])).startswith("302A300506032B6570032100"), F.lit(True)),
            "public_key_der_b64 must decode to a valid ed25519 SPKI key"))
    inference_rules = (
        F.when(n_in != 3, "inference_recorded must have exactly 3 inputs (input, model, pipeline)")
        .when(n_out != 1, "inference_recorded must have exactly 1 output")
        .when((F.size(F.filter(refs, lambda t: t == "model")) != 1)
              | (F.size(F.filter(refs, lambda t: t == "pipeline")) != 1),
              "inference_recorded inputs must be one input, one model ref and one pipeline ref"))
    by_kind = (
        F.when(kind == "contributor_registered", contributor_rules)
        .when(kind == "artifact_registered",
              F.when(n_in != 0, "artifact_registered must have empty inputs")
              .when(n_out < 1, "artifact_registered requires at least one output"))
        .when(kind == "operation_recorded",
              F.when(~F.coalesce(op_ok, F.lit(False)), "operation is not supported")
              .when(n_in < 1, "operation_recorded requires at least one input")
              .when(n_out < 1, "operation_recorded requires at least one output"))
        .otherwise(inference_rules))
    return F.coalesce(common, by_kind)


def parse_log(log: DataFrame) -> DataFrame:
    """(store_id, line_no, raw) to parsed lines: the record, or why the line is malformed."""
    blank = X.js_trim(F.col("raw")) == ""
    mode = F.get_json_object("raw", "$.metadata.output_mode")
    parsed = (
        log.withColumn("_i", inspect_record(F.col("raw")))
        .withColumn("record", F.from_json("raw", S.PROV_RECORD)))
    i = F.col("_i")
    invalid = record_error(F.col("record"), i["keys"], i["metadata_depth"], i["metadata_bytes"])
    bad_mode = (F.col("record.kind") == "inference_recorded") & mode.isNotNull() & ~mode.isin("raw", "canonical_json")
    problem = (
        F.when(blank, "is empty")
        .when(i["error"].isNotNull(), F.concat(F.lit("is not valid canonical JSON: "), i["error"]))
        .when(invalid.isNotNull(), F.concat(F.lit("is invalid: "), invalid))
        .when(bad_mode, 'is invalid: metadata.output_mode must be "raw" or "canonical_json"')
        .when(i["hash"] != F.col("record.record_hash"), "is invalid: record_hash mismatch"))
    return parsed.withColumn("problem", problem).select(
        "store_id", "line_no", "problem", F.when(F.col("problem").isNull(), F.col("record")).alias("record"))


def valid_records(parsed: DataFrame) -> DataFrame:
    """Valid records, flattened: the input of every check below."""
    return parsed.filter(F.col("problem").isNull()).select("store_id", "line_no", "record.*")


# ---- checks ------------------------------------------------------------------

def chain_lag(lines: DataFrame, valid: Column, own: str = "record_hash") -> DataFrame:
    """`prev_line`: hash and validity of the line before, null at the first line.

    Line numbers are dense, so runs of 65 536 lines are windows of their own and
    one store's log spreads over as many tasks as it has runs.
    """
    value = F.struct(F.col(own).alias("hash"), F.coalesce(valid, F.lit(False)).alias("valid"))
    bucket = F.floor(F.col("line_no") / LINES_PER_BUCKET)
    return bucketed_lag(lines, ["store_id"], bucket, ["line_no"], value, "prev_line")


def verify_chain(parsed: DataFrame) -> DataFrame:
    """Malformed lines, and valid ones whose `prev_record_hash` is not the hash before.

    Right after a malformed line the link is not checked; the first record must
    have no predecessor.
    """
    flat = parsed.select(
        "store_id", "line_no", "problem", F.col("record.record_hash").alias("record_hash"),
        F.col("record.prev_record_hash").alias("prev_record_hash"))
    linked = chain_lag(flat, F.col("problem").isNull())
    previous = F.col("prev_line")
    checkable = previous.isNull() | previous["valid"]
    broken = F.col("problem").isNull() & checkable & ~F.col("prev_record_hash").eqNullSafe(previous["hash"])
    message = F.when(F.col("problem").isNotNull(), _line_text("%s", F.col("problem"))).otherwise(
        _line_text("prev_record_hash does not match the previous record"))
    return linked.filter(F.col("problem").isNotNull() | broken).select(
        *_finding("VG-PROV-001", message, F.col("line_no")))


def first_lines(records: DataFrame) -> DataFrame:
    """First occurrence of every record hash: (store_id, record_hash, first_line, first_timestamp)."""
    return records.groupBy("store_id", "record_hash").agg(
        F.min("line_no").alias("first_line"), F.min_by("timestamp", "line_no").alias("first_timestamp"))


def check_replay(records: DataFrame) -> DataFrame:
    """Every occurrence of a record hash but the first."""
    repeated = records.groupBy("store_id", "record_hash").agg(
        F.min("line_no").alias("first_line"), F.count("*").alias("_n")).filter("_n > 1")
    hits = records.join(repeated, ["store_id", "record_hash"]).filter(F.col("line_no") != F.col("first_line"))
    return hits.select(*_finding("VG-PROV-006", F.format_string(
        "record %s appears more than once (replay)", F.col("record_hash")), F.col("line_no")))


def _parents(records: DataFrame) -> DataFrame:
    links = records.select(
        "store_id", "line_no", "record_hash", "timestamp", F.explode("parent_record_hashes").alias("parent"))
    first = first_lines(records).select(
        "store_id", F.col("record_hash").alias("parent"), "first_line", "first_timestamp")
    return links.join(first, ["store_id", "parent"], "left")


def check_parents(records: DataFrame) -> DataFrame:
    """Self references, missing parents and parents that come later."""
    links = _parents(records)
    rule = (
        F.when(F.col("parent") == F.col("record_hash"), "VG-PROV-007")
        .when(F.col("first_line").isNull(), "VG-PROV-005")
        .when(F.col("first_line") > F.col("line_no"), "VG-PROV-007"))
    message = (
        F.when(F.col("parent") == F.col("record_hash"), _line_text("is its own parent"))
        .when(F.col("first_line").isNull(), _line_text("references a missing parent"))
        .otherwise(_line_text("references a later record as parent")))
    return links.withColumn("_rule", rule).filter(F.col("_rule").isNotNull()).select(
        *_finding(F.col("_rule"), message, F.col("line_no")))


def check_parent_time(records: DataFrame) -> DataFrame:
    """Records older than the latest of their earlier parents."""
    latest = _parents(records).filter(F.col("first_line") < F.col("line_no")).groupBy(
        "store_id", "line_no", "timestamp").agg(F.max("first_timestamp").alias("_latest"))
    return latest.filter(F.col("timestamp") < F.col("_latest")).select(*_finding(
        "VG-PROV-W001", _line_text("timestamp is earlier than a parent timestamp"), F.col("line_no")))


def check_signers(records: DataFrame, keys: DataFrame) -> DataFrame:
    """Trust of every signed record, first failing test only; `signature_ok` is a column.

    Both lookups are keyed by contributor and key; when one contributor signs most
    of a log Spark splits that join key at run time.
    """
    registry = keys.select(
        "store_id", F.col("contributor").alias("_who"), F.col("key_id").alias("_key"),
        F.struct("status", "operations", "public_key_der_b64").alias("_reg"))
    pins = records.filter(F.col("kind") == "contributor_registered").select(
        "store_id", F.col("actor.contributor").alias("_who"), F.col("key_id").alias("_key")).distinct()
    pinned = pins.withColumn("_pinned", F.lit(True))
    registered = pins.select("store_id", "_who").distinct().withColumn("_registered", F.lit(True))
    signed = records.filter(F.col("signature").isNotNull()).withColumns({
        "_who": F.col("actor.contributor"), "_key": F.col("actor.key_id")})
    facts = (
        signed.join(registry, ["store_id", "_who", "_key"], "left")
        .join(pinned, ["store_id", "_who", "_key"], "left")
        .join(registered, ["store_id", "_who"], "left"))
    reg = F.col("_reg")
    is_registered = F.coalesce("_registered", F.lit(False))
    op_denied = (F.col("kind") == "operation_recorded") & ~F.coalesce(
        F.array_contains(reg["operations"], F.col("operation")), F.lit(False))
    is_registration = F.col("kind") == "contributor_registered"
    other_key = is_registration & ~F.coalesce(
        F.col("public_key_der_b64") == reg["public_key_der_b64"], F.lit(False))
    other_ops = is_registration & (F.array_join("operations", ",") != F.array_join(reg["operations"], ","))
    failure = (
        F.when(reg.isNull(), F.struct(F.lit("VG-PROV-003").alias("rule"), _line_text(
            "signer is not trusted: no such public key").alias("text")))
        .when(is_registered & F.col("_pinned").isNull(), F.struct(F.lit("VG-PROV-003").alias("rule"), _line_text(
            "key is not pinned by a contributor_registered record").alias("text")))
        .when(reg["status"] == "revoked", F.struct(
            F.lit("VG-PROV-004").alias("rule"), _line_text("signed by a revoked key").alias("text")))
        .when(~F.coalesce("signature_ok", F.lit(False)), F.struct(
            F.lit("VG-PROV-002").alias("rule"), _line_text("signature does not verify").alias("text")))
        .when(op_denied, F.struct(F.lit("VG-PROV-004").alias("rule"), _line_text(
            'operation "%s" is not authorized for this key', F.col("operation")).alias("text")))
        .when(other_key, F.struct(F.lit("VG-PROV-003").alias("rule"), _line_text(
            "registered public key does not match the key registry").alias("text"))))
    warnings = F.array(
        F.when(F.col("_f").isNull() & other_ops, F.struct(F.lit("VG-PROV-W003").alias("rule"), _line_text(
            "registered operations differ from the key registry").alias("text"))),
        F.when(F.col("_f").isNull() & ~is_registered, F.struct(F.lit("VG-PROV-W004").alias("rule"), _line_text(
            'signed by "%s" with no contributor_registered record', F.col("_who")).alias("text"))),
        F.col("_f"))
    return (
        facts.withColumn("_f", failure)
        .select("store_id", "line_no", F.explode(F.filter(warnings, lambda w: w.isNotNull())).alias("_w"))
        .select(*_finding(F.col("_w.rule"), F.col("_w.text"), F.col("line_no"))))


def artifact_refs(records: DataFrame) -> DataFrame:
    """One row per input and output of every record."""
    items = F.concat(
        F.transform("inputs", lambda e: F.struct(F.lit("in").alias("side"), e["artifact"].alias("artifact"), e["sha256"].alias("sha256"))),
        F.transform("outputs", lambda e: F.struct(F.lit("out").alias("side"), e["artifact"].alias("artifact"), e["sha256"].alias("sha256"))))
    return records.select("store_id", "line_no", "kind", F.explode(items).alias("_i")).select(
        "store_id", "line_no", "kind", "_i.*")


def manifest_refs(datasets: DataFrame | None, models: DataFrame | None, identities: DataFrame | None) -> DataFrame:
    """Registered hash of every typed reference: (store_id, ref, hash, contributor)."""
    parts = []
    for df, kind, name, value in (
        (datasets, "dataset", "name", "merkle_root"), (models, "model", "id", "sha256"),
        (identities, "pipeline", "name", "pipeline_id"),
    ):
        if df is not None:
            who = F.col("contributor") if "contributor" in df.columns else F.lit(None).cast("string")
            parts.append(df.select(
                "store_id", F.concat(F.lit(f"{kind}/"), F.col(name), F.lit("@"), F.col("version")).alias("ref"),
                F.lit(kind).alias("type"), strip_hash(F.col(value)).alias("hash"), who.alias("contributor")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def check_artifact_refs(records: DataFrame, manifests: DataFrame) -> DataFrame:
    """Typed references whose hash differs from, or misses, its registration."""
    typed = artifact_refs(records).filter(ref_type(F.col("artifact")).isin("dataset", "model", "pipeline"))
    joined = typed.withColumnRenamed("artifact", "ref").join(
        manifests.select("store_id", "ref", "hash"), ["store_id", "ref"], "left")
    rule = F.when(F.col("hash").isNull(), "VG-PROV-W002").when(F.col("hash") != F.col("sha256"), "VG-PROV-011")
    message = F.when(F.col("hash").isNull(), _line_text(
        'references unverifiable artifact "%s": not registered', F.col("ref"))).otherwise(
        _line_text('hash for "%s" does not match its registration', F.col("ref")))
    return joined.withColumn("_rule", rule).filter(F.col("_rule").isNotNull()).select(
        *_finding(F.col("_rule"), message, F.col("line_no")))


def registered_hashes(records: DataFrame) -> DataFrame:
    """(store_id, ref, sha256, first_line, lines) of every registered artifact hash."""
    outs = artifact_refs(records.filter(F.col("kind") == "artifact_registered"))
    return outs.filter((F.col("side") == "out") & is_ref(F.col("artifact"))).groupBy(
        "store_id", F.col("artifact").alias("ref"), "sha256").agg(
        F.min("line_no").alias("first_line"), F.count("*").alias("lines"))


def conflicting_registrations(records: DataFrame) -> DataFrame:
    """Artifacts registered with more than one hash (the hashes: `conflicting_hashes`)."""
    by_ref = registered_hashes(records).groupBy("store_id", "ref").agg(F.count("*").alias("_n"))
    return by_ref.filter("_n > 1").select(*_finding("VG-PROV-010", F.format_string(
        'artifact "%s" has conflicting registered hashes', F.col("ref"))))


def conflicting_hashes(records: DataFrame) -> DataFrame:
    """Long format of the conflicts: one row per reference and hash, with its first line."""
    hashes = registered_hashes(records)
    many = hashes.groupBy("store_id", "ref").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return hashes.join(many, ["store_id", "ref"], "left_semi")


def provenance_summary(parsed: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Counts, head and contributors per store.

    Contributors are distinct names, gathered after a distinct per store.
    """
    record = F.col("record")
    counts = parsed.groupBy("store_id").agg(
        F.count_if(F.col("problem").isNull()).alias("record_count"),
        F.count_if(F.col("problem").isNotNull()).alias("malformed_count"),
        F.count_if(F.col("problem").isNull() & record["signature"].isNull()).alias("unsigned_count"),
        F.max_by(record["record_hash"], F.when(F.col("problem").isNull(), F.col("line_no"))).alias("head"))
    names = parsed.filter(F.col("problem").isNull()).select(
        "store_id", record["actor"]["contributor"].alias("_who")).distinct().groupBy("store_id").agg(
        F.array_sort(F.collect_list("_who")).alias("contributors"))
    return counts.join(names, "store_id", "left")


def provenance_status(summary: DataFrame, findings: DataFrame, anchors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(status rows, extra findings): anchor comparison, unsigned count and final status.

    `anchored` is null where no head is expected.
    """
    base = summary
    if anchors is not None:
        base = base.join(anchors.select("store_id", "expected_head"), "store_id", "left")
    else:
        base = base.withColumn("expected_head", F.lit(None).cast("string"))
    expected = F.when(X.js_trim(F.col("expected_head")) != "", X.js_trim(F.col("expected_head")))
    base = base.withColumn("anchored", F.when(
        expected.isNotNull(), F.coalesce(F.col("head") == expected, F.lit(False))))
    extra = base.select(
        "store_id", F.explode(F.filter(F.array(
            F.when(F.col("unsigned_count") > 0, F.struct(
                F.lit("VG-PROV-009").alias("rule"),
                F.format_string("%d record(s) are unsigned", F.col("unsigned_count")).alias("text"))),
            F.when(~F.col("anchored"), F.struct(
                F.lit("VG-PROV-008").alias("rule"),
                F.lit("log head does not match the expected anchor").alias("text")))),
            lambda e: e.isNotNull())).alias("_e")).select(*_finding(F.col("_e.rule"), F.col("_e.text")))
    blockers = findings.groupBy("store_id").agg(F.bool_or(F.col("severity") == "BLOCKER").alias("_blocked"))
    blocked = F.coalesce("_blocked", F.lit(False)) | F.coalesce(~F.col("anchored"), F.lit(False))
    status = (
        F.when(blocked, "FAIL").when(F.col("record_count") == 0, "NOT_CHECKED")
        .when(F.col("unsigned_count") > 0, "UNSIGNED").when(F.col("anchored"), "PASS").otherwise("UNANCHORED"))
    return base.join(blockers, "store_id", "left").withColumn("status", status).drop("_blocked"), extra


def checked_records(parsed: DataFrame, keys: DataFrame, stored: bool = False) -> DataFrame:
    """Valid records with `signature_ok`, computed once and stored.

    Each distinct (key, hash, signature) is verified once, however often its line is repeated.
    Where `parsed` is `stored` and has the signatures checked, its records are not stored a second time.
    """
    from codeaudit.functions.signatures import signature_ok

    records = valid_records(parsed)
    if "signature_ok" in records.columns:
        return records if stored else checkpoint(records)
    ring = keys.select("store_id", F.col("contributor").alias("_who"), F.col("key_id").alias("_key"),
                       F.col("public_key_der_b64").alias("_der"))
    who = records.withColumns({"_who": F.col("actor.contributor"), "_key": F.col("actor.key_id")}).join(
        ring, ["store_id", "_who", "_key"], "left")
    signed = who.filter(F.col("signature").isNotNull() & F.col("_der").isNotNull()).select(
        "_der", "record_hash", "signature").distinct()
    verified = signed.select(
        F.col("_der").alias("_d"), F.col("record_hash").alias("_h"), F.col("signature").alias("_s"),
        signature_ok(F.col("_der"), F.col("record_hash"), F.col("signature")).alias("signature_ok"))
    return checkpoint(who.join(verified, (F.col("_der") == F.col("_d")) & (F.col("record_hash") == F.col("_h"))
                               & (F.col("signature") == F.col("_s")), "left").drop("_who", "_key", "_der", "_d", "_h", "_s"))


def verify_provenance(
    log: DataFrame, keys: DataFrame, manifests: DataFrame, anchors: DataFrame | None = None,
    parsed: DataFrame | None = None, cap: int | None = None, records: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """All checks over all stores: (findings and warnings, one status row per store).

    `keys` is the registry.  `parsed` and `records` (what `checked_records` returns)
    are computed here unless the caller has them.  Every finding is returned; `cap`
    limits the list per rule as a report does and adds one row with the number left out.
    """
    if parsed is None:
        parsed = checkpoint(parse_log(log))
    if records is None:
        records = checked_records(parsed, keys)
    parts = [
        verify_chain(parsed), check_replay(records), check_parents(records), check_signers(records, keys),
        check_artifact_refs(records, manifests), conflicting_registrations(records), check_parent_time(records)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    status, extra = provenance_status(provenance_summary(parsed), found, anchors)
    everything = found.unionByName(extra)
    if cap is not None:
        everything = cap_per_rule(everything, cap, ["store_id", "list", "rule"], ["line_no", "message"])
    return everything, status


# ---- lineage and building ----------------------------------------------------

def lineage(records: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Records that output an artifact, and all their ancestors: (store_id, artifact, line_no, record_hash).

    A record is known by the last line that holds its hash while the closure walks: every step
    of it moves two numbers of a pair of records, and hashes are met once before and once after.
    """
    last = records.groupBy("store_id", "record_hash").agg(F.max("line_no").alias("line_no"))

    def numbered(rows: DataFrame, name: str) -> DataFrame:
        line = last.select("store_id", F.col("record_hash").alias(name), F.col("line_no").alias("_line"))
        return rows.join(line, ["store_id", name]).drop(name).withColumnRenamed("_line", name)

    outs = records.select("store_id", F.col("record_hash").alias("_node"), F.explode("outputs").alias("_o")).select(
        "store_id", F.col("_o.artifact").alias("artifact"), "_node")
    # One closure per artifact, from all records that output it.
    roots = numbered(outs.join(artifacts.select("store_id", "artifact").distinct(), ["store_id", "artifact"]).distinct(), "_node")
    parents = records.select("store_id", F.explode("parent_record_hashes").alias("_src"), F.col("record_hash").alias("_dst"))
    edges = numbered(numbered(parents, "_src"), "_dst")
    found = reachable(edges, roots.withColumnRenamed("artifact", "_root"), ["store_id"], "_src", "_dst").select(
        "store_id", F.col("_root").alias("artifact"), F.col("_node").alias("line_no"))
    return found.join(last, ["store_id", "line_no"]).select("store_id", "artifact", "line_no", "record_hash")


def latest_inference(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Last inference record whose id or output is the target."""
    runs = records.filter(F.col("kind") == "inference_recorded").select("store_id", "line_no", "record_id", F.explode(
        F.array_distinct(F.concat(F.array("record_id"), F.transform("outputs", lambda e: e["artifact"])))).alias("target"))
    return runs.join(targets.select("store_id", "target").distinct(), ["store_id", "target"]).groupBy(
        "store_id", "target").agg(F.max("line_no").alias("line_no"), F.max_by("record_id", "line_no").alias("record_id"))


def build_records(rows: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Chain new records: one canonical unsigned log line per input row.

    `rows` has store_id, seq and `body`, the JSON of a record without hashes.  A
    record's hash covers the one before it, so one chain is serial by nature.  All
    that is not is done by many tasks: before, each record's canonical text is cut
    where its hashes stand; after, the log line is put together.  In between, rows
    are sorted in the shuffle and streamed, and a record costs one digest and a
    store one hash in memory, however long its batch is.
    """
    cut = rows.select("store_id", "seq", chain_parts(F.col("body")).alias("_p")).select("store_id", "seq", "_p.*")
    error = F.concat(F.lit("cannot chain a record: "), F.col("error"))
    joined = cut.withColumn("before", F.when(F.col("error").isNull(), F.col("before")).otherwise(F.raise_error(error))).drop("error")
    if heads is not None:
        joined = joined.join(heads.select("store_id", "head", "last_line"), "store_id", "left")
    else:
        joined = joined.withColumns({"head": F.lit(None).cast("string"), "last_line": F.lit(0).cast("long")})
    texts = ["before", "hashed", "between", "last", "after"]
    names = ["store_id", "kind", *texts, "line_no", "record_hash", "prev_record_hash"]

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, previous, line = None, None, 0
        for batch in batches:
            numbers, hashes, before_hashes = [], [], []
            for owner, head, last_line, before, hashed in zip(*(batch[c] for c in ("store_id", "head", "last_line", "before", "hashed"))):
                if owner != store:
                    store = owner
                    previous = head if isinstance(head, str) else None
                    line = int(last_line) if last_line == last_line and last_line is not None else 0
                said = "null" if previous is None else f'"{previous}"'
                digest = "sha256:" + hashlib.sha256(f"{before}{said}{hashed}".encode()).hexdigest()
                line += 1
                numbers.append(line), hashes.append(digest), before_hashes.append(previous)
                previous = digest
            yield batch.assign(line_no=numbers, record_hash=hashes, prev_record_hash=before_hashes)[names]

    ordered = joined.repartition("store_id").sortWithinPartitions("store_id", "seq")
    chained = ordered.mapInPandas(chain, "store_id string, kind string, " + ", ".join(f"{t} string" for t in texts)
                                  + ", line_no long, record_hash string, prev_record_hash string")
    quoted = F.concat(F.lit('"'), F.col("record_hash"), F.lit('"'))
    said = F.coalesce(F.concat(F.lit('"'), F.col("prev_record_hash"), F.lit('"')), F.lit("null"))
    raw = F.concat("before", said, "between", quoted, "last", quoted, "after")
    return chained.select("store_id", "line_no", "kind", "record_hash", "prev_record_hash", raw.alias("raw"))
