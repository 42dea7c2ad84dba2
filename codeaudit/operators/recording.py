"""New provenance records by kind, each with the shape its kind asks for, chained onto the stores' logs.

Every function takes rows with store_id, seq (their order), timestamp, contributor,
key_id (may be null) and the columns its kind needs, and optionally `metadata`
(JSON text) and `parents` (record hashes).  It returns the log lines of the rows
that are well formed, chained by `build_records`, and the others with the reason:
a malformed row is never chained.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit import schemas as S
from codeaudit.functions.canonical import inspect_record, json_string, object_text
from codeaudit.operators.provenance import OPERATIONS, build_records, record_error
from codeaudit.session import checkpoint

SCHEMA_VERSION = "1.0"
_HELD = "sha256:" + "0" * 64  # stands for the hashes while the shape is checked


def _array(items: Column) -> Column:
    """JSON text of an array of JSON texts; null is an empty array."""
    return F.concat(F.lit("["), F.array_join(F.coalesce(items, F.array().cast("array<string>")), ","), F.lit("]"))


def _refs(items: Column) -> Column:
    return _array(F.transform(items, lambda r: object_text(
        artifact=F.coalesce(json_string(r["artifact"]), F.lit("null")), sha256=F.coalesce(json_string(r["sha256"]), F.lit("null")))))


def _recorded(rows: DataFrame, kind: str, heads: DataFrame | None, inputs: Column | None = None, outputs: Column | None = None,
              **own: Column) -> tuple[DataFrame, DataFrame]:
    have = set(rows.columns)
    text = lambda c: F.coalesce(json_string(F.col(c)), F.lit("null"))
    none = F.lit("[]")
    fields = dict(
        schema_version=F.lit(f'"{SCHEMA_VERSION}"'), kind=F.lit(f'"{kind}"'), timestamp=text("timestamp"),
        actor=object_text(contributor=text("contributor"), key_id=text("key_id")),
        inputs=none if inputs is None else _refs(inputs), outputs=none if outputs is None else _refs(outputs),
        parent_record_hashes=_array(F.transform("parents", json_string)) if "parents" in have else none, **own)
    # Metadata is left out where there is none.
    plain = object_text(**fields)
    body = plain if "metadata" not in have else F.when(F.col("metadata").isNull(), plain).otherwise(object_text(**fields, metadata=F.col("metadata")))
    held = F.concat(F.lit(f'{{"record_hash":"{_HELD}","record_id":"{_HELD}",'), F.substr(F.col("body"), F.lit(2)))
    looked = rows.select("store_id", "seq", body.alias("body")).withColumn("_i", inspect_record(held)).withColumn("_r", F.from_json(held, S.PROV_RECORD))
    i = F.col("_i")
    bad_mode = F.get_json_object("body", "$.metadata.output_mode")
    problem = F.coalesce(
        F.when(i["error"].isNotNull(), F.concat(F.lit("not canonical JSON: "), i["error"])),
        record_error(F.col("_r"), i["keys"], i["metadata_depth"], i["metadata_bytes"]),
        F.when((F.lit(kind) == "inference_recorded") & bad_mode.isNotNull() & ~bad_mode.isin("raw", "canonical_json"),
               'metadata.output_mode must be "raw" or "canonical_json"'))
    judged = checkpoint(looked.select("store_id", "seq", "body", problem.alias("problem")))
    built = build_records(judged.filter("problem IS NULL").select("store_id", "seq", "body"), heads)
    return built, judged.filter("problem IS NOT NULL").select("store_id", "seq", "problem")


def register_contributors(rows: DataFrame, heads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with `public_key_der_b64` and `operations`; without any named, a contributor may do all."""
    every = F.array(*map(F.lit, OPERATIONS))
    allowed = F.when(F.size(F.coalesce("operations", F.array().cast("array<string>"))) > 0, F.array_distinct("operations")).otherwise(every)
    text = lambda c: F.coalesce(json_string(F.col(c)), F.lit("null"))
    return _recorded(rows, "contributor_registered", heads, contributor=text("contributor"), key_id=text("key_id"),
                     operations=_array(F.transform(allowed, json_string)), public_key_der_b64=text("public_key_der_b64"))


def record_artifacts(rows: DataFrame, heads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with `outputs`, the artifacts (artifact, sha256) that are registered: datasets, models, pipelines or files."""
    return _recorded(rows, "artifact_registered", heads, outputs=F.col("outputs"))


def record_operations(rows: DataFrame, heads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with `operation`, `inputs` and `outputs`."""
    return _recorded(rows, "operation_recorded", heads, F.col("inputs"), F.col("outputs"),
                     operation=F.coalesce(json_string(F.col("operation")), F.lit("null")))


def record_inferences(rows: DataFrame, heads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with `input`, `model`, `pipeline` and `output`, one artifact each."""
    given = F.filter(F.array("input", "model", "pipeline"), lambda r: r.isNotNull())
    return _recorded(rows, "inference_recorded", heads, given, F.filter(F.array("output"), lambda r: r.isNotNull()))
