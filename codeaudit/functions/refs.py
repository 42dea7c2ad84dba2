"""Artifact references, labels and relative paths."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values -------------------------------------------------------------
ARTIFACT_REF = r"^([a-z][a-z0-9_-]{0,31})/([A-Za-z0-9][A-Za-z0-9._-]{0,63})@([A-Za-z0-9][A-Za-z0-9._-]{0,63})$"
LABEL = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"
SHA256_HEX = r"^[0-9a-f]{64}$"
RECORD_HASH = r"^sha256:[0-9a-f]{64}$"
BASE64 = r"^[A-Za-z0-9+/]+={0,2}$"
MAX_PATH_BYTES = 4096
MAX_COMPONENT_BYTES = 255
# --- end of fixed values ------------------------------------------------------


def ref_type(artifact: Column) -> Column:
    """Type of a `type/name@version` reference, '' for anything else."""
    return F.regexp_extract(artifact, ARTIFACT_REF, 1)


def ref_name(artifact: Column) -> Column:
    return F.regexp_extract(artifact, ARTIFACT_REF, 2)


def ref_version(artifact: Column) -> Column:
    return F.regexp_extract(artifact, ARTIFACT_REF, 3)


def is_ref(artifact: Column) -> Column:
    return artifact.rlike(ARTIFACT_REF)


def strip_hash(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), "^sha256:", "")


def key_id(public_key_b64: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the DER key."""
    return F.substring(F.sha2(F.unbase64(public_key_b64), 256), 1, 32)


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode normal form C."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def to_nfc(text: Column) -> Column:
    """NFC; ASCII text is already normal."""
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), text).otherwise(nfc(text))


def path_error(path: Column) -> Column:
    """Why a relative path is not acceptable, or null."""
    parts = F.split(path, r"[/\\]", -1)
    kept = F.filter(parts, lambda p: p != ".")
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "path must be a non-empty string")
        .when(path.contains("\0"), "path contains a NUL byte")
        .when(path.rlike(r"[\x00-\x1f\x7f]"), "path contains control characters")
        .when(path.rlike(r"[\u202a-\u202e\u2066-\u2069\u200e\u200f]"),
              "path contains bidirectional override characters")
        .when(path.rlike(r"^[/\\]|^[A-Za-z]:"), "path must be relative to the artifact root")
        .when(F.exists(parts, lambda p: p == ""), "path contains an empty segment")
        .when(F.exists(parts, lambda p: p == ".."), 'path contains a ".." segment')
        .when(F.exists(kept, lambda p: F.octet_length(p) > MAX_COMPONENT_BYTES),
              "path segment exceeds the component length limit")
        .when(F.size(kept) == 0, "path does not name an artifact")
        .when(F.octet_length(F.array_join(kept, "/")) > MAX_PATH_BYTES, "path exceeds the length limit"))


def normalise_rel_path(path: Column) -> Column:
    """Canonical form: NFC, '.' segments dropped, '/' between segments."""
    normal = to_nfc(path)
    return F.array_join(F.filter(F.split(normal, r"[/\\]", -1), lambda p: p != "."), "/")


def code_unit_order(text: Column) -> Column:
    """Sort key that orders text by UTF-16 code units."""
    return F.encode(text, "UTF-16BE")
