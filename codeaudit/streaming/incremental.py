"""Incremental operators: rescans, live log verification, live dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit.operators.scan_rules import scan_rules
from codeaudit.streaming.log_check import stream_check_log


def changed_files(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Files that are new or whose modification time moved since the snapshot."""
    return files.join(snapshot.select("project_id", "path", "mtime"), ["project_id", "path", "mtime"], "left_anti")


def incremental_scan(files: DataFrame, snapshot: DataFrame, previous: DataFrame, packs: list[str] | None = None) -> DataFrame:
    """Findings of changed files, and the earlier ones of files that are still the same."""
    fresh = scan_rules(changed_files(files, snapshot), packs)
    same = files.join(snapshot.select("project_id", "path", "mtime"), ["project_id", "path", "mtime"], "left_semi")
    kept = previous.join(same.select("project_id", F.col("path").alias("file")), ["project_id", "file"], "left_semi")
    return fresh.unionByName(kept.select(fresh.columns))


def stream_scan(files: DataFrame, packs: list[str] | None = None) -> DataFrame:
    """The rule scan over a stream of files: stateless, as a file is one row."""
    return scan_rules(files, packs)


def stream_verify_chain(lines: DataFrame) -> DataFrame:
    """Malformed lines and broken links of a stream of log lines, whatever their order."""
    return stream_check_log(lines, replays=False)


def stream_dedupe_first(findings: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """First finding of a fingerprint within the watermark."""
    return findings.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["project_id", "fingerprint"])

